"""Text recognition by an engine that the caller gives: (image bytes, mime type) -> JSON text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeloom.functions.jsonx import recognised


def transcribe(images: DataFrame, make_engine: Callable[[], Callable[[bytes, str], str]], checks=()) -> DataFrame:
    """Rows (id, content, mime_type) with the struct ``result`` of their lines; an engine's failure is PROVIDER_ERROR."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make_engine()
        for batch in batches:
            out = []
            for content, mime in zip(batch["content"], batch["mime_type"]):
                try:
                    out.append(engine(bytes(content), mime))
                except Exception as error:
                    import json

                    out.append(json.dumps({"ok": False, "error": {"code": type(error).__name__, "message": str(error)}}))
            yield pd.DataFrame({"id": batch["id"], "stdout": out})

    return images.select("id", "content", "mime_type").mapInPandas(run, "id long, stdout string").select("id", recognised(F.col("stdout"), checks).alias("result"))
