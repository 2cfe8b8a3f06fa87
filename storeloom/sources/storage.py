"""Stored pages: where they may lie, and the first place where one does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ProductHtmlNotFound(LookupError):
    def __init__(self, product_id: str, attempted: list[str]):
        super().__init__(f"no stored page of {product_id}; tried {', '.join(attempted)}")
        self.product_id, self.attempted = product_id, attempted


def read_pages(spark, path: str) -> DataFrame:
    """Stored pages as (path, html), one file a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def first_stored(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (product_id, paths) with the first path that is stored and its html; null where none is.

    The lookup is one join of (product, place) with the stored paths; the html joins
    once the place is known, so no page is shuffled for a place that loses.
    """
    places = wanted.select("product_id", F.posexplode("paths").alias("place", "path"))
    hits = places.join(stored.select("path").distinct(), "path").groupBy("product_id").agg(F.min_by("path", "place").alias("path"))
    found = hits.join(stored.select("path", "html").dropDuplicates(["path"]), "path")
    return wanted.join(found, "product_id", "left").select("product_id", "paths", "path", "html")


def read_product_html(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """first_stored(), with an error for the first product that isn't stored anywhere."""
    found = first_stored(wanted, stored)
    lost = found.where("path is null").orderBy("product_id").limit(1).collect()
    if lost:
        raise ProductHtmlNotFound(lost[0].product_id, list(lost[0].paths))
    return found
