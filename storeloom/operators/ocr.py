"""Recognised lines of images: ordered text, confidence, quality checks.

Lines: (doc_id, pos, text, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.functions.numbers import confidence_band, three_decimals
from storeloom.functions.text import trim_spaces

# Characters of traditional Chinese and what they are misread as.
CONFUSIONS = (("黃耆", ("黄者", "黃蓍")),)


def markdown(lines: DataFrame) -> DataFrame:
    """doc_id and its trimmed lines that aren't blank, in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", trim_spaces(F.col("text")).alias("t"))))
    kept = F.filter(F.transform(rows, lambda r: r["t"]), lambda t: t != "")
    return lines.groupBy("doc_id").agg(F.array_join(kept, "\n").alias("markdown"))


def confidence(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(three_decimals(F.avg("confidence")).alias("average")).withColumn("band", confidence_band(F.col("average")))


def confusion_check(texts: Column, table=CONFUSIONS) -> Column:
    """Warnings suspect_<expected>_as_<misread> of an array of texts, in the table's order; the texts stay as they are."""
    joined = F.array_join(texts, "\n")
    found = [F.when(joined.contains(misread), f"suspect_{expected}_as_{misread}") for expected, misreads in table for misread in misreads]
    return F.array_compact(F.array(*found))


def run_checks(texts: Column, checks) -> Column:
    return F.flatten(F.array(*(check(texts) for check in checks)))


def empty_result(provider: str, reason: str, warnings=()) -> Column:
    text = lambda x: F.lit(x).cast("string")
    return F.struct(text("").alias("raw_markdown"), text("LOW").alias("confidence"), text("; ".join(warnings) or None).alias("notes"), text(reason).alias("fallback_reason"), text(provider).alias("provider"))
