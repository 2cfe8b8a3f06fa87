"""Snapshots of a site side by side, by host and quarter: old ones can be read again, new ones as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "product_id string, html string, host string, quarter string"


def write_snapshot(pages: DataFrame, path: str) -> None:
    """Adds pages (product_id, html, host, quarter) to their snapshots."""
    pages.select("product_id", "html", "host", "quarter").write.mode("append").partitionBy("host", "quarter").parquet(path)


def read_snapshot(spark: SparkSession, path: str, host: str | None = None, quarter: str | None = None) -> DataFrame:
    """Pages of a host and quarter; only their folders are read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    rows = rows if host is None else rows.where(rows.host == host)
    return rows if quarter is None else rows.where(rows.quarter == quarter)


def process_new(spark: SparkSession, path: str, handle, checkpoint: str) -> None:
    """Calls ``handle(rows, batch_id)`` for pages that no earlier call with this checkpoint has seen, and returns."""
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
