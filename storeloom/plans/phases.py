"""Phases of a source in their fixed order, a written table between each and the next."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from storeloom.streaming.progress import PHASES, Tracker


def run_phases(spark: SparkSession, start: DataFrame, phases: Mapping[str, Callable[[DataFrame], DataFrame]], path: str, tracker: Tracker | None = None) -> DataFrame:
    """Applies the given phases in the order of PHASES; each result is written below ``path`` and read again.

    A run that was broken off goes on after the last phase that had written its table.
    """
    if unknown := [name for name in phases if name not in PHASES]:
        raise ValueError(f"no such phase: {', '.join(unknown)}")
    rows, todo = start, [name for name in PHASES if name in phases]
    jvm = spark._jvm
    for done, name in enumerate(todo):
        table = f"{path.rstrip('/')}/{name}"
        marker = jvm.org.apache.hadoop.fs.Path(f"{table}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            phases[name](rows).write.mode("overwrite").parquet(table)
        rows = spark.read.parquet(table)
        if tracker:
            tracker.update(done + 1, len(todo), name)
    return rows
