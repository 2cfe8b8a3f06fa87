"""When requests may start: a host's requests are an interval apart at least.

slot = max(time, next free time of the host); the next free time is slot + interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def schedule(requests: DataFrame, interval: int, *, key: str = "host_id", time: str = "t_us", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Batch form, of all requests at once: slot = n * interval + running maximum of (time - n * interval)."""
    turn = Window.partitionBy(key).orderBy(*order)
    n = F.row_number().over(turn)
    rows = requests.withColumn("_n", n * F.lit(interval).cast("long")).withColumn("_lag", F.col(time) - F.col("_n"))
    slot: Column = F.max("_lag").over(turn.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")
    return rows.withColumn("slot", slot).withColumn("wait", F.col("slot") - F.col(time)).drop("_n", "_lag")


def pace_stream(requests: DataFrame, interval: int) -> DataFrame:
    """Streaming form, of a stream (host_id, seq, t_us): a host's next free time is its state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        (free,) = state.get if state.exists else (-(1 << 62),)
        # the batch form over this trigger's rows, which the state's next free time precedes
        times = rows["t_us"].to_numpy(np.int64)
        before = np.arange(len(times)) * interval
        slots = np.maximum(np.maximum.accumulate(times - before), free) + before
        state.update((int(slots[-1]) + interval,))
        yield rows.assign(slot=slots, wait=slots - times)[["host_id", "seq", "t_us", "slot", "wait"]]

    return requests.groupBy("host_id").applyInPandasWithState(run, "host_id long, seq long, t_us long, slot long, wait long", "free long", "append", GroupStateTimeout.NoTimeout)


def host_rates(requests: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests per host and window of event time ``ts``; rows later than the watermark are left out."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", every), "host_id").agg(F.count("*").alias("n")).select("window.start", "window.end", "host_id", "n")
