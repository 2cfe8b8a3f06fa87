"""What the operators share: shared-folder tables, input cleaning, components."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storeloom.functions.lineage import new_folder

#: A key held by more than one in SHARE rows is dealt over several parts; there are fewer than SHARE such keys.
SHARE = 4096


class Workspace:
    """Parquet tables in the shared folder that ``spark.checkpoint.dir`` names.

    They cut lineage and outlive any executor. A machine-local folder is used
    only where the setting is absent and the master is local (tests).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.tables = spark, set()
        #: How many rows each table has.
        self.rows: dict[str, int] = {}
        self._schemas: dict[str, StructType] = {}
        self.root = new_folder(spark, name)
        _OPEN.append((spark, self.root))

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Writes a table, whose rows are counted on the way."""
        seen = Observation()
        self.tables.add(table)
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(self.path(table))
        self.rows[table] = seen.get.get("rows") or 0
        self._schemas[table] = df.schema
        return self.load(table)

    def load(self, table: str) -> DataFrame:
        """A saved table; each load has columns of its own, so that it joins with another."""
        return self.spark.read.schema(self._schemas[table]).parquet(self.path(table))

    def meet(self, rows: DataFrame, table: str, on: list[str], place: list[str], total: int, how: str = "inner") -> DataFrame:
        """``rows`` joined with a saved table of one row for each key ``on``, where ``n`` says how many rows have the key.

        A key may have any share of all ``total`` rows. One with more than a share of total / SHARE
        is dealt by ``place`` over at least as many parts as it has such shares (a power of two), and its row of the table
        is sent to each. The hashes of the keys that this takes, fewer than SHARE by their count, come to
        the driver and stand in the plan; a key whose hash is equal by chance is dealt likewise on both sides.
        """
        known, share = self.load(table), max(1, total // SHARE)
        key = F.xxhash64(*on)
        sets: dict[int, list[int]] = {}
        for row in known.where(F.col("n") > share).select(key.alias("key"), "n").collect():
            sets.setdefault(1 << (-(-row.n // share) - 1).bit_length(), []).append(row.key)
        parts = F.lit(1)
        for n, keys in sorted(sets.items()):
            parts = F.when(key.isin(keys), n).otherwise(parts)
        dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*place), parts).cast("int"))
        spread = known.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
        return dealt.join(spread, [*on, "__part"], how).drop("__part")

    def drop(self, *tables: str) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            self.tables.discard(table)
            _delete(self.spark, self.path(table))

    def keep(self, *tables: str) -> None:
        """Deletes all tables but those that a result still reads; these go when the driver's Python ends."""
        self.drop(*(self.tables - {*tables}))


_OPEN: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear() -> None:
    for spark, root in _OPEN:
        # the session may have ended before, with the JVM
        with contextlib.suppress(Exception):
            _delete(spark, root)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text of every row; a null text is an empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, halved until each holds at most ``limit`` bytes of ``column`` or one row."""
    stack = []
    for batch in batches:
        stack.append(batch)
        while stack:
            top = stack.pop()
            if len(top) > 1 and top.column(column).nbytes > limit:
                half = len(top) // 2
                stack += [top.slice(half), top.slice(0, half)]
            elif len(top):
                yield top


def first_by_hash(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The n rows with the least hashes of ``key``, of ``total`` in all.

    A threshold on the hash leaves about 1.3 n rows before they are sorted, so that no
    task sends its own n rows to where they meet.
    """
    h = F.xxhash64(key, F.lit(3)).bitwiseAND((1 << 63) - 1)
    if total > 2 * n + 1_000:
        rows = rows.where(h < int((1 << 63) * (1.3 * n + 500) / total))
    return rows.orderBy(h, key).limit(n)


def components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component), component the smallest id.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each
    written to the shared folder; only edges move, nothing is collected but
    a count and a checksum per round.
    """
    spark = ws.spark
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, last, step = ws.save(ordered, f"{name}_0"), None, 0
    while True:
        total = ws.rows[f"{name}_{step}"]
        both = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ws.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), f"{name}_least_{step}")
        # a node may have any share of all edges
        large = ws.meet(both.where("v > u"), f"{name}_least_{step}", ["u"], ["v"], 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = ws.save(large, f"{name}_large_{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        step += 1
        small = ws.save(small, f"{name}_{step}")
        ws.drop(f"{name}_{step - 1}", f"{name}_large_{step - 1}", f"{name}_least_{step - 1}")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        current, last = small, now
    ids = small.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = small.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return spark.createDataFrame([], ids.schema).unionAll(ids).unionAll(roots)
