"""Near-duplicate documents by BagMinHash signatures (operator 2).

A document is the multiset of its runs of five lower-case words. Every shingle of
weight w is the part up to w of a Poisson process over weight and time: the
weights are cut into the dyadic intervals (0, 1], (1, 2], (2, 4], ...; each is a process
of its own, a rate proportional to its length, whose points fall on a
register and a weight coordinate; a point counts if its coordinate is at most w.
So the points of a smaller weight are among those of a larger one, a register's
first arrival is equal for two documents with the probability of their
weighted Jaccard similarity, and a process is left as soon as its next arrival is
later than every register's. Registers are banded, and pairs that share a band are
verified by their exact multiset overlap (neardup.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices, texts
from .neardup import SIMILARITY, classes, mix, shingles, word_hashes

BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Arrivals drawn at a time after the first.
AHEAD = 4


def _elements(hashed: np.ndarray, offsets: np.ndarray):
    """(document, shingle, count) of the distinct shingles of each document."""
    hashed = hashed.copy()
    for a, b in zip(offsets, offsets[1:]):
        hashed[a:b].sort()
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.ones(len(hashed), bool)
    first[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], hashed[at], np.diff(np.append(at, len(hashed)))


def signatures(hashed: np.ndarray, offsets: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """(documents, m): the first arrival at each register, as the bits of a double; all ones where there is no shingle."""
    n = len(offsets) - 1
    registers = np.full(n * m, np.inf)
    doc, seed, weight = _elements(hashed, offsets)
    # one process for each interval that the weight reaches into
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(int), 0) + 1
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    doc, seed, weight = (np.repeat(x, levels) for x in (doc, seed, weight))
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mix(seed ^ (level.astype(np.uint64) << np.uint64(48)))
    time, index = np.zeros(len(doc)), 0
    while len(doc):
        for _ in range(1 if index == 0 else AHEAD):
            draw = mix(seed + np.uint64(index * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            index += 1
            uniform = ((draw >> np.uint64(24)) + np.uint64(1)).astype(float) * 2.0**-40
            time = time - np.log(uniform) / (m * width)
            register = ((draw & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
            counts = level == 0
            if not counts.all():
                some = np.flatnonzero(~counts)
                place = low[some] + width[some] * ((mix(draw[some]) >> np.uint64(11)).astype(float) + 1) * 2.0**-53
                counts = counts.copy()
                counts[some] = place <= weight[some]
                np.minimum.at(registers, doc[counts] * m + register[counts], time[counts])
            else:
                np.minimum.at(registers, doc * m + register, time)
        going = time < registers.reshape(n, m).max(1)[doc]
        doc, seed, weight, level, low, width, time = (x[going] for x in (doc, seed, weight, level, low, width, time))
    return registers.view(np.uint64).reshape(n, m)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(documents, bands) keys; equal rows of a band have one key."""
    n, m = signature.shape
    rows = signature.reshape(n, bands, m // bands)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for k in range(rows.shape[2]):
        key = mix(key ^ rows[:, :, k])
    return key.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit hash of its word sequence (h1, h2), its band keys (none without words)."""

    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            words, at = word_hashes(batch.column("text"))
            hashed, offsets = shingles(words, at)
            keys = band_keys(signatures(hashed, offsets))
            two = []
            for salt in (1, 2):
                # a sum over places, each word mixed with its place
                place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
                mixed = mix(mix(words + np.uint64(salt)) ^ place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
                two.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
            full = np.diff(offsets) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, keys.shape[1], 0))]).astype(np.int32)), pa.array(keys[full].reshape(-1)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(two[0]), pa.array(two[1]), lists], names=["doc_id", "h1", "h2", "keys"])

    return texts(docs).mapInArrow(run, "doc_id long, h1 long, h2 long, keys array<long>")


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, exact_id, n_links.

    exact_id: the least doc_id with the same words (documents without words are
    copies of each other); class_id: the least doc_id of its component of links of
    similarity ``threshold`` or more; n_links: links of its text to different texts
    that were verified to find the classes. Null texts are empty, rows that repeat a
    doc_id repeat its row, an empty table gives none; other columns are ignored. Of a doc_id with several texts the least
    by order of strings is compared. A row without a doc_id is never another's first: it gets the class of
    the documents with its words, null where there is none.
    """
    ws = Workspace(spark, "near_duplicates")
    signed = ws.save(sign(docs), "signed")
    # copies of one text may be any share of the rows
    ws.save(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    known = ws.meet(signed, "copies", ["h1", "h2"], ["doc_id"], ws.rows["signed"], "left").withColumn("exact_id", F.coalesce("first", "doc_id"))
    exact = ws.save(known.select("doc_id", "exact_id", F.when(F.col("doc_id") == F.col("exact_id"), F.col("keys")).alias("keys")), "exact")
    buckets = ws.save(exact.where("keys is not null").select(F.explode("keys").alias("key"), F.col("exact_id").alias("id")).distinct(), "buckets")
    ws.drop("signed", "copies")

    def units_of(ids: DataFrame) -> DataFrame:
        return texts(docs).withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))

    cc, links = classes(ws, buckets, units_of, threshold)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    size = exact.groupBy("exact_id").agg(F.count("*").alias("n"))
    ws.save(cc.join(degree, "id", "left").withColumnRenamed("id", "exact_id").join(size, "exact_id"), "known")
    ws.keep("exact", "known")
    out = ws.meet(exact.select("doc_id", "exact_id"), "known", ["exact_id"], ["doc_id"], ws.rows["exact"], "left")
    return out.select("doc_id", F.coalesce("component", "exact_id").alias("class_id"), "exact_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(spark: SparkSession, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents without those that repeat another: the least doc_id of each class stays, as
    one row; rows without a doc_id can't be named, so they stay."""
    kept = near_duplicates(spark, docs, threshold).where("doc_id = class_id").select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(docs.where("doc_id is null"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
