"""Nearest neighbours by an adaptive dimension scan of inverted lists (operator 3).

Equal vectors are one class with its ``KEEP`` least ids, so a vector that holds a large
part of all rows is searched once. Classes are put in lists, as many as the square root of their
number: those of up to ``LISTS`` centres of a k-means, and beyond that of centre and remainder,
a second k-means of what the nearest centre leaves. Both are fitted on ``SAMPLE`` classes at most; every
class is indexed. How many lists a query probes
is set by the recall that it gives within the sample, whose neighbours are
farther than all rows' and so need more lists rather than fewer. Unit vectors are turned by a random
rotation and stored in blocks of ``BLOCK`` columns: after each block a candidate whose
partial distance, scaled up, exceeds the distance of the k-th best by more than
chance allows is abandoned. Lists and their queries are cut into parts of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, first_by_hash

NEAREST, KEEP = 5, 6
SAMPLE, LISTS, ROUNDS = 20_000, 1_024, 10
#: Remainders of a centre at most: 131,072 lists are the square root of 17 thousand million classes.
REMAINDERS = 128
#: Lists are probed until this recall is met among TRIALS vectors of the sample, and LEAST_PROBED at least.
RECALL, TRIALS, LEAST_PROBED = 0.97, 256, 8
BLOCK, EPSILON = 16, 2.1
PART, QUERIES = 2_048, 1_024
EVERY = 50


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the vectors that take part: not null, of the commonest length, all finite, not zero."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite & F.exists("embedding", lambda x: x != 0))
    return v


def _classes(batches):
    """Distinct vectors of a batch with their least ids."""
    import xxhash

    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        flat = batch.column("embedding")
        rows = np.stack([np.asarray(x, float) for x in flat.to_pylist()]) if len(batch) else np.empty((0, 0))
        rows = rows + 0.0  # no negative zeros
        held: dict[bytes, list[int]] = {}
        for i in np.argsort(ids, kind="stable"):
            held.setdefault(rows[i].tobytes(), []).append(int(ids[i]))
        keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(k), np.int64) for k in held]).reshape(-1, 2)
        lists = [sorted(x)[:KEEP] for x in held.values()]
        yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(held), pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["v1", "v2", "vec", "ids"])


def _keys(batches):
    """vec_id and the class key of each vector."""
    import xxhash

    for batch in batches:
        digests = [xxhash.xxh3_128_digest((np.asarray(x, float) + 0.0).tobytes()) for x in batch.column("embedding").to_pylist()]
        keys = np.array([np.frombuffer(d, np.int64) for d in digests]).reshape(-1, 2)
        yield pa.record_batch([batch.column("vec_id"), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["vec_id", "v1", "v2"])


def unit(rows: np.ndarray) -> np.ndarray:
    # by the largest component first, so that no square over- or underflows
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k unit centres of unit vectors; a centre that loses all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = nearest_row(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = np.abs(sums).max(1) > 1e-12
        centres[full] = unit(sums[full])
    return centres


class Lists:
    """Centres c and remainders r; list (i, j) is about the point c_i + r_j."""

    def __init__(self, x: np.ndarray, wanted: int):
        self.centres = kmeans(x, max(1, min(LISTS, wanted, len(x))))
        self.rest = np.zeros((1, x.shape[1]))
        n = min(REMAINDERS, round(wanted / len(self.centres)), len(x))
        if n > 1:
            left = x - self.centres[nearest_row(x, self.centres)]
            # the remainders' directions, then their mean lengths
            full = left[np.abs(left).max(1) > 1e-9]
            if len(full) >= n:
                way = kmeans(unit(full), n)
                own = nearest_row(unit(full), way)
                length = np.bincount(own, np.sqrt((full * full).sum(1)), n) / np.maximum(np.bincount(own, minlength=n), 1)
                self.rest = way * length[:, None]
        self.norms = (self.centres * self.centres).sum(1)[:, None] + 2 * self.centres @ self.rest.T + (self.rest * self.rest).sum(1)

    def __len__(self) -> int:
        return self.norms.size

    def order(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest lists of each unit vector, nearest first."""
        near = 2 * ((x @ self.centres.T)[:, :, None] + (x @ self.rest.T)[:, None]) - self.norms
        near = near.reshape(len(x), -1)
        if count == 1:
            return near.argmax(1)[:, None].astype(np.int32)
        some = np.argpartition(-near, count - 1, axis=1)[:, :count] if count < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
        turn = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
        return np.take_along_axis(some, turn, 1).astype(np.int32)

    def orders(self, x: np.ndarray, count: int) -> np.ndarray:
        """order() in blocks of bounded size."""
        block = max(1, (1 << 21) // len(self))
        return np.concatenate([np.empty((0, count), np.int32), *(self.order(x[i : i + block], count) for i in range(0, len(x), block))])


def nearest_row(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])


def lists_to_probe(x: np.ndarray, lists: Lists, k: int, seed: int = 5) -> int:
    """The least number of lists that gives RECALL among some of the sample's own vectors."""
    trials = np.random.default_rng(seed).choice(len(x), min(TRIALS, len(x)), replace=False)
    home = lists.orders(x, 1)[:, 0]
    near = x[trials] @ x.T
    near[np.arange(len(trials)), trials] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(lists)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    need = []
    for t, found in zip(trials, best):
        place = np.empty(len(lists), np.int64)
        place[lists.order(x[t : t + 1], len(lists))[0]] = np.arange(len(lists))
        need += place[home[found]].tolist()
    return min(len(lists), max(LEAST_PROBED, 1 + int(np.quantile(need, RECALL, method="higher"))))


def rotation(d: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]


def scan(query: np.ndarray, blocks: list[np.ndarray], d: int, k: int) -> np.ndarray:
    """Indices of candidates that aren't abandoned; query and blocks are rotated unit vectors, by column blocks.

    After m of d dimensions the partial squared distance is about m / d of the whole, off
    by a factor of 1 + EPSILON / sqrt(m) with small probability.
    """
    n = len(blocks[0])
    alive = np.arange(n)
    part = np.zeros(n)
    seeds = min(n, max(4 * k, 64))
    whole = np.zeros(seeds)
    at = 0
    for b in blocks:
        whole += ((b[:seeds] - query[at : at + b.shape[1]]) ** 2).sum(1)
        at += b.shape[1]
    bound = np.partition(whole, k - 1)[k - 1] if seeds >= k else np.inf
    m = 0
    for b in blocks:
        part = part + ((b[alive] - query[m : m + b.shape[1]]) ** 2).sum(1)
        m += b.shape[1]
        limit = bound * m / d * (1 + EPSILON / math.sqrt(m)) ** 2 if m < d else bound * (1 + 1e-9) + 1e-12
        keep = part <= limit
        alive, part = alive[keep], part[keep]
        if len(alive) >= k and m < d:
            # those with the least partial distances set a new bound once known in full
            lead = alive[np.argpartition(part, k - 1)[:k]]
            full = sum(((x[lead] - query[a : a + x.shape[1]]) ** 2).sum(1) for a, x in zip(range(0, d, BLOCK), blocks))
            bound = min(bound, float(full.max()))
    return alive


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, which is exact, so that no square over- or underflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines in double precision on the vectors as they are.

    Each row is summed by itself in one fixed order, so that a score is a function of the two vectors
    whatever stands beside them, and the same for both orders of the pair.
    """
    q, c = np.ascontiguousarray(_scaled(q[None])), np.ascontiguousarray(_scaled(c))
    return np.clip((c * q).sum(1) / np.sqrt((c * c).sum(1) * (q * q).sum(1)), -1.0, 1.0)


def _search(d: int, k: int):
    turn = rotation(d)

    def run(key, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64", "score": "float64"})
        c = np.frombuffer(b"".join(candidates["vec"]), float).reshape(-1, d)
        q = np.frombuffer(b"".join(queries["vec"]), float).reshape(-1, d)
        turned = unit(c) @ turn
        blocks = [np.ascontiguousarray(turned[:, a : a + BLOCK]) for a in range(0, d, BLOCK)]
        ids = candidates["id"].to_numpy()
        out = []
        for name, v, t in zip(queries["query"], q, unit(q) @ turn):
            alive = scan(t, blocks, d, k)
            s = cosine(v, c[alive])
            best = np.lexsort((ids[alive], -s))[:k]
            out.append((np.full(len(best), name), ids[alive][best], s[best]))
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("query", "id", "score"), zip(*out))})

    return run


def nearest(spark: SparkSession, vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id ``every`` divides.

    Vectors that are null, zero, hold a null or a value that isn't finite, or differ from the commonest length
    take no part. Ties go to the smaller id. Ids are taken as distinct; rows that
    repeat an id are candidates as often as their vectors differ.
    """
    ws = Workspace(spark, "ann")
    ok = valid(vectors)
    sizes = ok.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0].d
    ok = ok.where(F.size("embedding") == d)
    parts = ok.mapInArrow(_classes, "v1 long, v2 long, vec binary, ids array<long>")
    keep = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, KEEP)
    classes = ws.save(parts.groupBy("v1", "v2").agg(F.first("vec").alias("vec"), keep.alias("ids")).withColumn("id", F.get("ids", F.lit(0))), "classes")
    asked = ws.save(ok.where(F.col("vec_id") % every == 0).mapInArrow(_keys, "vec_id long, v1 long, v2 long"), "asked")
    n = ws.rows["classes"]
    sample = first_by_hash(classes, "id", SAMPLE, n).select("vec").toPandas()
    rows = unit(np.frombuffer(b"".join(sample["vec"]), float).reshape(-1, d))
    lists = Lists(rows, round(math.sqrt(n)))
    probed = lists_to_probe(rows, lists, k)

    def near(count: int):
        def run(batches):
            for batch in batches:
                x = unit(np.frombuffer(b"".join(batch.column("vec").to_pylist()), float).reshape(-1, d))
                yield pa.record_batch([batch.column("id"), batch.column("vec"), pa.array(list(lists.orders(x, count)), pa.list_(pa.int32()))], names=["id", "vec", "lists"])

        return run

    kind = "id long, vec binary, lists array<int>"
    listed = ws.save(classes.select("id", "vec").mapInArrow(near(1), kind).select("id", "vec", F.get("lists", F.lit(0)).alias("list")), "listed")
    query_classes = asked.select("v1", "v2").distinct().join(classes, ["v1", "v2"]).select("id", "vec")
    query = ws.save(query_classes.mapInArrow(near(probed), kind).select(F.col("id").alias("query"), "vec", F.explode("lists").alias("list")), "queries")
    # one row a list, LISTS * REMAINDERS at most
    cuts = listed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).join(query.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("rounds")), "list")
    cuts = F.broadcast(cuts)
    c = listed.join(cuts, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    q = query.join(cuts, "list").withColumn("round", F.pmod(F.xxhash64("query"), F.col("rounds")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["list", "part", "round"]
    found = c.select(*key, "id", "vec").groupBy(*key).cogroup(q.select(*key, "query", "vec").groupBy(*key)).applyInPandas(_search(d, k + 1), "query long, id long, score double")
    turn = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(turn)).where(F.col("n") <= k + 1).select("query", "id", "score")
    # ids of the k + 1 best classes of a query class: (k + 1) * KEEP at most
    ids = best.join(classes.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    ids = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    to = asked.join(classes.select("v1", "v2", F.col("id").alias("query")), ["v1", "v2"]).select("query", F.col("vec_id").alias("query_id")).distinct()
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = to.join(ids, "query").select("query_id", F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
