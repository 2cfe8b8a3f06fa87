"""Verified near-duplicate classes from band buckets, without all pairs of a bucket.

A bucket's hub is the member that meets most others over all buckets, so of a
text and its edited copies it is the text. First every member is compared with
its buckets' hubs, and the verified pairs make components. A hub's members that are in
its component are settled: more links among them can't change the classes. The
others ("outliers") may still be like a member of another component. What the hub's text and a
member share, and the member's elements beyond the hub's, are known from the first step. A pair is
similar if it shares t / (1 + t) of the sum of its sizes, so if either of it shares less with the
hub, it must have an element beyond the hub's in common; which lookalikes that share a form letter
and little else don't have. Outliers and members that neither have one in common with a member of another component, nor
share so much with the hub that they need none, are done. The rest meet in blocks of bounded size, a member against a whole
block of outliers at once; only links leave the block. So every pair that shares a bucket is
in one component, has been compared, or can't be similar, whatever the size of the bucket.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, slices

WORDS = 5
SIMILARITY = 0.8
#: Pairs of one pivot that go to a task together; its text is sent once for each so many.
PER_TASK = 256
#: Members of a hub, and outliers, that one task compares.
MEMBERS, OUTLIERS = 512, 64
#: Shingles of a text that counts once among these; a longer one counts more.
USUAL = 1_000


# --- words and shingles ------------------------------------------------------------------------

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of every element."""
    x = x + _M3
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of all texts, and the offsets of each text's."""
    import xxhash

    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    table, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in table), np.uint64, len(table))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if "" in table:
        # a text without words splits into one empty word
        keep = codes != table.index("")
        codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    return hashed[codes], offsets


def shingles(words: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text and their offsets; a shorter text is one run, an empty one none."""
    sizes = np.diff(offsets)
    counts = np.where(sizes == 0, 0, np.maximum(1, sizes - n + 1))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    run = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        run = mix(run ^ words[k : k + len(run)])
    doc = np.repeat(np.arange(len(sizes)), counts)
    at = offsets[:-1][doc] + np.arange(len(doc)) - out_offsets[:-1][doc]
    short = sizes[doc] < n
    out = np.empty(len(doc), np.uint64)
    out[~short] = run[at[~short]]
    for i in np.flatnonzero(short):
        h = np.uint64(0)
        for w in words[offsets[doc[i]] : offsets[doc[i] + 1]]:
            h = mix(np.array([h ^ w]))[0]
        out[i] = h ^ np.uint64(sizes[doc[i]])
    return out, out_offsets


def bag(text: str, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, ascending, and how often each occurs."""
    return np.unique(shingles(*word_hashes(pa.array([text])), n)[0], return_counts=True)


def multiset_jaccard(a, b) -> float:
    """Sum of least counts over sum of greatest; two empty multisets are equal."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum())
    return 1.0 if not total else least / (total - least)


def set_jaccard(a, b) -> float:
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    total = len(a[0]) + len(b[0])
    return 1.0 if not total else common / (total - common)


def beyond(hub, b) -> tuple[int, np.ndarray]:
    """How many elements two bags share, and those of b beyond the hub's; of a multiset the n-th occurrence of a shingle is an element."""
    at = np.minimum(np.searchsorted(hub[0], b[0]), max(len(hub[0]) - 1, 0))
    held = np.where(hub[0][at] == b[0], hub[1][at], 0) if len(hub[0]) else np.zeros(len(b[0]), np.int64)
    least = np.minimum(held, b[1])
    more = b[1] - least
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + np.repeat(least, more)
    return int(least.sum()), mix(np.repeat(b[0], more) + nth.astype(np.uint64) * _M3)


# --- verification --------------------------------------------------------------------------------

_SEEN = "a long, b long, sim double, size long, common long, beyond array<long>"


def _compare(multiset: bool):
    def run(batches):
        # texts of a pivot come one after the other; a bounded number of bags is kept
        known: OrderedDict[int, tuple] = OrderedDict()
        for batch in slices(batches, "text", 2 << 20):
            out = [[], [], []]
            rest = [np.empty(0, np.uint64)]
            for a, pivot_text, own in zip(batch.column("a").to_pylist(), batch.column("pivot_text"), _bags(batch.column("text"), multiset)):
                if a not in known:
                    known[a] = _bags(pa.array([pivot_text.as_py()], pa.string()), multiset)[0]
                    if len(known) > 8:
                        known.popitem(last=False)
                hub = known[a]
                common, more = beyond(hub, own)
                size = int(own[1].sum())
                total = size + int(hub[1].sum()) - common
                for column, v in zip(out, (common / total if total else 1.0, size, common)):
                    column.append(v)
                rest.append(more)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rest[1:])]).astype(np.int32)), pa.array(np.concatenate(rest).view(np.int64)))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(out[0], pa.float64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), lists], names=[c.split(" ")[0] for c in _SEEN.split(", ")])

    return run


def verify(ws: Workspace, pairs: DataFrame, total: int, units: DataFrame, name: str, multiset: bool = True) -> DataFrame:
    """Saved pairs (a pivot, b) with their exact similarity, b's size, what it shares with the pivot, and its elements beyond the pivot's.

    A pivot may have any number of partners: its pairs are salted, and its text is sent
    once for each salt.
    """
    count = ws.save(pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PER_TASK).cast("int").alias("salts")), f"{name}_count")
    dealt = ws.meet(pairs, f"{name}_count", ["a"], ["b"], total).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).select("a", "b", "salt")
    with_text = dealt.join(units.select(F.col("id").alias("b"), "text"), "b")
    pivots = count.join(units.select(F.col("id").alias("a"), F.col("text").alias("pivot_text")), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "pivot_text")
    both = with_text.join(pivots, ["a", "salt"]).select("a", "b", "pivot_text", "text")
    out = ws.save(both.mapInArrow(_compare(multiset), _SEEN), name)
    ws.drop(f"{name}_count")
    return out


def _survivors(ws: Workspace, state: DataFrame, threshold: float, name: str) -> DataFrame:
    """hub, id, component, outlying and size of the members that may be similar to one of another component, one of both an outlier."""
    outlying = F.col("component") != F.col("main")
    hubs = state.where(outlying).select("hub").distinct()
    members = ws.save(state.join(hubs, "hub", "left_semi").withColumn("outlying", outlying), f"{name}_members")
    each = members.select("hub", "id", "component", "outlying", F.explode("beyond").alias("e"))
    live = each.groupBy("hub", "e").agg(F.count("*").alias("n"), F.max("outlying").alias("any"), F.min("component").alias("low"), F.max("component").alias("high")).where("any and low <> high").select("hub", "e", "n")
    ws.save(live, f"{name}_live")
    total = members.agg(F.sum(F.size("beyond"))).first()[0] or 0
    sharing = ws.meet(each.select("hub", "e", "id"), f"{name}_live", ["hub", "e"], ["id"], total).select("hub", "id").distinct()
    # Those that share enough with the hub to be similar without. X may be like texts of up to common / part - size only; if that
    # is less than its own size for both of a pair, each would have to be longer than the other. So one of a pair
    # shares 2 * part of itself with the hub, and the least such size bounds what an outlier may meet.
    part = threshold / (1 + threshold)
    reaches = lambda other: other.isNotNull() & (F.col("common") + 1e-6 >= part * (F.col("size") + F.greatest(threshold * F.col("size"), other)))
    core = F.when(F.col("common") + 1e-6 >= 2 * part * F.col("size"), F.col("size"))
    ws.save(members.groupBy("hub").agg(F.count("*").alias("n"), F.min(core).alias("least")), f"{name}_least")
    inner = ws.save(ws.meet(members.drop("beyond"), f"{name}_least", ["hub"], ["id"], ws.rows[f"{name}_members"]).withColumn("inner", F.col("outlying") & reaches(F.col("least"))), f"{name}_inner")
    ws.save(inner.groupBy("hub").agg(F.count("*").alias("n"), F.min(F.when(F.col("inner"), F.col("size"))).alias("first")), f"{name}_few")
    out = ws.meet(ws.load(f"{name}_inner"), f"{name}_few", ["hub"], ["id"], ws.rows[f"{name}_members"]).join(sharing.withColumn("shares", F.lit(True)), ["hub", "id"], "left")
    out = out.where(F.coalesce("shares", F.col("inner") | reaches(F.col("first"))))
    out = ws.save(out.select("hub", "id", "component", "outlying", "size"), f"{name}_left")
    ws.drop(*(f"{name}_{x}" for x in ("members", "live", "least", "inner", "few")))
    return out


# --- classes --------------------------------------------------------------------------------------


def _overlaps(bags: list[tuple], pooled: np.ndarray, start: np.ndarray, owner: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(bags, n) sums of least counts with each of n pooled bags; of shingle pooled[i] they are owner and count from start[i] on."""
    out = np.zeros((len(bags), n), np.int64)
    for row, (values, counts) in zip(out, bags):
        at = np.searchsorted(pooled, values)
        at[at == len(pooled)] = 0
        hit = np.flatnonzero(pooled[at] == values)
        first, size = start[at[hit]], start[at[hit] + 1] - start[at[hit]]
        flat = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row += np.bincount(owner[flat], np.minimum(count[flat], np.repeat(counts[hit], size)), n).astype(np.int64)
    return out


def _bags(texts: pa.Array, multiset: bool) -> list[tuple]:
    hashed, offsets = shingles(*word_hashes(texts))
    out = []
    for a, b in zip(offsets, offsets[1:]):
        values, counts = np.unique(hashed[a:b], return_counts=True)
        out.append((values, counts if multiset else np.ones_like(counts)))
    return out


def _block(threshold: float, multiset: bool):
    def run(key, members: pd.DataFrame, outliers: pd.DataFrame) -> pd.DataFrame:
        found = {"a": [], "b": [], "sim": []}
        if len(members) and len(outliers):
            right = _bags(pa.array(outliers["text"], pa.string()), multiset)
            values = np.concatenate([v for v, _ in right])
            order = np.argsort(values, kind="stable")
            pooled, start = np.unique(values[order], return_index=True)
            start = np.append(start, len(values))
            owner = np.repeat(np.arange(len(right)), [len(v) for v, _ in right])[order]
            count = np.concatenate([c for _, c in right])[order]
            totals = np.array([c.sum() for _, c in right])
            left = _bags(pa.array(members["text"], pa.string()), multiset)
            least = _overlaps(left, pooled, start, owner, count, len(right))
            sims = least / np.maximum(np.array([c.sum() for _, c in left])[:, None] + totals - least, 1)
            apart = members["component"].to_numpy()[:, None] != outliers["component"].to_numpy()
            i, j = np.nonzero((sims >= threshold) & apart)
            found = {"a": outliers["id"].to_numpy()[j], "b": members["id"].to_numpy()[i], "sim": sims[i, j]}
        return pd.DataFrame(found).astype({"a": "int64", "b": "int64", "sim": "float64"})

    return run


def classes(ws: Workspace, buckets: DataFrame, units_of, threshold: float = SIMILARITY, multiset: bool = True, name: str = "nd"):
    """Components of verified pairs among ids that share a bucket.

    buckets: (key long, id long). units_of: called with a table of the ids that meet
    another in some bucket, gives (id, text) of these. Returns (id, component)
    for ids with a link, and the links (a, b, sim) that were verified to find them.
    """
    total = buckets.count()
    ws.save(buckets.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("size")).where("n > 1"), f"{name}_sizes")
    met = ws.save(ws.meet(buckets, f"{name}_sizes", ["key"], ["id"], total), f"{name}_met")
    degree = met.groupBy("id").agg(F.sum("size").alias("degree"))
    most = F.max(F.struct("degree", (-F.col("id")).alias("id")))
    ws.save(met.select("key", "id").join(degree, "id").groupBy("key").agg((-most.getField("id")).alias("hub"), F.count("*").alias("n")), f"{name}_hubs")
    met_again = ws.load(f"{name}_met").select("key", "id")
    pairs = ws.save(ws.meet(met_again, f"{name}_hubs", ["key"], ["id"], ws.rows[f"{name}_met"]).where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), f"{name}_pairs")
    units = ws.save(units_of(degree.select("id")), f"{name}_units")
    ws.drop(f"{name}_sizes", f"{name}_met", f"{name}_hubs")
    seen = verify(ws, pairs, ws.rows[f"{name}_pairs"], units, f"{name}_seen", multiset)
    links = seen.where(F.col("sim") >= threshold).select("a", "b", "sim")
    cc = components(ws, links.select("a", "b"), f"{name}_cc_0")
    label = lambda c, i: F.coalesce(F.col(c), F.col(i))
    of_hub = seen.groupBy("a").agg(F.count("*").alias("n")).join(cc.select(F.col("id").alias("a"), F.col("component").alias("main")), "a", "left")
    ws.save(of_hub, f"{name}_of_hub")
    state = ws.meet(seen.join(cc.withColumnRenamed("id", "b"), "b", "left"), f"{name}_of_hub", ["a"], ["b"], ws.rows[f"{name}_seen"])
    state = ws.save(state.select(F.col("a").alias("hub"), F.col("b").alias("id"), label("component", "b").alias("component"), label("main", "a").alias("main"), "size", "common", "beyond"), f"{name}_state")
    # the hub itself has met all its members
    if not state.where("component <> main").limit(1).count():
        ws.drop(*(f"{name}_{x}" for x in ("pairs", "units", "of_hub", "state")))
        return cc, links
    left = _survivors(ws, state, threshold, name)
    weight = F.sum(F.greatest(F.lit(1.0), F.col("size") / USUAL))
    cuts = left.groupBy("hub").agg(F.count("*").alias("n"), F.ceil(weight / MEMBERS).cast("int").alias("parts"), F.ceil(F.sum(F.when(F.col("outlying"), F.greatest(F.lit(1.0), F.col("size") / USUAL)).otherwise(0.0)) / OUTLIERS).cast("int").alias("blocks"))
    ws.save(cuts.where("blocks > 0 and n > 1"), f"{name}_cuts")
    both = ws.save(ws.meet(left.select("hub", "id", "component", "outlying"), f"{name}_cuts", ["hub"], ["id"], ws.rows[f"{name}_left"]), f"{name}_dealt")
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["hub", "part", "block"]
    members = both.withColumn("part", number("parts")).withColumn("block", every("blocks")).join(units, "id").select(*key, "id", "component", "text")
    outliers = ws.load(f"{name}_dealt").where("outlying").withColumn("block", number("blocks")).withColumn("part", every("parts")).join(ws.load(f"{name}_units"), "id").select(*key, "id", "component", "text")
    more = members.groupBy(*key).cogroup(outliers.groupBy(*key)).applyInPandas(_block(threshold, multiset), "a long, b long, sim double")
    more = ws.save(more, f"{name}_more")
    links = ws.save(links.unionAll(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").dropDuplicates(["a", "b"]), f"{name}_links")
    if ws.rows[f"{name}_more"]:
        cc = components(ws, links.select("a", "b"), f"{name}_cc_1")
    ws.drop(*(f"{name}_{x}" for x in ("pairs", "units", "seen", "of_hub", "state", "left", "cuts", "dealt", "more")))
    return cc, links
