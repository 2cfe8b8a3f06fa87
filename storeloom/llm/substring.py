"""Repeated passages by paragraph MinHash banding (operator 6).

A paragraph is a line of the text. Paragraphs of at least ``LEAST_WORDS`` words are sketched by
``BANDS`` x ``ROWS`` MinHashes of their runs of five words (bands tuned for a recall
of 0.998 at similarity 0.8), joined where a band collides, verified by exact Jaccard
similarity, and clustered by components. Of a cluster the first place, by doc_id and
position, stays; all others are removals.

Passages also repeat within paragraphs that differ as a whole, and across lines. So every
run of ``RUN`` words is a passage too, with one MinHash as its band: each window of RUN words
picks the least hash of its runs of ``GRAM`` words, so equal windows pick the same one, and
windows whose picks collide are verified by their whole word sequence (lower case). Windows in a
row with one pick are a range. A range that stands earlier goes as a whole; of ranges that share their
pick only, the single windows are compared. Windows in a row with one shift against
one document are a run, as long as it is equal. A window that overlaps its own first place stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices, texts
from .neardup import SIMILARITY, classes, mix, shingles, word_hashes

BANDS, ROWS = 12, 4
LEAST_WORDS = 12
#: Words of the shortest run that is found wherever it stands, and of the runs that its windows pick from.
RUN, GRAM = 50, 16
#: Rows of the table of units: units, ranges, and the line offsets of documents of RUN words.
UNIT, RANGE, LINES = 0, 1, 2
_ODD = np.uint64(0xD1B54A32D192ED03)
_UNITS = "doc_id long, line int, first int, end int, h1 long, h2 long, keys array<long>, kind int, lo int, hi int"


def min_hashes(hashed: np.ndarray, offsets: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """(texts, n) least values of n hash functions over the shingles of each text (every text has one at least)."""
    rng = np.random.default_rng(20_240_229)
    out = np.empty((len(offsets) - 1, n), np.uint32)
    factor = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    # runs of texts whose shingles fit the cache
    starts = offsets[:-1]
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 32_768, "right")) - 1)
        part, at = hashed[offsets[a] : offsets[b]], starts[a:b] - offsets[a]
        for k in range(n):
            high = (part * factor[k] >> np.uint64(32)).astype(np.uint32)
            out[a:b, k] = np.minimum.reduceat(high, at)
        a = b
    return out


def _run_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each range of words: sums over the words mixed with their places."""
    sizes = stop - start
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = words[np.repeat(start, sizes) + place]
    out = []
    for salt in (1, 2):
        mixed = mix(mix(flat + np.uint64(salt)) ^ place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        out.append(mix(total[at[1:]] - total[at[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return out


def _runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of GRAM and of RUN words from each word on."""
    n = len(words) - RUN + 1
    hashed, size = {1: words}, 1
    while size < 32:
        hashed[2 * size] = mix(hashed[size][:-size] * _ODD + hashed[size][size:])
        size *= 2
    return hashed[GRAM], mix(mix(hashed[32][:n] * _ODD + hashed[16][32 : 32 + n]) * _ODD + hashed[2][48 : 48 + n])


def ranges(words: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of windows with one pick: document, first and last window's first word, hash of the range and of the pick."""
    none = np.empty(0, np.int64)
    if len(words) < RUN:
        return none, none, none, none, none
    grams, windows = _runs(words)
    doc = np.repeat(np.arange(len(doc_at) - 1), np.diff(doc_at))
    starts = np.flatnonzero(doc[: len(windows)] == doc[RUN - 1 :])
    if not len(starts):
        return none, none, none, none, none
    # of equal hashes the leftmost: the place is the key's low part
    bits = np.uint64(max(24, len(words).bit_length()))
    least = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)
    size, width = 1, RUN - GRAM + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(windows)], least[width - size : width - size + len(windows)])
    pick = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)[starts]
    edge = np.flatnonzero((np.diff(pick) != 0) | (np.diff(starts) != 1))
    a, b = np.concatenate([[0], edge + 1]), np.append(edge, len(starts) - 1)
    lo, hi = starts[a], starts[b]
    # the first and the last window cover the range
    whole = mix(windows[lo] * _ODD + windows[hi] + (hi - lo).astype(np.uint64))
    return doc[lo], lo, hi, whole.view(np.int64), grams[pick[a]].view(np.int64)


def _lines_of(batch: pa.RecordBatch):
    """Lines of each document, the words of all, offsets of each line's and of each document's."""
    lists = pc.split_pattern(batch.column("text"), "\n")
    per_doc = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words, at = word_hashes(lists.flatten())
    return per_doc, words, at, at[np.concatenate([[0], np.cumsum(per_doc)])]


def _place(word: np.ndarray, at: np.ndarray, per_doc: np.ndarray, doc: np.ndarray) -> list[pa.Array]:
    """Line in its document, and place in the line, of words of all lines."""
    line = np.searchsorted(at, word, "right") - 1
    return [pa.array((line - (np.cumsum(per_doc) - per_doc)[doc]).astype(np.int32)), pa.array((word - at[line]).astype(np.int32))]


def units(docs: DataFrame) -> DataFrame:
    """Rows of three kinds.

    UNIT: doc_id, line, first and end word of a paragraph, the words' 128-bit hash (h1, h2), and its band keys.
    RANGE: first word's line and place in it, lo and hi (first words of its windows, from the document's begin), its hash h1 and its pick's h2.
    LINES: in keys, how many words of the document stand before each line, and in all.
    """
    names = [c.split(" ")[0] for c in _UNITS.split(", ")]

    def rows(kind, columns, n):
        held = dict(columns) | {"kind": pa.array(np.full(n, kind, np.int32))}
        types = {"doc_id": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "keys": pa.list_(pa.int64())}
        return pa.record_batch([held.get(c, pa.nulls(n, types.get(c, pa.int32()))) for c in names], names=names)

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            per_doc, words, at, doc_at = _lines_of(batch)
            ids = batch.column("doc_id")
            doc, lo, hi, whole, pick = ranges(words, doc_at)
            if len(doc):
                line, place = _place(lo, at, per_doc, doc)
                yield rows(RANGE, {"doc_id": ids.take(pa.array(doc)), "line": line, "first": place, "h1": pa.array(whole), "h2": pa.array(pick), "lo": pa.array((lo - doc_at[doc]).astype(np.int32)), "hi": pa.array((hi - doc_at[doc]).astype(np.int32))}, len(doc))
                held = np.flatnonzero(np.diff(doc_at) >= RUN)
                n = per_doc[held] + 1
                begin = np.cumsum(n) - n
                flat = np.repeat((np.cumsum(per_doc) - per_doc)[held] - begin, n) + np.arange(n.sum())
                before = at[flat] - np.repeat(doc_at[held], n)
                yield rows(LINES, {"doc_id": ids.take(pa.array(held)), "keys": pa.ListArray.from_arrays(pa.array(np.append(begin, n.sum()).astype(np.int32)), pa.array(before))}, len(held))
            sizes = np.diff(at)
            whole = np.flatnonzero(sizes >= LEAST_WORDS)
            if not len(whole):
                continue
            h1, h2 = _run_hashes(words, at[whole], at[whole + 1])
            n = sizes[whole]
            picked = np.repeat(at[whole] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sketch = min_hashes(*shingles(words[picked], np.concatenate([[0], np.cumsum(n)]))).reshape(len(whole), BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sketch.shape[:2]).copy()
            for k in range(ROWS):
                key = mix(key ^ sketch[:, :, k].astype(np.uint64))
            doc = np.repeat(np.arange(len(per_doc)), per_doc)[whole]
            line = whole - (np.cumsum(per_doc) - per_doc)[doc]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32) * BANDS), pa.array(key.view(np.int64).reshape(-1)))
            columns = {"doc_id": ids.take(pa.array(doc)), "line": pa.array(line.astype(np.int32)), "first": pa.array(np.zeros(len(whole), np.int32)), "end": pa.array(n.astype(np.int32)), "h1": pa.array(h1), "h2": pa.array(h2), "keys": keys}
            yield rows(UNIT, columns, len(whole))

    return texts(docs).mapInArrow(run, _UNITS)


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every window of the wanted ranges: its hash, doc_id, lo (first word), line and first."""

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            per_doc, words, at, doc_at = _lines_of(batch)
            found = batch.column("cuts")
            doc = np.repeat(np.arange(len(batch)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
            lo, hi = (found.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) + doc_at[doc] for c in ("lo", "hi"))
            size = hi - lo + 1
            word = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            doc = np.repeat(doc, size)
            line, place = _place(word, at, per_doc, doc)
            columns = [pa.array(_runs(words)[1][word].view(np.int64)), batch.column("doc_id").take(pa.array(doc)), pa.array((word - doc_at[doc]).astype(np.int32)), line, place]
            yield pa.record_batch(columns, names=["h", "doc_id", "lo", "line", "first"])

    cuts = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts"))
    return texts(docs).join(cuts, "doc_id").mapInArrow(run, "h long, doc_id long, lo int, line int, first int")


def _pieces(batches):
    """Joins the later windows of each document to runs, and cuts these at lines; what ``gone`` covers is left out."""
    for batch in batches:
        if not len(batch):
            continue
        found, before, gone = (batch.column(c) for c in ("found", "before", "gone"))
        doc = np.repeat(np.arange(len(batch)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
        lo, stop, keep, start, line, first = (found.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "stop", "keep_doc_id", "keep_lo", "keep_line", "keep_first"))
        order = np.lexsort((lo, start - lo, keep, doc))
        doc, lo, stop, keep, start, line, first = (x[order] for x in (doc, lo, stop, keep, start, line, first))
        new = np.append(True, (np.diff(doc) != 0) | (np.diff(keep) != 0) | (np.diff(start - lo) != 0) | (lo[1:] > stop[:-1]))
        last = np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)
        stop = stop[last]
        doc, lo, keep, line, first = (x[new] for x in (doc, lo, keep, line, first))
        # all documents' words one after the other, so line offsets ascend
        per_doc = pc.list_value_length(before).to_numpy(zero_copy_only=False).astype(np.int64)
        at = before.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(per_doc)
        sizes = at[ends - 1]
        base = np.cumsum(sizes) - sizes
        at = at + np.repeat(base, per_doc)
        lo, stop = lo + base[doc], stop + base[doc]
        order = np.lexsort((-stop, lo))
        doc, lo, stop, keep, line, first = (x[order] for x in (doc, lo, stop, keep, line, first))
        outer = np.append(True, stop[1:] > np.maximum.accumulate(stop)[:-1])
        doc, lo, stop, keep, line, first = (x[outer] for x in (doc, lo, stop, keep, line, first))
        g_doc = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))
        g_line, g_first, g_end = (gone.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("line", "first", "end"))
        g_at = at[(ends - per_doc)[g_doc] + g_line]
        edges = np.bincount(g_at + g_first, minlength=sizes.sum() + 1) - np.bincount(g_at + g_end, minlength=sizes.sum() + 1)
        covered = np.append(0, np.cumsum(np.cumsum(edges) > 0))
        a = np.searchsorted(at, lo, "right") - 1
        n = np.searchsorted(at, stop - 1, "right") - a
        which = np.repeat(np.arange(len(lo)), n)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[which]
        # the entry after a document's last line is its end
        following = at[np.minimum(part + 1, len(at) - 1)]
        left, right = np.maximum(at[part], lo[which]), np.minimum(following, stop[which])
        new = (right > left) & (covered[right] - covered[left] < right - left)
        which, part, left, right = which[new], part[new], left[new], right[new]
        doc = doc[which]
        columns = [batch.column("doc_id").take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in (part - (ends - per_doc)[doc], left - at[part], right - at[part])), pa.array(keep[which]), *(pa.array(x[which].astype(np.int32)) for x in (line, first))]
        yield pa.record_batch(columns, names=["doc_id", "line", "first", "end", "keep_doc_id", "keep_line", "keep_first"])


def _later_runs(ws: Workspace, docs: DataFrame, found: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows like those of ``repeats`` for runs of RUN words and more that ``gone`` doesn't hold already."""
    every = found.where(F.col("kind") == RANGE).select("doc_id", "line", "first", "h1", "h2", "lo", "hi")
    place = F.min(F.struct("doc_id", "lo", "line", "first")).alias("keep")
    again = (F.col("doc_id") != F.col("keep.doc_id")) | (F.col("lo") - F.col("keep.lo") >= RUN)
    keep = [F.col(f"keep.{c}").alias(f"keep_{c}") for c in ("doc_id", "lo", "line", "first")]
    count = F.count("*").alias("n")
    total = ws.rows["units"]
    ws.save(every.groupBy("h2").agg(count, (F.min("h1") != F.max("h1")).alias("mixed")).where("n > 1"), "picks")
    met = ws.save(ws.meet(every, "picks", ["h2"], ["doc_id", "lo"], total), "ranges")
    ws.save(met.groupBy("h1", "h2").agg(count, place), "kept")
    met = ws.save(ws.meet(ws.load("ranges"), "kept", ["h1", "h2"], ["doc_id", "lo"], ws.rows["ranges"]).withColumn("again", again), "ranges_kept")
    ws.drop("picks", "ranges", "kept")
    whole = met.where("again").select("doc_id", "lo", (F.col("hi") + RUN).alias("stop"), *keep)
    windows = ws.save(_windows(docs, met.where("mixed and not again").select("doc_id", "lo", "hi")), "windows")
    ws.save(windows.groupBy("h").agg(count, place).where("n > 1"), "twice")
    single = ws.meet(ws.load("windows"), "twice", ["h"], ["doc_id", "lo"], ws.rows["windows"]).where(again).select("doc_id", "lo", (F.col("lo") + RUN).alias("stop"), *keep)
    later = whole.unionAll(single).groupBy("doc_id").agg(F.collect_set(F.struct("lo", "stop", "keep_doc_id", "keep_lo", "keep_line", "keep_first")).alias("found"))
    lines = found.where(F.col("kind") == LINES).select("doc_id", F.col("keys").alias("before")).dropDuplicates(["doc_id"])
    removed = gone.groupBy("doc_id").agg(F.collect_list(F.struct("line", "first", "end")).alias("gone"))
    out = later.join(lines, "doc_id").join(removed, "doc_id", "left").select("doc_id", "found", "before", "gone")
    out = out.mapInArrow(_pieces, "doc_id long, line int, first int, end int, keep_doc_id long, keep_line int, keep_first int")
    return out.select("doc_id", "line", "first", "end", F.xxhash64("keep_doc_id", "keep_line", "keep_first").alias("cluster"), F.lit(1.0).alias("similarity"), "keep_doc_id", "keep_line", "keep_first")


def repeats(spark: SparkSession, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per removal: doc_id, line, first, end (words, end exclusive), cluster, similarity, keep_doc_id, keep_line, keep_first.

    cluster names the component; keep_* are its first place; similarity is the largest verified Jaccard similarity
    of the paragraph to another of its cluster (1 for equal ones and for runs). Paragraphs under the least
    number of words take part in runs of RUN words only. Of such a run each line that
    isn't removed already is a row, and keep_* is where the run begins at its first place; null and empty texts have none;
    rows that repeat a doc_id count as places of it.
    """
    ws = Workspace(spark, "repeats")
    table = ws.save(units(docs), "units")
    found = table.where(F.col("kind") == UNIT).drop("kind", "lo", "hi")
    buckets = ws.save(found.select(F.explode("keys").alias("key"), F.col("h1").alias("id")).distinct(), "buckets")

    def units_of(ids: DataFrame) -> DataFrame:
        places = found.select(F.col("h1").alias("id"), "doc_id", "line").dropDuplicates(["id"]).join(ids, "id", "left_semi")
        wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("id", "line")).alias("cuts"))
        cut = texts(docs).join(wanted, "doc_id").select(F.split("text", "\n").alias("lines"), F.explode("cuts").alias("c"))
        return cut.select("c.id", F.get("lines", F.col("c.line")).alias("text")).dropDuplicates(["id"])

    cc, links = classes(ws, buckets, units_of, threshold, multiset=False)
    near = links.select(F.explode(F.array("a", "b")).alias("h1"), "sim").groupBy("h1").agg(F.max("sim").alias("sim"))
    label = ws.save(cc.withColumnRenamed("id", "h1").join(near, "h1"), "components")
    ws.drop("buckets")
    # word sequences that occur twice, and those of components
    place = F.min(F.struct("doc_id", "line")).alias("place")
    sequences = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), place).join(label, "h1", "left").where("n > 1 or component is not null")
    sequences = sequences.select("h1", "h2", "n", "place", F.coalesce("component", "h1").alias("cluster"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(0).alias("part"), F.when(F.col("n") > 1, 1.0).otherwise(F.col("sim")).alias("similarity"))
    sequences = ws.save(sequences, "sequences")
    ws.save(sequences.groupBy("cluster", "part").agg(F.count("*").alias("n"), F.min("place").alias("keep")), "clusters")
    kept = ws.meet(ws.load("sequences").withColumnRenamed("n", "places"), "clusters", ["cluster", "part"], ["h1", "h2"], ws.rows["sequences"])
    ws.save(kept.select("h1", "h2", F.col("places").alias("n"), "cluster", "similarity", "keep"), "sequences_kept")
    # a word sequence may hold any share of the places
    out = ws.meet(found.drop("keys"), "sequences_kept", ["h1", "h2"], ["doc_id", "line"], ws.rows["units"])
    other = (F.col("doc_id") != F.col("keep.doc_id")) | (F.col("line") != F.col("keep.line"))
    out = out.where(other).select("doc_id", "line", "first", "end", "cluster", "similarity", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"), F.lit(0).alias("keep_first"))
    out = ws.save(out, "removals")
    ws.drop("sequences", "clusters", "sequences_kept", "components")
    runs = ws.save(_later_runs(ws, docs, table, out), "runs")
    ws.keep("removals", "runs")
    return out.unionAll(runs)


def remove(spark: SparkSession, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id and text without its removals; a line that loses all its words goes as a whole.

    Null texts are empty, rows that repeat a doc_id lose each other's removals too, other columns are ignored. A line that
    loses some of its words has the rest parted by single spaces.
    """
    cuts = repeats(spark, docs, threshold).groupBy("doc_id").agg(F.collect_list(F.struct("line", "first", "end")).alias("cuts"))

    def run(batches):
        for batch in slices(batches):
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                lines, gone = text.split("\n"), {}
                for c in found or ():
                    gone.setdefault(c["line"], set()).update(range(c["first"], c["end"]))
                kept = []
                for i, line in enumerate(lines):
                    words = line.split()
                    left = [w for k, w in enumerate(words) if k not in gone.get(i, ())]
                    if len(left) == len(words):
                        kept.append(line)
                    elif left:
                        kept.append(" ".join(left))
                out.append("\n".join(kept))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return texts(docs).join(cuts, "doc_id", "left").mapInArrow(run, "doc_id long, text string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
