"""Line deduplication by a distributed suffix array over line ids (operator 9).

The corpus is one sequence of line ids (hashes of the lines that aren't blank), cut at
document ends. Prefix doubling sorts its suffixes: after round k two suffixes
have one rank where their first 2^k lines are equal. A round range-partitions
(rank, rank 2^k lines on) with the place as the last sort key, so that a very
common line is spread over partitions; each partition is scanned once, and a row per partition tells
where its first and last groups begin. Suffixes alone in their group are
final and leave the sort; ranks of a document are one row's array, so the rank
2^k lines on is a look into the row and no join.

The groups of round k are the intervals of the suffix array whose common
prefixes are 2^k lines or longer; all but the first place of an interval are later copies of
it. Later places in a row whose first places are in a row too (one document, one shift)
are one repeat against that place, as long as it is equal: a chain of intervals that starts
with its first place's line and ends with the last of its windows. What the chains of all
depths leave that no longer one holds are the document's maximal repeats. A chain is
deleted if its lines have ``LEAST_CHARS`` characters in all, so a run of many short lines
may go where none of its lines or pairs of lines would.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices, texts

#: Characters (without white space at the ends of lines) of the shortest run that is deleted.
LEAST_CHARS = 10
_BLANK = " \t\r"
_REPEAT = "struct<start:int,size:int,first_doc:long,first:int>"
_STATE = f"doc_id long, th long, at array<int>, chars array<int>, rank array<long>, repeats array<{_REPEAT}>"
_SORT = ["r", "k1", "k2", "doc_id", "th", "pos"]
_SCANNED = "r long, doc_id long, th long, pos int, part int, idx long, g0 long, g1 long, same0 boolean, same1 boolean, next1 boolean, k1 long, k2 long, first_doc long, first_th long, first int"


def line_ids(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), and of its lines that aren't blank: at (line numbers), chars, h and g (128 bits of hash)."""

    def run(batches):
        import xxhash

        for batch in slices(batches):
            out = [[] for _ in range(4)]
            for text in batch.column("text").to_pylist():
                lines = text.split("\n")
                sizes = [len(line.strip(_BLANK)) for line in lines]
                at = [i for i, n in enumerate(sizes) if n]
                ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(lines[i]) for i in at), np.int64)
                for column, v in zip(out, (at, [sizes[i] for i in at], ids[::2], ids[1::2])):
                    column.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), *(pa.array(c, pa.list_(t)) for c, t in zip(out, kinds))], names=["doc_id", "th", "at", "chars", "h", "g"])

    keyed = texts(docs).withColumn("th", F.xxhash64("text"))
    found = keyed.mapInArrow(run, "doc_id long, th long, at array<int>, chars array<int>, h array<long>, g array<long>")
    # rows equal in doc_id and text are one document
    return found.dropDuplicates(["doc_id", "th"])


def _scan(batches):
    """Group starts of one sorted partition; a row is held back until its successor is known.

    first_* is where a row's group begins, null for the row that begins it, or where that is before the partition.
    """
    part, n, last0, last1, g0, g1, held = TaskContext.get().partitionId(), 0, None, None, 0, 0, None
    names = [c.split(" ")[0] for c in _SCANNED.split(", ")]
    start = None  # place where the last row's group begins
    for batch in batches:
        if not len(batch):
            continue
        r, k1, k2 = (batch.column(c).to_numpy() for c in ("r", "k1", "k2"))
        same0 = np.empty(len(r), bool)
        same1 = np.empty(len(r), bool)
        same0[1:] = r[1:] == r[:-1]
        same1[1:] = same0[1:] & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        same0[0] = last0 is not None and r[0] == last0
        same1[0] = last0 is not None and (r[0], k1[0], k2[0]) == (last0, *last1)
        idx = np.arange(n, n + len(r))
        start0 = np.maximum.accumulate(np.where(same0, g0, idx))
        start1 = np.maximum.accumulate(np.where(same1, g1, idx))
        # the place of a group that began in an earlier batch comes first
        places = [batch.column(c) if start is None else pa.concat_arrays([x, batch.column(c)]) for c, x in zip(("doc_id", "th", "pos"), start or (None,) * 3)]
        take = np.where(start1 >= n, start1 - n + (start is not None), 0)
        firsts = [x.take(pa.array(take, mask=~same1)) for x in places]
        start = [x.slice(int(take[-1]), 1) for x in places]
        n, g0, g1, last0, last1 = n + len(r), int(start0[-1]), int(start1[-1]), r[-1], (k1[-1], k2[-1])
        if held is not None:
            yield pa.record_batch([*held[:10], pa.array([bool(same1[0])]), *held[10:]], names=names)
        columns = [batch.column("r"), batch.column("doc_id"), batch.column("th"), batch.column("pos"), pa.array(np.full(len(r), part, np.int32)), pa.array(idx), pa.array(start0), pa.array(start1), pa.array(same0), pa.array(same1), batch.column("k1"), batch.column("k2"), *firsts]
        held = [c.slice(len(r) - 1) for c in columns]
        if len(r) > 1:
            body = [c.slice(0, len(r) - 1) for c in columns]
            yield pa.record_batch([*body[:10], pa.array(same1[1:]), *body[10:]], names=names)
    if held is not None:
        yield pa.record_batch([*held[:10], pa.array([False]), *held[10:]], names=names)


def _refine(ws: Workspace, rows: DataFrame, name: str) -> DataFrame:
    """New ranks of rows (r, k1, k2, doc_id, th, pos): doc_id, th, pos, rank, tied, later (not the first place of its group), and that first place."""
    spark = ws.spark
    ordered = rows.repartitionByRange(*_SORT).sortWithinPartitions(*_SORT)
    scanned = ws.save(ordered.mapInArrow(_scan, _SCANNED), name)
    first = F.min(F.struct("idx", "r", "k1", "k2", "doc_id", "th", "pos")).alias("first")
    last = F.max(F.struct("idx", "r", "k1", "k2", "g1", "same1", "doc_id", "th", "pos", "first_doc", "first_th", F.col("first").alias("first_pos"))).alias("last")
    ends = scanned.groupBy("part").agg(F.count("*").alias("n"), F.max("g0").alias("g0"), F.max("g1").alias("g1"), first, last).orderBy("part")
    # one row a partition
    carried, base, start0, start1, before, place = [], 0, 0, 0, None, None
    rows_ = ends.collect()
    for i, e in enumerate(rows_):
        on0 = before is not None and e.first.r == before.r
        on1 = before is not None and tuple(e.first)[1:4] == tuple(before)[1:4]
        follows = i + 1 < len(rows_) and tuple(rows_[i + 1].first)[1:4] == tuple(e.last)[1:4]
        # where the group begins that the partition's first row is in
        place = place if on1 else tuple(e.first)[4:7]
        carried.append((e.part, base, start0 if on0 else base, start1 if on1 else base, on1, follows, e.n - 1, *place))
        start0 = base + e.g0 if e.g0 else carried[-1][2]
        start1 = base + e.g1 if e.g1 else carried[-1][3]
        if e.last.g1:
            place = tuple(e.last)[9:12] if e.last.same1 else tuple(e.last)[6:9]
        base, before = base + e.n, e.last
    carry = spark.createDataFrame(carried, "part int, base long, first0 long, first1 long, on1 boolean, follows boolean, end long, c_doc long, c_th long, c_pos int")
    full = scanned.join(F.broadcast(carry), "part")
    start = lambda g, first: F.when(F.col(g) == 0, F.col(first)).otherwise(F.col("base") + F.col(g))
    later = F.col("same1") | ((F.col("g1") == 0) & F.col("on1"))
    tied = later | F.col("next1") | ((F.col("idx") == F.col("end")) & F.col("follows"))
    place = [F.when(later, F.when(F.col("g1") == 0, F.col(c)).otherwise(F.col(f))).alias(f) for c, f in (("c_doc", "first_doc"), ("c_th", "first_th"), ("c_pos", "first"))]
    return full.select("doc_id", "th", "pos", (F.col("r") + start("g1", "first1") - start("g0", "first0")).alias("rank"), tied.alias("tied"), later.alias("later"), *place)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and their number in each row."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), counts


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _outer(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices, by document and start, of the ranges that no other of their document holds; of equal ones one."""
    order = np.lexsort((-size, start, doc))
    if not len(order):
        return order
    d, a, e = doc[order], start[order], (start + size)[order]
    # documents one after the other, so that ends of another document never count
    far = int(e.max()) + 1
    reach = np.maximum.accumulate(e + d * far)
    keep = np.append(True, (e + d * far)[1:] > np.maximum(reach[:-1], (d * far)[1:]))
    return order[keep]


def _apply(level: int):
    """Takes a round's ranks into the documents' rows, and adds its chains to their repeats."""
    size = 1 << level

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            rank, n = _flat(batch.column("rank"))
            rank = rank.to_numpy(zero_copy_only=False).copy()
            chars = _flat(batch.column("chars"))[0].to_numpy(zero_copy_only=False)
            news, m = _flat(batch.column("news"))
            pos, fresh, tied, later = (news.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "rank", "tied", "later"))
            th, first = (pc.fill_null(news.field(c), 0).to_numpy(zero_copy_only=False) for c in ("first_th", "first"))
            source = news.field("first_doc")
            doc = np.repeat(np.arange(len(n)), m)
            base = np.cumsum(n) - n
            at = base[doc] + pos
            rank[at] = fresh
            # a suffix shorter than the window equals its like up to the document's end
            open_ = tied & (pos + size <= n[doc])
            copies = np.flatnonzero(open_ & later)
            copies = copies[np.argsort(at[copies], kind="stable")]
            known = pc.fill_null(source, -1 << 63).to_numpy(zero_copy_only=False)[copies]
            line, owner, shift, th = at[copies], doc[copies], (first - pos)[copies], th[copies]
            new = np.append(True, (np.diff(line) != 1) | (np.diff(owner) != 0) | (np.diff(shift) != 0) | (np.diff(known) != 0) | (np.diff(th) != 0))[: len(copies)]
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], len(copies)) - 1
            before = np.append(0, np.cumsum(chars, dtype=np.int64))
            lines = line[stop] + size - line[begin] if len(begin) else begin
            enough = before[line[begin] + lines] - before[line[begin]] >= LEAST_CHARS
            begin, lines = begin[enough], lines[enough]
            held, h = _flat(batch.column("repeats"))
            starts = np.concatenate([held.field("start").to_numpy(zero_copy_only=False), pos[copies][begin]]).astype(np.int64)
            sizes = np.concatenate([held.field("size").to_numpy(zero_copy_only=False), lines]).astype(np.int64)
            owners = np.concatenate([np.repeat(np.arange(len(n)), h), owner[begin]])
            keep = _outer(owners, starts, sizes)
            docs = pa.concat_arrays([held.field("first_doc"), source.take(pa.array(copies[begin]))]).take(pa.array(keep))
            firsts = np.concatenate([held.field("first").to_numpy(zero_copy_only=False), first[copies][begin]])[keep]
            repeats = pa.StructArray.from_arrays([pa.array(starts[keep], pa.int32()), pa.array(sizes[keep], pa.int32()), docs, pa.array(firsts, pa.int32())], ["start", "size", "first_doc", "first"])
            counts = np.bincount(doc[open_], minlength=len(n))
            columns = [batch.column(c) for c in ("doc_id", "th", "at", "chars")]
            kept = np.concatenate([[0], np.cumsum(np.bincount(owners[keep], minlength=len(n)))]).astype(np.int32)
            yield pa.record_batch([*columns, _lists(rank, n, pa.int64()), pa.ListArray.from_arrays(pa.array(kept), repeats), _lists(pos[open_], counts, pa.int32())], names=["doc_id", "th", "at", "chars", "rank", "repeats", "open"])

    return run


def suffix_ranks(ws: Workspace, docs: DataFrame) -> DataFrame:
    """Per document its lines' suffix ranks and its maximal repeats (start, size, first_doc, first; in lines that aren't blank).

    A document leaves the rounds with its last open suffix, so a round reads those
    that are still in it only.
    """
    ids = ws.save(line_ids(docs), "ids")
    rows = ids.select("doc_id", "th", F.posexplode(F.arrays_zip("h", "g")).alias("pos", "v")).select(F.lit(0).cast("long").alias("r"), F.col("v.h").alias("k1"), F.col("v.g").alias("k2"), "doc_id", "th", "pos")
    state = ids.select("doc_id", "th", "at", "chars", F.transform("at", lambda _: F.lit(-1).cast("long")).alias("rank"), F.from_json(F.lit("[]"), f"array<{_REPEAT}>").alias("repeats"))
    done, level = [], 0
    while True:
        fresh = _refine(ws, rows, f"scan_{level}")
        news = fresh.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "rank", "tied", "later", "first_doc", "first_th", "first")).alias("news"))
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("doc_id", "th")]
        # a document without lines has no news; it is no part of the answer
        joined = state.drop("open").alias("s").join(news.alias("n"), same).select("s.*", "n.news")
        state = ws.save(joined.mapInArrow(_apply(level), f"{_STATE}, open array<int>"), f"state_{level}")
        ws.drop(f"scan_{level}", *([] if level else ["ids"]))
        done.append(state.where("size(open) = 0"))
        state = state.where("size(open) > 0")
        if not state.limit(1).count():
            break
        after = F.coalesce(F.get("rank", F.col("pos") + F.lit(1 << level)), F.lit(-1))
        rows = state.select("doc_id", "th", "rank", F.explode("open").alias("pos")).select(F.get("rank", F.col("pos")).alias("r"), after.alias("k1"), F.lit(0).cast("long").alias("k2"), "doc_id", "th", "pos")
        level += 1
    ws.keep(*(f"state_{k}" for k in range(level + 1)))
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def _without(lines: list[str], at, repeats) -> tuple[str, int, int, int]:
    """The text without the lines of the repeats, how many were cut, in how many runs, and the longest run."""
    gone, runs, longest, reach, size = set(), 0, 0, -1, 0
    for x in repeats:
        begin, end = x["start"], x["start"] + x["size"]
        if begin > reach:
            runs, size = runs + 1, 0
        size += end - max(begin, reach)
        longest = max(longest, size)
        gone.update(at[max(begin, reach) : end])
        reach = max(reach, end)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else "\n".join(lines), len(gone), runs, longest


def _with_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = suffix_ranks(Workspace(spark, "line_dedup"), docs).select("doc_id", "th", "at", "repeats")
    keyed = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    renamed = found.select(F.col("at").alias("__at"), F.col("repeats").alias("__repeats"), F.col("doc_id").alias("__doc"), F.col("th").alias("__key"))
    return keyed.join(renamed, keyed["doc_id"].eqNullSafe(renamed["__doc"]) & (keyed["__th"] == renamed["__key"]), "left").drop("__doc", "__key", "__th")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: n_lines (not blank), n_deleted, n_runs and longest_run of deleted lines, repeats, text_sha256 of what stays.

    repeats: the document's maximal repeats as start:lines:first document:first line, ascending, comma-joined; lines
    are numbered from 0 without blank ones. Blank lines stay and separate nothing. Null and empty texts have no
    lines. Rows equal in doc_id and text are one document and get one result each; other columns are ignored. The
    first place of a run, by doc_id and line, stays.
    """

    def run(batches):
        for batch in slices(batches):
            out = [[] for _ in range(7)]
            for doc_id, text, at, repeats in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__at", "__repeats"))):
                left, n, runs, longest = _without((text or "").split("\n"), at or (), repeats or ())
                said = ",".join(f"{x['start']}:{x['size']}:{x['first_doc']}:{x['first']}" for x in repeats or ())
                for column, v in zip(out, (doc_id, len(at or ()), n, runs, longest, said, hashlib.sha256(left.encode()).hexdigest())):
                    column.append(v)
            yield pa.record_batch([pa.array(c, pa.string() if i > 4 else pa.int64()) for i, c in enumerate(out)], names=["doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", "repeats", "text_sha256"])

    found = _with_repeats(spark, docs.select("doc_id", "text"))
    return found.mapInArrow(run, "doc_id long, n_lines long, n_deleted long, n_runs long, longest_run long, repeats string, text_sha256 string")


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without later copies of repeated runs; every row stays, perhaps with an empty text, a null text as null."""
    columns = docs.columns

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            new = [t if t is None or not r else _without(t.split("\n"), a, r)[0] for t, a, r in zip(*(batch.column(c).to_pylist() for c in ("text", "__at", "__repeats")))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type)).select(columns)

    out = _with_repeats(spark, docs).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE parted AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
), lines AS (
  SELECT doc_id, n, line, chars, row_number() OVER own AS pos, sum(chars) OVER own AS so_far
  FROM (SELECT *, length(trim(line, chr(32) || chr(9) || chr(13))) AS chars FROM parted) WHERE chars > 0 WINDOW own AS (PARTITION BY doc_id ORDER BY n)
), doubled AS (
  SELECT 0 AS level, doc_id, pos, md5(line) AS id FROM lines
  UNION ALL
  SELECT a.level + 1, a.doc_id, a.pos, md5(a.id || b.id)
  FROM doubled a JOIN doubled b ON a.level = b.level AND a.doc_id = b.doc_id AND b.pos = a.pos + (1 << a.level)
), copies AS (
  SELECT *, first_pos - pos AS shift FROM (
    SELECT level, doc_id, pos, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos, row_number() OVER w AS nth
    FROM doubled WINDOW w AS (PARTITION BY level, id ORDER BY doc_id, pos)) WHERE nth > 1
), chains AS (
  SELECT level, doc_id, first_doc, shift, min(pos) AS start, max(pos) + (1 << level) AS stop
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY level, doc_id, first_doc, shift ORDER BY pos) AS chain FROM copies)
  GROUP BY level, doc_id, first_doc, shift, chain
), enough AS (
  SELECT DISTINCT c.doc_id, start, stop, first_doc, start + shift AS first_pos
  FROM chains c JOIN lines a ON a.doc_id = c.doc_id AND a.pos = c.start JOIN lines b ON b.doc_id = c.doc_id AND b.pos = c.stop - 1
  WHERE b.so_far - a.so_far + a.chars >= {LEAST_CHARS}
), maximal AS (
  SELECT * FROM (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM enough)
  WHERE reach IS NULL OR stop > reach
), told AS (
  SELECT doc_id, string_agg((start - 1) || ':' || (stop - start) || ':' || first_doc || ':' || (first_pos - 1), ',' ORDER BY start) AS repeats FROM maximal GROUP BY doc_id
), cut AS (
  SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN maximal m ON m.doc_id = l.doc_id AND l.pos >= m.start AND l.pos < m.stop
), runs AS (
  SELECT doc_id, count(*) AS size FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM cut) GROUP BY doc_id, run
), sized AS (SELECT doc_id, sum(size) AS n_deleted, count(*) AS n_runs, max(size) AS longest_run FROM runs GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, string_agg(t.line, chr(10) ORDER BY t.n) AS text
  FROM parted t LEFT JOIN lines l ON l.doc_id = t.doc_id AND l.n = t.n LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.pos = l.pos
  WHERE c.doc_id IS NULL GROUP BY t.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(n_runs, 0)::BIGINT AS n_runs,
  coalesce(longest_run, 0)::BIGINT AS longest_run, coalesce(repeats, '') AS repeats, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN sized USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
