"""Best-fit packing of documents into sequences by a grouping genetic algorithm (operator 8).

Documents become pieces of at most ``capacity`` tokens. Pieces are hashed into
regions of about ``REGION`` pieces; in each region several islands evolve their
own populations (crossover injects a run of well-filled bins, drops bins that
would repeat a piece, and best-fits the displaced ones), and between epochs the
elite of each island migrates to the next. An island stops once its number of
bins equals the lower bound, which no packing can beat. Bins that stay short of
``FULL`` are broken up and packed again over many regions, so that regions cost
next to nothing. One task searches a region, all islands and epochs of it: the
state is a few MB, and a table of it after every epoch would be as many
files more, for each of which Spark starts processes beside its executor.
"""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices, texts
from .tokens import default_path, tokenizer

CAPACITY, REGION, ISLANDS, EPOCHS = 2048, 8192, 2, 3
POPULATION, GENERATIONS = 6, 12
FULL = 0.99
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: ``row`` numbers the rows of the table of pieces, so that pieces alike in all else are dealt apart too.
_NUMBERED = f"{PIECES}, row long"


class Bins:
    """A packing, perhaps under construction; finds the fullest bin that still takes a piece in constant time."""

    def __init__(self, capacity: int):
        self.capacity, self.content, self.room = capacity, [], []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some bin has room r
        self._key: tuple[int, float] | None = None

    @classmethod
    def of(cls, content: list[list[int]], sizes: list[int], capacity: int) -> Bins:
        out = cls(capacity)
        for b in content:
            out.open(list(b), capacity - sum(sizes[i] for i in b))
        return out

    def open(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.content))
        self.mask |= 1 << room
        self.content.append(items)
        self.room.append(room)

    def fit(self, item: int, size: int) -> None:
        rest = self.mask >> size
        if not rest:
            self.open([item], self.capacity - size)
            return
        r = size + (rest & -rest).bit_length() - 1
        b = self.by_room[r].pop()
        if not self.by_room[r]:
            self.mask &= ~(1 << r)
        self.content[b].append(item)
        left = r - size
        self.room[b] = left
        self.by_room[left].append(b)
        self.mask |= 1 << left

    def key(self) -> tuple[int, float]:
        """Less is better: bins, then less fitness; of a packing that is finished."""
        if self._key is None:
            self._key = len(self.content), -fitness(self)
        return self._key


def best_fit(items, sizes: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    bins = bins or Bins(capacity)
    for i in items:
        bins.fit(i, sizes[i])
    return bins


def fitness(bins: Bins) -> float:
    """Falkenauer's: mean squared fill; of two packings with as many bins the less even is better."""
    return float(np.square(1 - np.array(bins.room) / bins.capacity).mean()) if bins.room else 0.0


def crossover(first: Bins, second: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Whole well-filled bins of ``second`` go into ``first``; what they displace is best-fitted."""
    ranked = sorted(range(len(second.room)), key=second.room.__getitem__)
    top = ranked[: max(1, len(ranked) // 2)]
    inject = rng.sample(top, max(1, len(top) // 2))
    child, taken, displaced = Bins(capacity), set(), []
    for k in inject:
        taken.update(second.content[k])
        child.open(second.content[k].copy(), second.room[k])
    for b, room in zip(first.content, first.room):
        if taken.isdisjoint(b):
            child.open(b.copy(), room)
        else:
            displaced += [i for i in b if i not in taken]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(displaced, sizes, capacity, child)


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """The emptiest bins and a few at random are broken up and best-fitted anew."""
    order = sorted(range(len(bins.room)), key=bins.room.__getitem__, reverse=True)
    broken = {*order[: max(1, len(order) // 50)], *rng.sample(order, min(len(order), 3))}
    kept, free = Bins(capacity), [i for k in broken for i in bins.content[k]]
    for k, b in enumerate(bins.content):
        if k not in broken:
            kept.open(b.copy(), bins.room[k])
    free.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(free, sizes, capacity, kept)


def evolve(sizes: list[int], capacity: int, seed: int, elite: list[list[int]] | None = None, generations: int = GENERATIONS, population: int = POPULATION) -> Bins:
    """The best packing of one island after some generations; ``elite`` came from another island."""
    rng = random.Random(seed)
    bound = math.ceil(sum(sizes) / capacity)
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    best = Bins.of(elite, sizes, capacity) if elite else best_fit(order, sizes, capacity)
    if len(best.content) <= bound:
        return best
    people = [best, best_fit(order, sizes, capacity)]
    while len(people) < population:
        noisy = [(-sizes[i] * rng.uniform(0.8, 1.2), i) for i in order]
        people.append(best_fit([i for _, i in sorted(noisy)], sizes, capacity))
    for _ in range(generations):
        people.sort(key=Bins.key)
        if len(people[0].content) <= bound:
            break
        half = people[: max(2, population // 2)]
        children = [crossover(*rng.sample(half, 2), sizes, capacity, rng) for _ in range(population - len(half))]
        people = half + [mutate(c, sizes, capacity, rng) if rng.random() < 0.5 else c for c in children]
    return min(people, key=Bins.key)


def _labels(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _groups(raw: bytes) -> list[list[int]]:
    labels = np.frombuffer(raw, "<i4")
    order = np.argsort(labels, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)]


def search(sizes: list[int], capacity: int, region: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> bytes:
    """The labels of a region's best packing; the state of an island between epochs is its elite."""
    bound = math.ceil(sum(sizes) / capacity)
    elites: list[tuple[int, float, bytes] | None] = [None] * islands
    for epoch in range(epochs):
        if epoch:
            # migration: each island goes on from the better of its own elite and its neighbour's
            elites = [min(elites[k], elites[k - 1]) for k in range(islands)]
        for k, elite in enumerate(elites):
            best = evolve(sizes, capacity, zlib.crc32(f"{region}/{k}/{epoch}".encode()), _groups(elite[2]) if elite else None)
            elites[k] = (*best.key(), _labels(best.content, len(sizes)))
        if all(n <= bound for n, _, _ in elites):
            break
    return min(elites)[2]


def _pack_regions(capacity: int, islands: int, epochs: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]

    def run(batches):
        for batch in batches:
            for region, rows in zip(batch.column("region").to_pylist(), batch.column("rows")):
                flat = rows.values
                lengths = flat.field("length").to_numpy()
                bins = np.frombuffer(search(lengths.tolist(), capacity, region, islands, epochs), "<i4")
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                firsts = np.searchsorted(bins[order], bins[order])
                offset = np.empty_like(before)
                offset[order] = before - before[firsts]
                fill = np.bincount(bins, lengths)[bins].astype(np.int64)
                cols = [flat.field(c) for c in names]
                yield pa.record_batch([*cols, pa.array([region] * len(bins), pa.int64()), pa.array(bins.astype(np.int64)), pa.array(offset), pa.array(fill)], names=[*names, "region", "bin", "offset", "fill"])

    return run


def pack_round(pieces: DataFrame, n: int, name: str, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Pieces with their region and bin, packed in regions of about REGION, each searched whole by one task."""
    regions = max(1, math.ceil(n / REGION))
    row = F.struct("length", "doc_id", "piece", "start", "ids_crc32", "row")
    dealt = pieces.withColumn("region", F.pmod(F.xxhash64("row", F.lit(name)), F.lit(regions))).repartition(min(regions, 4096), "region")
    grouped = dealt.groupBy("region").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return grouped.mapInArrow(_pack_regions(capacity, islands, epochs), f"{_NUMBERED}, region long, bin long, offset long, fill long")


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut only where they exceed ``capacity``; and a number for each."""

    def run(batches):
        tok, row = tokenizer(path), TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 8 << 20):
            out = [[] for _ in range(6)]
            flat, offsets = tok.encode_many(batch.column("text").to_pylist())
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets, offsets[1:]):
                ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    for col, v in zip(out, (doc_id, k, at, len(piece), zlib.crc32(piece.tobytes()), row)):
                        col.append(v)
                    row += 1
            yield pa.record_batch([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return texts(docs).mapInArrow(run, _NUMBERED)


def best_fit_pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null texts are empty (one piece, the end id), repeated rows are packed as
    often as they occur, any number of rows may share a doc_id or have none, an empty table gives no rows; other columns are ignored.
    """
    ws = Workspace(spark, "packing")
    pieces = ws.save(cut(docs, path, capacity, end_id), "pieces")
    n = ws.rows["pieces"]
    if not n:
        return pieces.drop("row").select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = ws.save(pack_round(pieces, n, "first", capacity), "placed")
    short = first.where(F.col("fill") < int(capacity * FULL))
    left = short.count()
    again = ws.save(pack_round(short.select(pieces.columns), max(left, 1), "again", capacity), "placed_again")
    ws.keep("placed", "placed_again")
    key = lambda level: (F.col("region") * (1 << 21) + F.col("bin")) * 2 + level
    kept = first.where(F.col("fill") >= int(capacity * FULL)).withColumn("sequence_id", key(0))
    return kept.unionByName(again.withColumn("sequence_id", key(1))).select(*pieces.drop("row").columns, "sequence_id", "offset")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("word_bpe_49k.json"))
