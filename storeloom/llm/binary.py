"""Token-ID output by fixed-width bit packing (operator 7).

Format: a Parquet table of blocks. A block holds whole documents, in order, and
about ``BLOCK`` ids; a longer document has a block of its own. Each id takes the
minimum bits of the vocabulary, least significant bit first; ``doc_ids`` and
``lengths`` are the block's index, ``least`` and ``most`` the range of its doc_ids, ``first`` is the number of ids before it in its
shard and ``shard`` the number of the range of doc_id that it is part of. So any
document, or any run of ids of the whole, is found by the ranges of the blocks, which prune the files'
row groups, and unpacks by itself (``document``, ``ids_at``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices, texts
from .tokens import default_path, tokenizer

BLOCK = 65_536
SCHEMA = "shard long, block long, first long, n_ids long, bits int, least long, most long, doc_ids array<long>, lengths array<long>, payload binary"
_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("least", pa.int64()), ("most", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in ``bits`` bits each, least significant first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(rows.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the ``start``-th on; only the bytes that hold them are read."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype("<u4")
    first = start * bits
    held = np.frombuffer(payload, np.uint8, (first + count * bits + 7) // 8 - first // 8, first // 8)
    rows = np.unpackbits(held, bitorder="little")[first % 8 :][: count * bits].reshape(count, bits)
    out = np.zeros((count, 32), np.uint8)
    out[:, :bits] = rows
    return np.packbits(out.reshape(-1), bitorder="little").view("<u4")


def _blocks(path: str, end_id: int):
    def run(batches):
        tok, shard, block, first = tokenizer(path), TaskContext.get().partitionId(), 0, 0
        held, doc_ids, n = [], [], 0

        def flush():
            nonlocal held, doc_ids, n, block, first
            ids = np.concatenate(held)
            known = [x for x in doc_ids if x is not None]
            row = [shard, block, first, n, tok.bits, min(known, default=None), max(known, default=None), doc_ids, [len(x) for x in held], pack(ids, tok.bits)]
            block, first = block + 1, first + n
            held, doc_ids, n = [], [], 0
            return pa.record_batch([pa.array([v], t.type) for v, t in zip(row, _ARROW)], schema=_ARROW)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(tok.encode(text), np.uint32(end_id))
                if n and n + len(ids) > BLOCK:
                    yield flush()
                held.append(ids)
                doc_ids.append(doc_id)
                n += len(ids)
        if n:
            yield flush()

    return run


def write_ids(spark: SparkSession, docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Writes the ids of every whole text, ``end_id`` after each, in ascending doc_id order.

    A null text is empty, a null doc_id comes first, rows of one doc_id follow
    each other in the order of their texts' hashes; other columns are ignored.
    Shards are ranges of doc_id and hash, so one shuffle of the texts puts all in
    order, and the sample that sets the ranges holds no text.
    """
    ordered = texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    ordered.mapInArrow(_blocks(tokenizer_path, end_id), SCHEMA).write.option("compression", "zstd").parquet(path)


def _bases(blocks: DataFrame) -> list[tuple[int, int, int]]:
    """(shard, ids before it, ids in it): one row a shard, as many as the range partitions that wrote the files."""
    out, before = [], 0
    for shard, n in sorted(blocks.groupBy("shard").agg(F.sum("n_ids")).collect()):
        out.append((shard, before, n))
        before += n
    return out


def document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each row that had this doc_id, end id included; only blocks whose range holds it are read, and only its ids unpacked."""
    blocks = spark.read.schema(SCHEMA).parquet(path).where((F.col("least") <= doc_id) & (F.col("most") >= doc_id) & F.array_contains("doc_ids", doc_id))
    out = []
    for row in blocks.orderBy("shard", "block").toLocalIterator():
        ends = np.cumsum(row.lengths)
        out += [unpack(row.payload, row.bits, int(ends[k] - row.lengths[k]), row.lengths[k]) for k, d in enumerate(row.doc_ids) if d == doc_id]
    return out


def ids_at(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids of the whole from the ``start``-th on, fewer at the end; only blocks that hold any are read."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    near = [(shard, base) for shard, base, n in _bases(blocks) if base < start + count and start < base + n]
    parts = [np.empty(0, "<u4")]
    for shard, base in near:
        a, b = start - base, start + count - base
        held = blocks.where((F.col("shard") == shard) & (F.col("first") < b) & (F.col("first") + F.col("n_ids") > a))
        for row in held.orderBy("block").toLocalIterator():
            low, high = max(a - row.first, 0), min(b - row.first, row.n_ids)
            parts.append(unpack(row.payload, row.bits, low, high - low))
    return np.concatenate(parts)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row that was written, from the packed bytes.

    Repeated rows stand as often as they were written, a null doc_id first; a text of any length is one block and one row;
    files of an empty table give no rows.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    bases = [(shard, before) for shard, before, _ in _bases(blocks)]
    base = spark.createDataFrame(bases, "shard long, base long")

    def run(batches):
        for batch in batches:
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for row in batch.to_pylist():
                at = 0
                for doc_id, n in zip(row["doc_ids"], row["lengths"]):
                    ids = unpack(row["payload"], row["bits"], at, n)
                    for k, v in zip(out, (doc_id, row["base"] + row["first"] + at, n, zlib.crc32(ids.tobytes()))):
                        out[k].append(v)
                    at += n
            yield pa.record_batch([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return blocks.join(F.broadcast(base), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "token_ids")
    write_ids(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ws.path("blocks"), default_path("byte_bpe_50k.json"))
    return read_ids(spark, ws.path("blocks"))
