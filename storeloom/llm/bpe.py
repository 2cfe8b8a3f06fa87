"""BPE encoding and decoding by distinct-word tables (operator 5).

Spark splits every text into the tokenizer's words; each block of documents (one
Arrow batch cut to ``BLOCK_BYTES``) makes a table of its distinct words, encodes
each of them once, and joins the ids back by position; decoding joins ids with
the id-to-piece table, whose size is the vocabulary's. The table is a block's
and not the corpus's, as a join over the corpus would shuffle a row for each
word occurrence, several times the input.

Spark splits texts of plain Latin letters, digits and punctuation into the
tokenizer's words. On other characters Java's, Python's and the library's Unicode tables may
differ, so it splits other texts at white space only, and the library encodes each distinct
chunk that holds such a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts
from .tokens import CHUNK, default_path, tokenizer

BLOCK_BYTES = 6 << 20
#: The complement of the alphabet that the rank table takes (tokens.py), in Java's syntax.
_NOT_PLAIN = r"[^\t\n\r -~¡-įı-ɏ]"
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def split_words(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and words: the tokenizer's words, or chunks that CHUNK marks."""
    tok = tokenizer(path)
    text = F.col("text")
    if not (tok.parts and tok.by_word):
        return texts(docs).select("doc_id", F.array(F.concat(F.lit(CHUNK), text)).alias("words"))
    plain = ~text.rlike(_NOT_PLAIN)
    for special in tok.special:
        plain = plain & ~F.contains(text, F.lit(special))
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({tok.pattern})"), F.lit(1))
    chunks = F.transform(F.split(text, "[ \\t\\n\\r]+"), lambda x: F.concat(F.lit(CHUNK), x))
    return texts(docs).select("doc_id", F.when(plain, words).otherwise(chunks).alias("words"))


class _Pieces:
    """The id-to-piece table; decoding is a take of its rows."""

    def __init__(self, tok):
        self.tok = tok
        # the tokenizers library writes a space between pieces where a file names no decoder
        self.joined = tok.library.decoder is None
        self.table = pa.array([(p + " " if self.joined else p).encode() for p in tok.pieces()], pa.large_binary())

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The decoded text of each document; its ids are ids[offsets[i]:offsets[i + 1]]."""
        if not self.joined:
            return [self.tok.library.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(offsets, offsets[1:])]
        taken = self.table.take(pa.array(ids))
        _, at, data = taken.buffers()
        at = np.frombuffer(at, np.int64, len(ids) + 1, taken.offset * 8) if len(ids) else np.zeros(1, np.int64)
        data = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(data[at[a] : at[b] - 1]) if b > a else b"" for a, b in zip(offsets, offsets[1:])]


def _run(path: str, digest: bool):
    def run(batches):
        tok = tokenizer(path)
        pieces = _Pieces(tok)
        for batch in batches:
            for block in slices([batch], "words", BLOCK_BYTES):
                words = block.column("words")
                counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                if tok.by_word and tok.fast:
                    ids, offsets = tok.by_position(words.flatten(), counts)
                else:
                    ids, offsets = tok.encode_many([w[len(CHUNK) :] for w in words.flatten().to_pylist()])
                decoded = pieces.decode(ids, offsets)
                raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets, offsets[1:])]
                lengths = pa.array(np.diff(offsets), pa.int64())
                if digest:
                    out = [pa.array([hashlib.sha256(x).hexdigest() for x in col], pa.string()) for col in (raw, decoded)]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    out, names = [pa.array(raw, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"]
                yield pa.record_batch([block.column("doc_id"), lengths, *out], names=names)

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and decoded (UTF-8) of every whole text.

    Null texts are empty (no ids, empty decoding); repeated rows give repeated
    rows; other columns are ignored.
    """
    return split_words(docs, path).mapInArrow(_run(path, False), SCHEMA)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """encode() with ids and decoding as digests, made beside them so that they don't leave the worker."""
    return split_words(docs, path).mapInArrow(_run(path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("word_bpe_49k.json"))
