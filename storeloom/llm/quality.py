"""Quality of documents by a byte-level convolutional network in numpy (operator 4).

Bytes become learned vectors; ``FILTERS`` filters of ``WINDOW`` bytes slide over the
whole document in steps of ``STRIDE``. Each chunk of ``CHUNK`` bytes (neighbours
overlap) takes the maximum of every filter, a hidden layer makes one logit
of a chunk, and the mean and the least of the chunk logits make the probability.

The network is fitted on a bounded sample: at most ``PER_CLASS`` labelled documents
of either class, the first by a hash of doc_id, whole texts, of at most ``FIT_CHARS``
characters each and ``CLASS_BYTES`` a class, never any whose crc32(doc_id) mod 5 is 0. All of
the sample is learned from; documents of a class with more than ``RATIO`` times the other's weigh
less, so that the class as a whole counts RATIO times the other. Labels, lang, source and
doc_id are no inputs. Every text is scored whole, however long: a long one in parts
of whole chunks, of which only the chunks' logits are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import first_by_hash, texts

PER_CLASS, BATCH, RATE = 1_000, 64, 4e-3
FIT_CHARS, CLASS_BYTES, RATIO = 1 << 18, 32 << 20, 2.0
#: Passes over the sample: as many as make STEPS steps, within bounds.
STEPS, LEAST_PASSES, MOST_PASSES = 450, 12, 60
EMBED, WINDOW, STRIDE, FILTERS, HIDDEN = 8, 8, 4, 32, 16
#: Chunks of 512 bytes, a new one every 448.
CHUNK, STEP = 512 // STRIDE, 448 // STRIDE
THRESHOLD = 0.3
#: Positions convolved at once.
BLOCK = 1 << 17


def positions(raw: bytes) -> int:
    """Positions whose window begins within the text, one at least."""
    return max(1, -(-len(raw) // STRIDE))


def split(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """The text as parts of whole chunks and at most about BLOCK positions, with their positions."""
    n, chunks = positions(raw), BLOCK // STEP
    if n <= BLOCK:
        yield raw, n
        return
    # the last chunk begins before its predecessor ends, so a part is never the overlap alone
    for a in range(0, max(1, -(-(n - (CHUNK - STEP)) // STEP)), chunks):
        size = min(n - a * STEP, chunks * STEP + CHUNK - STEP)
        yield raw[a * STEP * STRIDE : (a * STEP + size) * STRIDE + WINDOW], size


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": f(256, EMBED, scale=0.5),
            "filters": f(WINDOW * EMBED, FILTERS, scale=(WINDOW * EMBED) ** -0.5),
            "hidden": f(FILTERS, HIDDEN, scale=FILTERS**-0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "logit": f(HIDDEN, scale=HIDDEN**-0.5),
            "combine": np.array([1.0, 0.5, 0.0], np.float32),
        }

    @staticmethod
    def layout(parts: list[tuple[bytes, int]]):
        """All bytes of (bytes, positions) parts, and for each chunk its first and end position and its part."""
        n_pos = np.array([n for _, n in parts], np.int64)
        # the window of a part's last position may reach into zeros
        padded = n_pos * STRIDE + WINDOW
        data = np.frombuffer(b"".join(r[:p].ljust(p, b"\0") for (r, _), p in zip(parts, padded.tolist())), np.uint8)
        base = np.concatenate([[0], np.cumsum(padded)])[:-1] // STRIDE
        n_chunks = np.maximum(1, -(-(n_pos - (CHUNK - STEP)) // STEP))
        doc = np.repeat(np.arange(len(parts)), n_chunks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        start = base[doc] + nth * STEP
        end = np.minimum(start + CHUNK, base[doc] + n_pos[doc])
        return data, start, end, doc

    def convolve(self, data: np.ndarray) -> np.ndarray:
        """(positions, FILTERS); a window is WINDOW / STRIDE strides long, each a product of its own."""
        x = self.p["embed"][data].reshape(-1, STRIDE * EMBED)
        parts = self.p["filters"].reshape(WINDOW // STRIDE, STRIDE * EMBED, FILTERS)
        out = x @ parts[0]
        for k in range(1, len(parts)):
            out[:-k] += x[k:] @ parts[k]
        return out

    def pooled(self, parts: list[tuple[bytes, int]]):
        data, start, end, doc = self.layout(parts)
        conv = self.convolve(data)
        bounds = np.stack([start, end], 1).reshape(-1)
        return np.maximum.reduceat(conv, bounds, axis=0)[::2], conv, data, start, end, doc

    def logits(self, top: np.ndarray):
        """Hidden layer and logit of each chunk."""
        h = np.maximum(top @ self.p["hidden"] + self.p["hidden_bias"], 0)
        return h, h @ self.p["logit"]

    def combined(self, mean: np.ndarray, least: np.ndarray) -> np.ndarray:
        a, b, c = self.p["combine"]
        return 1 / (1 + np.exp(-np.clip(a * mean + b * least + c, -30, 30)))

    def score(self, raw: list[bytes | str]) -> np.ndarray:
        """Scores of whole texts, in groups of parts of about BLOCK positions."""
        total, count, least = np.zeros(len(raw)), np.zeros(len(raw)), np.full(len(raw), np.inf)
        group, owners, held = [], [], 0

        def flush():
            top, *_, part = self.pooled(group)
            z = self.logits(top)[1].astype(float)
            owner = np.array(owners)[part]
            np.add.at(total, owner, z)
            np.add.at(count, owner, 1)
            np.minimum.at(least, owner, z)

        for i, text in enumerate(raw):
            for part in split(text.encode() if isinstance(text, str) else text):
                group.append(part)
                owners.append(i)
                held += part[1]
                if held >= BLOCK:
                    flush()
                    group, owners, held = [], [], 0
        if group:
            flush()
        return self.combined(total / np.maximum(count, 1), least)

    def gradients(self, raw: list[bytes], y: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        top, conv, data, start, end, doc = self.pooled([(r, positions(r)) for r in raw])
        h, z = self.logits(top)
        firsts = np.flatnonzero(np.diff(doc, prepend=-1))
        counts = np.diff(np.append(firsts, len(doc)))
        mean = np.add.reduceat(z, firsts) / counts
        least = np.minimum.reduceat(z, firsts)
        a, b, _ = self.p["combine"]
        d = (self.combined(mean, least) - y) / len(y)
        if weight is not None:
            d = d * weight
        dz = np.repeat(a * d / counts, counts)
        dz += np.where(z == np.repeat(least, counts), np.repeat(b * d, counts), 0)
        dh = np.outer(dz, self.p["logit"]) * (h > 0)
        dtop = dh @ self.p["hidden"].T
        g = {"combine": np.array([d @ mean, d @ least, d.sum()]), "logit": h.T @ dz, "hidden": top.T @ dh, "hidden_bias": dh.sum(0)}
        # only the window that gave a maximum learns
        at = np.stack([s + conv[s:e].argmax(0) for s, e in zip(start, end)])
        windows = data[(at[..., None] * STRIDE) + np.arange(WINDOW)]
        x = self.p["embed"][windows].reshape(*at.shape, -1)
        g["filters"] = np.einsum("cfw,cf->wf", x, dtop)
        dx = (dtop[..., None] * self.p["filters"].T[None]).reshape(-1, EMBED)
        bytes_ = windows.reshape(-1)
        g["embed"] = np.stack([np.bincount(bytes_, dx[:, k], 256) for k in range(EMBED)], 1)
        return g

    def fit(self, raw: list[bytes], y: np.ndarray, weight: np.ndarray | None = None, epochs: int | None = None, seed: int = 1) -> Network:
        epochs = epochs or min(MOST_PASSES, max(LEAST_PASSES, STEPS * BATCH // max(1, len(raw))))
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(raw))
            for k in range(0, len(order), BATCH):
                chosen = order[k : k + BATCH]
                step += 1
                for name, g in self.gradients([raw[i] for i in chosen], y[chosen], None if weight is None else weight[chosen]).items():
                    g = g.astype(np.float32)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | float:
    """A network, or where fewer than two classes are labelled the share of label 1 as every score.

    Of a doc_id that has several labels or texts the least of each counts; null labels and ids are no examples, a null text is an empty one.
    """
    known = labels.where("quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for label in (0, 1):
        some = first_by_hash(known.where(F.col("quality") == label), "doc_id", per_class, totals.get(label, 0))
        chosen = some if chosen is None else chosen.unionAll(some)
    # at most 2 * per_class ids: a size known beforehand
    found = texts(docs).join(F.broadcast(chosen), "doc_id").where(F.length("text") <= FIT_CHARS).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    turn = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
    found = found.withColumn("bytes", F.sum(F.octet_length("text")).over(turn)).where(F.col("bytes") <= CLASS_BYTES)
    rows = found.select("doc_id", "quality", "text").toPandas().sort_values("doc_id")
    y = rows["quality"].to_numpy(np.float32)
    if len(set(y)) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    counts = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.minimum(1.0, RATIO * counts.min() / counts)[y.astype(int)]
    return Network().fit([t.encode() for t in rows["text"]], y, weight / weight.mean())


def score_texts(model: Network | float, values: list[str]) -> np.ndarray:
    """Scores of whole texts, rounded so that batching can't show; equal texts share one."""
    if isinstance(model, float):
        return np.full(len(values), model)
    return np.round(model.score(values), 6)


def score(docs: DataFrame, model: Network | float, into: str = "score") -> DataFrame:
    """Adds the score (0 to 1) to the rows as column ``into``, which replaces one of that name.

    Null texts score as empty ones, repeated rows alike, an empty table gives none; memory beyond the text itself
    doesn't grow with its length.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(score_texts(model, values.tolist()))

    return docs.withColumn(into, run(F.coalesce(F.col("text"), F.lit(""))))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
