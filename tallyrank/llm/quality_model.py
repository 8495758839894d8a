"""Quality classifier on random-indexing word vectors and a two-layer network.

Random indexing: every word has a sparse random index vector, and its word vector is the sum of
the index vectors of the words up to two places away, over the whole corpus. Words are hashed
into 2^14 rows, so each task adds up one matrix of fixed size, and sums of whole numbers do not
depend on their order. Besides the words, the stream of word endings (last two bytes) has vectors
of its own, which unseen words share.

A document is pooled into the mean and spread of its vectors, the mean similarity of neighbours,
and its length. A two-layer network is fitted with numpy on a bounded sample of labelled rows
(`most`), stopped on a held-back fifth of it, and its temperature is set there by likelihood.
Vectors come from all texts; labels only from training rows.

Null and empty texts pool to zeros and get a score like any other. With labels of one class, or
none, every score is that class, or 0.5. Repeated rows count each for itself. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import crc_mod, map_batches, texts_of
from tallyrank.llm.labelled import labelled_sample, one_class

ROWS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
MOST = 8000


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every row's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (ROWS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO))


def streams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the words and of their endings: even rows hold words, odd ones endings."""
    words = text.encode("utf-8", "surrogatepass").split()
    n, half = len(words), ROWS // 2 - 1
    own = np.fromiter(map(zlib.crc32, words), np.int64, n)
    tail = np.fromiter((zlib.crc32(w[-2:]) for w in words), np.int64, n)
    return (own & half) * 2, (tail & half) * 2 + 1


def _context_sums(docs: DataFrame) -> np.ndarray:
    """Sum of neighbours' index vectors for every row, over all texts."""
    cols = [f"c{d}" for d in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(ROWS * DIM)

        def add(seq: np.ndarray):
            for step in range(1, REACH + 1):
                for a, b in ((seq[:-step], seq[step:]), (seq[step:], seq[:-step])):
                    ok = (a >= 0) & (b >= 0)
                    a, b = a[ok], b[ok]
                    for k in range(NONZERO):
                        total[:] += np.bincount(a * DIM + places[b, k], signs[b, k], ROWS * DIM)

        gap = np.full(REACH, -1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                pairs = [streams(t) for t in texts_of(batch.slice(at, 1000))]
                for side in (0, 1):
                    seqs = [x for p in pairs for x in (p[side], gap)]
                    if seqs:
                        add(np.concatenate(seqs))
        sums = total.reshape(ROWS, DIM)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        for at in range(0, len(used), 4096):
            rows = used[at:at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(sums[rows, d]) for d in range(DIM)]],
                                             names=["row", *cols])

    parts = docs.select("text").mapInArrow(run, "row int, " + ", ".join(f"{c} double" for c in cols))
    table = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()  # at most ROWS rows
    out = np.zeros((ROWS, DIM))
    out[table["row"].to_numpy(np.int64)] = table[cols].to_numpy(np.float64)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    sums = _context_sums(docs)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    out = []
    n = 0
    for rows in streams(text):
        v, n = vectors[rows], len(rows)
        if n:
            near = float((v[1:] * v[:-1]).sum() / (n - 1)) if n > 1 else 0.0
            out += [v.mean(axis=0), v.std(axis=0), [near]]
        else:
            out += [np.zeros(2 * DIM + 1, np.float32)]
    return np.concatenate([*out, [np.log1p(n) / 5]]).astype(np.float32)


class Network:
    """Two layers (tanh, logistic) fitted by Adam on standardised inputs, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 120, seed: int = 3,
                 decay: float = 1e-4) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        order = rng.permutation(len(z))
        back, fit = order[:len(z) // 5], order[len(z) // 5:]
        if not len(back):
            back = fit
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), 0.0]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        best, step = (np.inf, p), 0
        for _ in range(epochs):
            rng.shuffle(fit)
            for at in range(0, len(fit), 256):
                b = fit[at:at + 256]
                h = np.tanh(z[b] @ p[0] + p[1])
                e = (self._sigmoid(h @ p[2] + p[3]) - y[b]) / len(b)
                back_h = np.outer(e, p[2]) * (1 - h * h)
                grads = [z[b].T @ back_h + decay * p[0], back_h.sum(axis=0), h.T @ e + decay * p[2], e.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
            loss = self._loss(np.tanh(z[back] @ p[0] + p[1]) @ p[2] + p[3], y[back])
            if loss < best[0]:
                best = (loss, [np.copy(a) for a in p])
        self.layers = best[1]
        logits = np.tanh(z[back] @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]
        self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: self._loss(logits / t, y[back]))

    @staticmethod
    def _sigmoid(a):
        return 1 / (1 + np.exp(-np.clip(a, -40, 40)))

    @classmethod
    def _loss(cls, a, y) -> float:
        p = cls._sigmoid(a).clip(1e-7, 1 - 1e-7)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        a = np.tanh(z @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]
        return self._sigmoid(a / self.temperature)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", most: int = MOST) -> Column:
    """A score column for `text`: the probability of label 1. Fits at once; applies lazily."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    sent = spark.sparkContext.broadcast(vectors)

    def pool():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [pooled(t, sent.value).tolist() for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["y", "x"])

        return work

    sample = labelled_sample(docs, labels, label, train, most)
    rows = map_batches(sample.select("y", "text"), pool, "y int, x array<float>").collect()  # at most `most` rows, or their repeats
    rows = sorted((r["y"], r["x"]) for r in rows)
    y = np.array([r[0] for r in rows], np.float64)
    fixed = one_class(y)
    model = None if fixed is not None else spark.sparkContext.broadcast(Network(np.array([r[1] for r in rows], np.float64), y))

    def score(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array([fixed] * len(texts), pa.float64())
        out = [0.0] * len(texts)
        for at in range(0, len(texts), 256):
            x = np.stack([pooled(t.as_py() or "", sent.value) for t in texts.slice(at, 256)])
            out[at:at + len(x)] = model.value.scores(x).tolist()
        return pa.array(out, pa.float64())

    return F.arrow_udf(score, "double")(F.col("text"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    score = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int"))
