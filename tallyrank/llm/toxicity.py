"""Toxicity classifier: averaged subword embeddings under a linear softmax, trained jointly.

A word is the bag of its own hash and of its character n-grams (3 to 5, with marks for both ends),
and its embedding is their average; a misspelt or compounded word shares most of them. A document
is cut into segments of `SEGMENT` words, the last filled up with zero vectors; a segment's
embedding is the average of its words', a linear softmax gives its two classes, and the document is as toxic as its most toxic segment, so
one insult counts the same in a short and in a long text. Embeddings and softmax are fitted
together in numpy on a bounded sample of labelled rows (`most`); gradients flow through the
segment that decides. Early epochs look at the average of all segments to find a direction.

With two classes only the difference of the softmax weights matters, so a fitted model is one
number per hash row, and scoring adds up numbers that are kept per word.

Null and empty texts have one segment without words and get the score of the offset alone. With
labels of one class, or none, every score is that class, or 0.5. Repeated rows count each for
itself. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import crc_mod
from tallyrank.llm.labelled import labelled_sample, one_class

ROWS, DIM = 1 << 17, 8
SEGMENT = 2
MOST = 4000
KEPT_WORDS = 300_000
#: Cut off both ends of a word.
MARKS = ".,;:!?\"'()[]{}|*#$%&"


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(MARKS) for x in (text or "").lower().split()) if w]


def grams(word: str) -> list[int]:
    """Hash rows of a word and its character n-grams."""
    s = f"<{word}>"
    parts = {s} | {s[i:i + k] for k in (3, 4, 5) for i in range(len(s) - k + 1)}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % ROWS for p in sorted(parts)]


class SubwordSoftmax:
    """`rows` holds one number per hash row, `offset` the softmax's offset. Adagrad over all rows of
    the sample in every epoch; a fifth of the texts is held back to choose the epoch."""

    def __init__(self, texts: list[str], y: np.ndarray, epochs: int = 80, warm: int = 15, seed: int = 5,
                 rate: float = 0.5, decay: float = 1e-6) -> None:
        number: dict[str, int] = {}
        words = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
        # rows of SEGMENT words; number len(number) is the zero vector
        blank = len(number)
        docs = np.array([max(1, -(-len(w) // SEGMENT)) for w in words])
        padded = np.full(int(docs.sum()) * SEGMENT, blank, np.int32)
        first = np.concatenate(([0], np.cumsum(docs)))
        for w, at in zip(words, first):
            padded[at * SEGMENT:at * SEGMENT + len(w)] = w
        word = padded.reshape(-1, SEGMENT)
        seg_doc = np.repeat(np.arange(len(texts)), docs)
        gram, count = array("i"), array("i")
        for w in number:
            own = grams(w)
            gram.extend(own)
            count.append(len(own))
        del number, words
        gram, count = np.frombuffer(gram, np.int32) if gram else np.empty(0, np.int32), np.array(count, np.int64)
        start = np.cumsum(count) - count
        rng = np.random.default_rng(seed)
        back = rng.random(len(texts)) < 0.2
        weight = np.where(y > 0, (y < 1).sum() / max(1, (y > 0).sum()), 1.0) ** 0.5
        weight = np.where(back, 0.0, weight) / max(weight[~back].sum(), 1e-9)
        table, soft = rng.normal(0, 0.05, (ROWS, DIM)), rng.normal(0, 1, DIM)
        offset, state_t, state_s, state_o = 0.0, np.full((ROWS, 1), 1e-8), np.full(DIM, 1e-8), 1e-8
        best = (np.inf, None)
        for epoch in range(epochs):
            u = (table @ soft).astype(np.float32)
            s_word = np.zeros(blank + 1, np.float32)
            if blank:
                s_word[:-1] = np.add.reduceat(u[gram], start) / count
            s_seg = s_word[word].sum(axis=1)
            if epoch < warm:
                share = 1 / docs[seg_doc]
            else:
                share = (s_seg == np.maximum.reduceat(s_seg, first[:-1])[seg_doc]).astype(float)
                share /= np.add.reduceat(share, first[:-1])[seg_doc]
            a = np.add.reduceat(share * s_seg, first[:-1]) + offset
            p = 1 / (1 + np.exp(-np.clip(a, -40, 40)))
            if epoch > warm + 5 and back.any():
                q = p[back].clip(1e-6, 1 - 1e-6)
                loss = -(y[back] * np.log(q) + (1 - y[back]) * np.log(1 - q)).mean()
                if loss < best[0]:
                    best = (loss, (u, offset))
            e = (p - y) * weight
            d_seg = e[seg_doc] * share
            used = np.flatnonzero(d_seg)
            d_word = np.bincount(word[used].ravel(), np.repeat(d_seg[used], SEGMENT), blank + 1)[:-1]
            hit = np.flatnonzero(d_word)
            at = np.repeat(start[hit] - np.concatenate(([0], np.cumsum(count[hit])[:-1])), count[hit]) + np.arange(int(count[hit].sum())) \
                if len(hit) else np.empty(0, np.int64)
            d_u = np.bincount(gram[at], np.repeat(d_word[hit] / count[hit], count[hit]), ROWS)
            d_soft = table.T @ d_u
            d_table = d_u[:, None] * soft[None, :] + decay * table
            state_t += (d_table ** 2).mean(axis=1, keepdims=True)
            state_s += d_soft ** 2
            state_o += e.sum() ** 2
            table -= rate * d_table / np.sqrt(state_t)
            soft -= 0.1 * rate * d_soft / np.sqrt(state_s)
            offset -= rate * e.sum() / np.sqrt(state_o)
        self.rows, self.offset = best[1] if best[1] else ((table @ soft).astype(np.float32), offset)

    def scorer(self):
        """A function from text to probability, with a bounded table of known words."""
        rows, known = self.rows.tolist(), {}

        def of_word(w: str) -> float:
            g = grams(w)
            got = sum([rows[i] for i in g]) / len(g)
            if len(known) >= KEPT_WORDS:
                known.clear()
            known[w] = got
            return got

        def score(text: str | None) -> float:
            found = []
            for w in words_of(text):
                s = known.get(w)
                found.append(of_word(w) if s is None else s)
            if not found:
                return float(1 / (1 + np.exp(-self.offset)))
            top = max(sum(found[i:i + SEGMENT]) for i in range(0, len(found), SEGMENT))
            return float(1 / (1 + np.exp(-np.clip(top + self.offset, -40, 40))))

        return score


_scorers: dict[str, object] = {}


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", most: int = MOST) -> Column:
    """A score column for `text`: the probability of label 1. Fits at once; applies lazily."""
    import uuid

    rows = labelled_sample(docs, labels, label, train, most).select("y", "text").collect()  # at most `most` rows, or their repeats
    rows = sorted((r["y"], r["text"] or "") for r in rows)
    y = np.array([r[0] for r in rows], np.float64)
    fixed, key = one_class(y), uuid.uuid4().hex
    model = None if fixed is not None else docs.sparkSession.sparkContext.broadcast(SubwordSoftmax([t for _, t in rows], y))

    def score(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array([fixed] * len(texts), pa.float64())
        if key not in _scorers:  # one table of words per worker
            _scorers.clear()
            _scorers[key] = model.value.scorer()
        one = _scorers[key]
        return pa.array([one(t.as_py()) for t in texts], pa.float64())

    return F.arrow_udf(score, "double")(F.col("text"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    score = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 3) != 1)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int"))
