"""Robust multivariate outliers among documents: minimum-covariance-determinant estimates per
language and source, and rejection by Mahalanobis distance of transformed statistics.

Every document gets simple counts, and from them a vector of logarithms of rates. A rate is
shrunk by a pseudo-count of ordinary words, so that short texts do not stand out by chance alone.
Documents that fail the base rule take no part in the estimates.

A cell is a language and source. Cells with fewer than `least` documents are pooled within their
language, and what is still small is pooled over all. For all cells at once, concentration steps
start from medians and quartiles: distances under the current estimate, their h-th smallest per
cell from a histogram of the distances (1/64 of an octave; the bin that holds it is taken whole),
then mean and covariance of that half. Steps stop when no cell's determinant falls any more.
Scatter has a floor in every direction, since most texts have no symbols or repeats at all and
the smallest determinant would be 0. The estimate is scaled so that the median distance is that of
a normal sample.

Null and empty texts have no words and fail the base rule. A null language or source is a value of
its own. Repeated rows count each for itself, ties fall into the same bin. An empty table, or one
whose documents all fail the base rule, gives base results only. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.session import materialize

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
VECTOR = ("x0", "x1", "x2", "x3", "x4", "x5")
#: Counted as symbols by the base rule.
SYMBOLS = b"#*$%&|<>"
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS)
#: Ordinary words added to every text before rates are taken.
PSEUDO = 50
#: Scatter that every direction has at least, in logarithms.
FLOOR = 0.2
CUTOFF = 150.0


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words in windows of `size` words that are found at least twice in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    _, code, times = np.unique(key, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(times[code] > 1)
    if not len(maybe):
        return 0
    found: dict[tuple, list[int]] = {}
    for i in maybe.tolist():  # equal hashes are confirmed on the words
        found.setdefault(tuple(words[i:i + size]), []).append(i)
    at = np.array([i for places in found.values() if len(places) > 1 for i in places], np.int64)
    turn = np.zeros(len(words) + 1, np.int64)
    np.add.at(turn, at, 1)
    np.add.at(turn, at + size, -1)
    return int((np.cumsum(turn) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in STATS."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, lines, dup = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    blank = sum(text.count(c) for c in " \t\n\v\f\r")
    without = lambda marks: len(raw) - len(raw.translate(None, marks))
    return (len(words), len(text) - blank, without(SYMBOLS), dup, repeated_words(words), lines, without(_LETTERS), without(_MARKS))


def with_statistics(docs: DataFrame, text: str = "text", result: str = "stats") -> DataFrame:
    kind = pa.struct([(s, pa.int64()) for s in STATS])

    def count(texts: pa.Array) -> pa.Array:
        rows = [statistics(t.as_py()) for t in texts]
        cols = list(zip(*rows)) or [[] for _ in STATS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(STATS)).cast(kind)

    udf = F.arrow_udf(count, "struct<" + ", ".join(f"{s}: bigint" for s in STATS) + ">")
    return docs.withColumn(result, udf(F.col(text)))


def _vector() -> dict[str, Column]:
    """Logarithms of shrunken rates; a typical word has 6 characters and every 12th a mark."""
    n = F.col("n_words") + PSEUDO
    rate = lambda c, least: F.log(F.col(c) / n + least)
    share = lambda c, of: F.log(F.col(c) / (F.col(of) + 5) + 0.05)
    return {
        "x0": F.log((F.col("word_chars") + 6 * PSEUDO) / n), "x1": rate("n_symbols", 0.02),
        "x2": share("n_dup_lines", "n_lines"), "x3": rate("n_repeat_words", 0.1), "x4": rate("n_upper", 0.2),
        "x5": F.log((F.col("n_marks") + PSEUDO / 12) / n + 0.1),
    }


def _cells(rows: DataFrame, least: int) -> DataFrame:
    """`cell` of every row: language and source, or a pool where those have too few rows."""
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    rows = rows.withColumn("cell", name("lang", "source"))
    for pool in (F.concat(F.lit("lang "), name("lang")), F.lit("all")):
        small = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < least).select("cell", F.lit(True).alias("_small"))
        rows = rows.join(small, "cell", "left").withColumn("cell", F.when(F.col("_small"), pool).otherwise(F.col("cell"))).drop("_small")
    return rows


def _distance() -> Column:
    """Squared Mahalanobis distance from columns center and inverse (row by row)."""
    p = len(VECTOR)
    diff = [F.col(v) - F.col("center")[i] for i, v in enumerate(VECTOR)]
    terms = [F.col("inverse")[i * p + j] * diff[i] * diff[j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def _estimates(moments: DataFrame, floor: float) -> DataFrame:
    """cell, center, inverse and log determinant from a cell's sums: one small row per cell."""
    p = len(VECTOR)

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
                second = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        second[i, j] = second[j, i] = r[f"q{i}_{j}"] / r["n"]
                cov = second - np.outer(mean, mean) + floor ** 2 * np.eye(p)
                inv, det = np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])
                out.append((r["cell"], mean.tolist(), inv.ravel().tolist(), det))
            yield pd.DataFrame(out, columns=["cell", "center", "inverse", "logdet"])

    return moments.mapInPandas(run, "cell string, center array<double>, inverse array<double>, logdet double")


def _binned(d: Column) -> Column:
    return F.floor(F.log2(F.greatest(d, F.lit(1e-12))) * 64)


def _upto(rows: DataFrame, share: float) -> DataFrame:
    """cell and `top`: the distance bin that holds the given share of the cell's rows."""
    from pyspark.sql import Window as W

    bins = rows.groupBy("cell", _binned(F.col("d")).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("cell")
    bins = bins.withColumns({"cum": F.sum("c").over(w.orderBy("bin")), "all": F.sum("c").over(w)})
    return bins.filter(F.col("cum") >= F.ceil(F.col("all") * share)).groupBy("cell").agg(F.min("bin").alias("top"))


def _start(rows: DataFrame, floor: float) -> DataFrame:
    q = rows.groupBy("cell").agg(*[F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(v) for v in VECTOR])
    p = len(VECTOR)
    scale = [F.pow((F.col(v)[2] - F.col(v)[0]) / 1.349, 2) + floor ** 2 for v in VECTOR]
    cells = [1 / scale[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p)]
    return q.select("cell", F.array(*[F.col(v)[1] for v in VECTOR]).alias("center"), F.array(*cells).alias("inverse"),
                    F.lit(math.inf).alias("logdet"))


def mcd(rows: DataFrame, share: float = 0.75, floor: float = FLOOR, steps: int = 10, settled: float = 1e-3) -> DataFrame:
    """Minimum-covariance-determinant estimate of every cell: center, inverse, logdet, scale."""
    estimate = materialize(_start(rows, floor), "mcd")
    p = len(VECTOR)
    for _ in range(steps):
        at = rows.join(estimate, "cell").select("cell", *VECTOR, _distance().alias("d"))
        best = at.join(_upto(at, share), "cell").filter(_binned(F.col("d")) <= F.col("top"))
        sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)]
        sums += [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
        new = materialize(_estimates(best.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *sums), floor), "mcd")
        fall = new.alias("n").join(estimate.alias("o"), "cell").agg(F.max(F.col("o.logdet") - F.col("n.logdet"))).first()[0]
        estimate = new
        if fall is None or fall < settled:
            break
    at = rows.join(estimate, "cell").select("cell", _distance().alias("d"))
    # the median of a chi-square with p degrees of freedom, by Wilson and Hilferty
    middle = p * (1 - 2 / (9 * p)) ** 3
    scale = _upto(at, 0.5).select("cell", F.greatest(F.pow(F.lit(2.0), (F.col("top") + 1) / 64) / middle, F.lit(1.0)).alias("scale"))
    return estimate.join(scale, "cell")


def judge(docs: DataFrame, least: int = 200, share: float = 0.75, cutoff: float = CUTOFF, floor: float = FLOOR) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, distance (squared, scaled; null where
    the base rule fails) and kept."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), "text")
    rows = with_statistics(rows).select("doc_id", "lang", "source", "stats.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed).withColumns(_vector()), "statistics")
    good = materialize(_cells(rows.filter("not base_failed"), least), "cells")
    estimate = mcd(good.select("cell", *VECTOR), share, floor)
    judged = good.join(estimate, "cell").withColumn("distance", _distance() / F.col("scale"))
    keep = ["doc_id", *STATS[:5], "base_failed"]
    out = judged.select(*keep, "distance", (F.col("distance") <= cutoff).alias("kept"))
    return out.unionByName(rows.filter("base_failed").select(*keep, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))


def op1(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
