"""Trees from histograms: forests and boosted trees grown level by level.

Features become bins of equal width between their smallest and largest training value. A level of all
trees that grow side by side is one job: tasks add up weight and target per (tree, node, feature, bin),
Spark sums them, and the driver takes the best cut of every node from cumulative sums. It holds bins and
nodes, never rows. Ties go to the smaller feature, then to the smaller bin, and gains are compared to
six places, so a fit does not depend on the order of summation.

A cut's gain is G_l^2 / (H_l + s) + G_r^2 / (H_r + s) - G^2 / (H + s), with G and H the sums of
targets and weights on either side and s the smoothing; for a binary target without smoothing that
is the decrease of the Gini impurity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions.hashing import hash_int
from tallyrank.operators.linear import _rows, summed
from tallyrank.session import discard, scratch_path, write_cut

BINS = 32
#: Cumulative shares of how often a row is drawn into one tree's sample (Poisson with mean 1).
DRAWN = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
#: Rows' draws: a 31-bit hash times a power of GENERATOR modulo PRIME.
PRIME, GENERATOR = 2147483647, 48271
#: Gains up to this are none.
NO_GAIN = 1e-6


class Bins(NamedTuple):
    low: np.ndarray
    high: np.ndarray

    def column(self, features: Column) -> Column:
        """Bins of an array of features; values outside of the training range are in the last bins."""
        span = [float(h - l) if h > l else 1.0 for l, h in zip(self.low, self.high)]
        x = F.arrays_zip(features.alias("v"), F.array(*[F.lit(float(l)) for l in self.low]).alias("l"), F.array(*[F.lit(s) for s in span]).alias("s"))
        return F.transform(x, lambda c: F.least(F.greatest(F.floor((c["v"] - c["l"]) / c["s"] * F.lit(float(BINS))), F.lit(0)), F.lit(BINS - 1)).cast("int"))


class Tree(NamedTuple):
    """Nodes in heap order from 1; `feature` is -1 where a node is not cut."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        for _ in range(levels):
            f = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + right, at)
        return at


class Trees(NamedTuple):
    """`base` plus `rate` times the sum (or mean) of the trees' values."""

    bins: Bins
    trees: list[Tree]
    depth: int
    base: float
    rate: float
    logistic: bool

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += self.rate * t.value[t.node(bins, self.depth)]
        return out

    def predict(self, features: Column) -> Column:
        """A probability for logistic trees, else the value itself."""
        model = self

        def score(bins: pa.Array) -> pa.Array:
            x = bins.flatten().to_numpy(zero_copy_only=False).reshape(len(bins), -1)
            out = model.raw(x) if len(bins) else np.empty(0)
            return pa.array(1.0 / (1.0 + np.exp(-out)) if model.logistic else out, pa.float64())

        return F.arrow_udf(score, "double")(self.bins.column(features))


def _binned(df: DataFrame, features: Column, label: Column, weight: Column | None, key: Sequence[str], path: str) -> tuple[DataFrame, Bins] | None:
    x = F.transform(features, lambda v: v.cast("double"))
    rows = df.select(x.alias("x"), label.cast("double").alias("y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w"),
                     (hash_int(*[F.col(k) for k in key], "row", digits=8) if key else F.lit(0)).alias("h")).filter("x is not null and y is not null")
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        return None
    ends = rows.agg(*[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(first["n"]) for n, f in (("l", F.min), ("h", F.max))]).first()
    bins = Bins(*(np.array([ends[f"{n}{i}"] for i in range(first["n"])], np.float64) for n in "lh"))
    return write_cut(rows.select(bins.column(F.col("x")).alias("x"), "y", "w", (F.col("h") % PRIME).alias("h")), path), bins


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return (_rows(batch, "x").astype(np.int64), *[batch.column(c).to_numpy(zero_copy_only=False) for c in "ywh"])


def draws(h: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in a tree's sample."""
    u = (h.astype(np.int64) * pow(GENERATOR, tree + 1, PRIME) % PRIME) / PRIME
    return np.searchsorted(np.array(DRAWN), u, side="right").astype(np.float64)


def subset(tree: int, node: int, width: int, most: int) -> np.ndarray:
    """The features that a node may be cut by: those with the smallest digests."""
    import hashlib

    order = sorted(range(width), key=lambda f: hashlib.md5(f"{tree}|{node}|{f}".encode()).hexdigest())
    return np.array(sorted(order[:most]))


def _grow(rows: DataFrame, width: int, n_trees: int, depth: int, targets: Callable, allowed: Callable[[int, int], np.ndarray], smooth: float,
          least: float) -> list[Tree]:
    """Trees that grow side by side. `targets` gives (target, weight) of a batch's rows for a tree."""
    size = 2 << depth
    trees = [Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(n_trees)]
    for level in range(depth + 1):
        first = 1 << level
        cells = first * width * BINS if level < depth else 0

        def terms(batch: pa.RecordBatch) -> np.ndarray:
            x, y, w, h = _columns(batch)
            out = []
            for t, tree in enumerate(trees):
                g, weight = targets(x, y, w, h, t)
                node = tree.node(x, level)
                if level == depth:  # what the leaves hold, wherever they are
                    out += [np.bincount(node, g, size), np.bincount(node, weight, size)]
                    continue
                here = node >= first
                at = (((node[here] - first)[:, None] * width + np.arange(width)) * BINS + x[here]).ravel()
                out += [np.bincount(at, np.repeat(v[here], width), cells) for v in (g, weight)]
            return np.concatenate(out)

        total = summed(rows, terms)
        if level == depth:
            for tree, (g, h) in zip(trees, total.reshape(n_trees, 2, size)):
                tree.value[:] = np.where(h + smooth > 0, g / np.maximum(h + smooth, 1e-300), 0.0)
            break
        for t, (tree, both) in enumerate(zip(trees, total.reshape(n_trees, 2, first, width, BINS))):
            for k in range(first):
                best = best_cut(both[0, k], both[1, k], allowed(t, first + k), smooth, least)
                if best:
                    tree.feature[first + k], tree.cut[first + k] = best
    return trees


def best_cut(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, smooth: float, least: float) -> tuple[int, int] | None:
    """(feature, bin) of the cut behind a bin that gains most, from sums per feature and bin."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    right_g, right_h = all_g - left_g, all_h - left_h
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g ** 2 / (left_h + smooth) + right_g ** 2 / (right_h + smooth) - all_g ** 2 / (all_h + smooth)
    # a little slack, so that equal weights count as enough however they were added up
    gain = np.where((left_h >= least - 1e-9) & (right_h >= least - 1e-9), np.round(gain, 6), 0.0)
    mask = np.zeros(len(g), bool)
    mask[allowed] = True
    gain = np.where(mask[:, None], gain, 0.0)
    at = int(gain.argmax())
    return divmod(at, gain.shape[1]) if gain.flat[at] > NO_GAIN else None


def fit_forest(df: DataFrame, features: Column, label: Column, key: Sequence[str], weight: Column | None = None, n_trees: int = 50,
               depth: int = 4, least: float = 1.0) -> Trees | None:
    """Mean of trees on samples of the rows, drawn by a hash of `key`; each node chooses among the
    square root of the features. None without rows."""
    path = scratch_path(df.sparkSession, "bins")
    got = _binned(df, features, label, weight, key, path)
    if got is None:
        return None
    rows, bins = got
    try:
        width = len(bins.low)
        most = int(np.ceil(np.sqrt(width)))

        def targets(x, y, w, h, t):
            n = w * draws(h, t)
            return n * y, n

        trees = _grow(rows, width, n_trees, depth, targets, lambda t, node: subset(t, node, width, most), 0.0, least)
        return Trees(bins, trees, depth, 0.0, 1.0 / n_trees, False)
    finally:
        discard(path)


def fit_boosted(df: DataFrame, features: Column, label: Column, weight: Column | None = None, rounds: int = 20, depth: int = 3,
                rate: float = 0.1, smooth: float = 1.0, least: float = 1.0, logistic: bool = True) -> Trees | None:
    """Boosted trees: each fits the gradient of the log loss (or of the squared error) of what came
    before, with Newton leaves, from the weighted mean as a start. None without rows."""
    path = scratch_path(df.sparkSession, "bins")
    got = _binned(df, features, label, weight, (), path)
    if got is None:
        return None
    rows, bins = got
    try:
        width = len(bins.low)
        mean = rows.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m")).first()["m"]
        base = float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6)))) if logistic else float(mean)
        model = Trees(bins, [], depth, base, rate, logistic)

        def targets(x, y, w, h, t):
            f = model.raw(x)
            if not logistic:
                return w * (y - f), w
            p = 1.0 / (1.0 + np.exp(-f))
            return w * (y - p), w * p * (1 - p)

        for _ in range(rounds):
            grown = _grow(rows, width, 1, depth, targets, lambda t, node: np.arange(width), smooth, least)
            model.trees.extend(grown)
        return model
    finally:
        discard(path)
