"""Linear models from sums: one aggregate over the rows per step, a small system on the driver.

A step's job gives each task's sums of products (the Gram matrix and what goes with it) as numbered
terms, which Spark adds up; the driver only ever holds (features + 1)^2 numbers. Both objectives
are strictly convex, so their optimum does not depend on how it was found, and any other solver can
check it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.session import discard, scratch_path, write_cut

#: A step is halved at most so often before the fit stops where it is.
HALVINGS = 30


class Logistic(NamedTuple):
    """Weights on the raw features and the offset; `gradient` is that of the objective at the end."""

    weights: np.ndarray
    offset: float
    gradient: np.ndarray
    steps: int

    def probability(self, features: Column) -> Column:
        """Of label 1, from an array column."""
        return 1.0 / (1.0 + F.exp(-(dot(features, self.weights) + F.lit(self.offset))))


class Ridge(NamedTuple):
    """One column of weights and one offset for each target."""

    weights: np.ndarray
    offsets: np.ndarray

    def predict(self, features: Column, target: int) -> Column:
        return dot(features, self.weights[:, target]) + F.lit(float(self.offsets[target]))


def dot(features: Column, weights: np.ndarray) -> Column:
    parts = F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def summed(rows: DataFrame, terms: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what `terms` makes of each batch: one job, one row a term and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = terms(batch)
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.float64))], names=["term", "value"])

    got = rows.mapInArrow(run, "term long, value double").groupBy("term").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(got.num_rows)
    out[got.column("term").to_numpy()] = got.column("value").to_numpy()
    return out


def _design(rows: DataFrame, vec: Column, *others: Column) -> DataFrame:
    return rows.select(F.transform(vec, lambda x: x.cast("double")).alias("x"), *others).filter("x is not null")


def scales(rows: DataFrame, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Total weight, and the unweighted mean and population deviation of each feature (1 where it is
    constant)."""
    def terms(batch: pa.RecordBatch) -> np.ndarray:
        x = _rows(batch, "x")
        return np.concatenate([[len(x), batch.column("w").to_numpy(zero_copy_only=False).sum()], x.sum(axis=0)])

    s = summed(rows, terms)
    if not len(s):
        return 0.0, np.zeros(width), np.ones(width)
    mean = s[2:] / s[0]

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        return ((_rows(batch, "x") - mean) ** 2).sum(axis=0)

    spread = np.sqrt(summed(rows, squares) / s[0])
    return float(s[1]), mean, np.where(spread > 1e-12 * np.maximum(np.abs(mean), 1.0), spread, 1.0)


def fit_logistic(df: DataFrame, vec: Column, label: Column, weight: Column | None = None, ridge: float = 0.01,
                 steps: int = 50, tolerance: float = 1e-12) -> Logistic:
    """Minimum of the weighted mean of log losses plus ridge / 2 times the squared weights of the
    features in units of their deviation; the offset is free.

    Newton steps (iteratively reweighted least squares), each from one job that also gives the
    objective; a step that does not lower it is halved. Rows without a vector or label are left out.
    Without rows, or with one class only, the weights are 0 and the offset that class's (at +-30) or 0.
    """
    weight = F.lit(1.0) if weight is None else weight
    path = scratch_path(df.sparkSession, "design")
    rows = write_cut(_design(df, vec, label.cast("double").alias("y"), weight.cast("double").alias("w")).filter("y is not null"), path)
    try:
        first = rows.select(F.size("x").alias("n")).first()
        width = first["n"] if first else 0
        total, mean, spread = scales(rows, width)
        seen = [r["y"] for r in rows.select("y").distinct().limit(2).collect()]
        if len(seen) < 2:
            return Logistic(np.zeros(width), 0.0 if not seen else 30.0 if seen[0] > 0 else -30.0, np.zeros(width + 1), 0)
        penalty = np.append(np.full(width, ridge), 0.0)

        def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def terms(batch: pa.RecordBatch) -> np.ndarray:
                x = np.hstack([(_rows(batch, "x") - mean) / spread, np.ones((batch.num_rows, 1))])
                y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in "yw")
                a = x @ b
                p = 1.0 / (1.0 + np.exp(-np.clip(a, -700, 700)))
                return np.concatenate([[(w * (np.logaddexp(0, a) - y * a)).sum()], x.T @ (w * (p - y)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])

            s = summed(rows, terms) / total
            return (s[0] + 0.5 * float(penalty @ (b * b)), s[1:width + 2] + penalty * b,
                    s[width + 2:].reshape(width + 1, width + 1) + np.diag(penalty))

        b = np.zeros(width + 1)
        value, gradient, gram = at(b)
        taken = 0
        while taken < steps and np.abs(gradient).max() > tolerance:
            step = np.linalg.solve(gram + 1e-14 * np.eye(width + 1), gradient)
            for _ in range(HALVINGS):
                lower, g, h = at(b - step)
                if lower <= value + 1e-15:
                    break
                step = step / 2
            else:
                break
            b, value, taken = b - step, lower, taken + 1
            done = np.abs(g).max() >= np.abs(gradient).max() and np.abs(g).max() < 1e-9  # as low as doubles go
            gradient, gram = g, h
            if done:
                break
        weights = b[:-1] / spread
        return Logistic(weights, float(b[-1] - weights @ mean), gradient, taken)
    finally:
        discard(path)


def fit_ridge(df: DataFrame, vec: Column, targets: Sequence[Column], ridge: float = 0.1) -> Ridge:
    """Least squares of every target on the vector, all from one Gram matrix: half the mean squared
    error in units of each target's deviation, plus ridge / 2 times the squared weights in units of
    the features' deviations; offsets are free. One job over rows whose vector and targets are there;
    without any, everything is 0."""
    names = [f"t{i}" for i in range(len(targets))]
    rows = _design(df, vec, *[t.cast("double").alias(n) for n, t in zip(names, targets)]).na.drop(subset=names)

    def terms(batch: pa.RecordBatch) -> np.ndarray:
        a = np.hstack([np.ones((batch.num_rows, 1)), _rows(batch, "x"), *[batch.column(n).to_numpy(zero_copy_only=False)[:, None] for n in names]])
        return (a.T @ a).ravel()

    s = summed(rows, terms)
    if not len(s):
        return Ridge(np.zeros((0, len(names))), np.zeros(len(names)))
    n, size = s[0], int(round(np.sqrt(len(s))))
    gram = s.reshape(size, size) / n
    mean = gram[0, 1:]
    cov = gram[1:, 1:] - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    spread = np.where(spread > 1e-9 * np.maximum(np.abs(mean), 1.0), spread, 1.0)
    cov = cov / np.outer(spread, spread)
    width = size - 1 - len(names)
    b = np.linalg.solve(cov[:width, :width] + (ridge + 1e-14) * np.eye(width), cov[:width, width:])
    weights = b * spread[width:] / spread[:width, None]
    return Ridge(weights, mean[width:] - mean[:width] @ weights)
