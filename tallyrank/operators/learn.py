"""Learned scorers on the history features: linear models from `linear`, trees from `trees`."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.operators.clean import BUILD, TEST
from tallyrank.operators.graph import add_random_edges, perturb_features, propagate, subgraph
from tallyrank.operators.linear import Logistic, Ridge, fit_logistic, fit_ridge
from tallyrank.operators.trees import Trees, fit_boosted, fit_forest
from tallyrank.session import materialize

#: Share of the squared standardised weights in the objective of the logistic fits.
_RIDGE = 0.01
# fixed values: settings of the tree models
_RF = {"n_trees": 50, "depth": 4}
_GB = {"rounds": 20, "depth": 3}
# end of fixed values


def positive_weight(df: DataFrame, label: str = "fail", top: float = 50.0) -> float:
    """min((1 - p) / (p + 1e-6), top): one number for the fit, as published."""
    p = df.agg(F.avg(label)).first()[0] or 0.0
    return min((1 - p) / (p + 1e-6), top)


def weighted(df: DataFrame, label: str = "fail", top: float = 50.0) -> DataFrame:
    w = positive_weight(df, label, top)
    return df.withColumn("_weight", F.when(F.col(label) == 1, F.lit(w)).otherwise(1.0))


def listed(columns: Sequence[str]) -> Column:
    """Numeric columns as one vector."""
    return F.array(*[F.col(c).cast("double") for c in columns])


class HistoryScorer(NamedTuple):
    columns: list[str]
    model: Logistic | Trees

    def probability(self) -> Column:
        return (self.model.probability if isinstance(self.model, Logistic) else self.model.predict)(listed(self.columns))


def fit_history_scorer(train: DataFrame, columns: Sequence[str], label: str = "fail",
                       max_pos_weight: float = 50.0, kind: str = "lr") -> HistoryScorer:
    """Failure probability from history features; failures weigh more."""
    rows = weighted(train, label, max_pos_weight)
    if kind == "lr":
        return HistoryScorer(list(columns), fit_logistic(rows, listed(columns), F.col(label), F.col("_weight"), _RIDGE))
    return HistoryScorer(list(columns), fit_boosted(rows, listed(columns), F.col(label), F.col("_weight"), **_GB))


def score(model: HistoryScorer, df: DataFrame, out: str = "p_fail") -> DataFrame:
    return df.withColumn(out, model.probability())


def text_rows(executions: DataFrame) -> DataFrame:
    """One weighted row per (test, class) in place of one per execution."""
    n = executions.groupBy(*TEST).agg(F.sum("fail").alias("f"), F.sum((F.col("verdict") == 0).cast("bigint")).alias("p"))
    rows = n.select(*TEST, F.explode(F.array(
        F.struct(F.lit(1).alias("label"), F.col("f").cast("double").alias("weight")),
        F.struct(F.lit(0).alias("label"), F.col("p").cast("double").alias("weight")))).alias("x"))
    return rows.select(*TEST, "x.*").filter("weight > 0")


def fit_text_scorer(executions: DataFrame, vectors: DataFrame, vec: str = "embedding") -> Logistic:
    """Failure probability of a test from its text vector; tests without a vector teach nothing."""
    rows = text_rows(executions).join(vectors, TEST)
    return fit_logistic(rows, F.col(vec), F.col("label"), F.col("weight"), _RIDGE)


def score_text(model: Logistic, vectors: DataFrame, vec: str = "embedding", out: str = "p_fail") -> DataFrame:
    return vectors.select(*TEST, model.probability(F.transform(vec, lambda x: x.cast("double"))).alias(out))


def build_commit_vector(df: DataFrame, vectors: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """Mean vector of a build's distinct commits, zeros for a build without any.

    `vectors` has one row per commit. Vectors are averaged whole, in one aggregate that combines
    before the shuffle.
    """
    builds = df.select(*BUILD).distinct()
    c = df.select(*BUILD, F.explode("commits").alias("commit")).distinct().join(vectors, "commit")
    whole = array_to_vector(F.col(vec).cast("array<double>"))
    v = c.groupBy(*BUILD).agg(vector_to_array(Summarizer.mean(whole)).alias("commit_vector"))
    return builds.join(v, BUILD, "left").withColumn(
        "commit_vector", F.coalesce("commit_vector", F.array_repeat(F.lit(0.0), dim)))


class Ensemble(NamedTuple):
    columns: list[str]
    logistic: Logistic
    forest: Trees
    boosted: Trees


def fit_ensemble(train: DataFrame, columns: Sequence[str], key: Sequence[str], label: str = "fail") -> Ensemble | None:
    """Logistic regression, random forest (rows drawn by `key`) and boosted trees; None when the
    labels hold one class only, in which case the failure rate is the score."""
    if train.select(label).distinct().limit(2).count() < 2:
        return None
    rows = materialize(weighted(train, label).select(*key, *columns, label, "_weight"), "ensemble")
    x, y, w = listed(columns), F.col(label), F.col("_weight")
    return Ensemble(list(columns), fit_logistic(rows, x, y, w, _RIDGE), fit_forest(rows, x, y, key, w, **_RF), fit_boosted(rows, x, y, **_GB))


def score_ensemble(model: Ensemble | None, df: DataFrame, fallback: str = "failure_rate", out: str = "p_fail", parts: bool = False) -> DataFrame:
    """The mean of the three probabilities; with `parts` each of them as well (`p_logistic`, ...)."""
    if model is None:
        return df.withColumn(out, F.col(fallback))
    x = listed(model.columns)
    three = {"p_logistic": model.logistic.probability(x), "p_forest": model.forest.predict(x), "p_boosted": model.boosted.predict(x)}
    done = df.withColumns(three)
    done = done.withColumn(out, (F.col("p_logistic") + F.col("p_forest") + F.col("p_boosted")) / 3.0)
    return done.select(*df.columns, *(three if parts else ()), out)


def _forest(train: DataFrame, columns: Sequence[str], label: str, n_trees: int = 20, depth: int = 3) -> DataFrame:
    """Predicted class of each test by a forest on all of them."""
    model = fit_forest(train, listed(columns), F.col(label), TEST, n_trees=n_trees, depth=depth)
    return train.select(*TEST, (F.round(model.predict(listed(columns)), 9) >= 0.5).cast("int").alias("y"))


def sensitivity_flags(nodes: DataFrame, edges: DataFrame, columns: Sequence[str], label: str = "label", seed: int = 42) -> DataFrame:
    """1 where a model refitted on a changed graph, changed features or other settings
    predicts otherwise than the base model. `label` must not follow from the features."""
    nodes = materialize(nodes)  # every fit reads these again; edges are read where they are made
    changed_graph = subgraph(add_random_edges(edges, nodes, 5, seed), nodes)
    spread = nodes.select(*TEST, label).join(propagate(nodes.select(*TEST, *columns), changed_graph, columns), TEST, "left").na.fill(0.0)
    spread = materialize(spread, "spread")
    variants = {
        "graph": _forest(spread, columns, label),
        "features": _forest(perturb_features(nodes, columns, TEST, 0.1, seed), columns, label),
        "model": _forest(nodes, columns, label, 30, 6),
    }
    out = _forest(nodes, columns, label).withColumnRenamed("y", "_base")
    for name, pred in variants.items():
        out = out.join(pred.withColumnRenamed("y", f"_{name}"), TEST)
    return out.select(*TEST, *[(F.col(f"_{v}") != F.col("_base")).cast("int").alias(f"flag_{v}") for v in variants])


def select_by_holdout(train: DataFrame, columns: Sequence[str], label: str = "fail", clock: str = "build_idx", share: float = 0.2,
                      candidates: Sequence[dict] = ({"depth": 2}, {"depth": 4})) -> tuple[HistoryScorer, dict, list[float]]:
    """Of the training rows, the last `share` of the clock validates: each candidate is fitted on the
    rows before, the lowest squared error wins (ties: the first), and is fitted again on all training
    rows. Rows to be scored must not be among them. Returns (model, settings, errors)."""
    last = train.agg(F.max(clock).alias("m")).first()["m"]
    late = F.col(clock) >= F.floor(F.lit(((last or 0) + 1) * (1.0 - share)))
    rows = materialize(train.select(*columns, label, late.alias("_late")), "candidates")
    x, y = listed(columns), F.col(label)
    errors = []
    for params in candidates:
        model = fit_boosted(rows.filter("not _late"), x, y, rounds=10, logistic=False, **params)
        errors.append(rows.filter("_late").agg(F.avg(F.pow(model.predict(x) - y, F.lit(2)))).first()[0])
    best = min(range(len(errors)), key=lambda i: (round(errors[i], 9), i))
    return HistoryScorer(list(columns), fit_boosted(rows, x, y, rounds=10, logistic=False, **candidates[best])), candidates[best], errors


def fit_cold_start(train: DataFrame, columns: Sequence[str], vec: str = "embedding", ridge: float = 0.1) -> tuple[list[str], Ridge]:
    """One linear model per feature from a vector, all features from one Gram matrix."""
    return list(columns), fit_ridge(train, F.col(vec), [F.col(c) for c in columns], ridge)


def predict_cold_start(fitted: tuple[list[str], Ridge], df: DataFrame, vec: str = "embedding", blend: float = 1.0) -> DataFrame:
    """Predicted features; `blend` below 1 keeps that much less of the prediction."""
    columns, model = fitted
    out = {}
    for k, c in enumerate(columns):
        value = model.predict(F.transform(vec, lambda x: x.cast("double")), k)
        if c in df.columns and blend < 1.0:
            value = F.lit(blend) * value + F.lit(1 - blend) * F.coalesce(F.col(c), value)
        out[c] = value
    return df.withColumns(out)
