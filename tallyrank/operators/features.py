"""Feature tables over the running history. Exact formulas are in SURVEY section 2.14."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrank.functions.verdict import fail_from_code
from tallyrank.operators.chronology import project_sizes
from tallyrank.operators.clean import BUILD
from tallyrank.operators.history import TEST, history, snapshot
from tallyrank.operators.scale import exact_quantiles, quantiles_of_counts, running_sums, value_counts
from tallyrank.session import materialize

# fixed values: column names and order of the published feature layouts
V1_NAMES = ["test_age", "failure_rate", "recent_failure_rate", "flakiness_rate", "commit_count",
            "test_novelty"]
V2_NAMES = ["test_age", "failure_rate", "recent_failure_rate", "flakiness_rate", "execution_count",
            "failure_count", "pass_count", "consecutive_failures", "consecutive_passes",
            "max_consecutive_failures", "last_failure_age", "last_pass_age", "execution_frequency",
            "failure_trend", "recent_execution_count", "very_recent_failure_rate",
            "medium_term_failure_rate", "acceleration", "deceleration_factor", "builds_since_change",
            "commit_count", "test_novelty", "builds_affected", "cr_count", "commit_count_actual",
            "avg_commits_per_execution", "recent_commit_surge", "stability_score", "pass_fail_ratio"]
V3_NAMES = ["test_age", "failure_rate", "recent_failure_rate", "weighted_failure_rate",
            "flakiness_rate", "failure_trend", "last_verdict", "time_since_failure",
            "consecutive_failures", "max_consecutive_failures", "execution_frequency",
            "test_novelty", "commit_count", "cr_count"]
SELECTED_INDICES = [0, 1, 2, 3, 7, 9, 13, 20, 21, 23]
DECAYS = ("exponential", "linear", "inverse", "uniform")
# end of fixed values

KEYS = [*BUILD, "tc_key", "build_idx"]


def _d(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("double")


def _or(c, default) -> Column:
    return F.coalesce(_d(c), F.lit(float(default)) if not isinstance(default, Column) else default)


def _ratio(a, b) -> Column:
    return _d(a) / F.nullif(_d(b), F.lit(0.0))


def _if_seen(value: Column, otherwise) -> Column:
    return F.when(F.col("n") > 0, _d(value)).otherwise(F.lit(float(otherwise)))


def not_pass(df: DataFrame) -> DataFrame:
    return df.withColumn("fail", fail_from_code(F.col("verdict"), "not_pass"))


def commit_total() -> Column:
    return F.greatest(F.col("n_commits") + F.col("n_crs"), F.lit(1)).cast("double")


# ---- single features ------------------------------------------------------

def failure_rates(df: DataFrame, windows: Sequence[int] = (2, 3, 5, 10, 20)) -> DataFrame:
    h = history(df, rates=windows, want=["n", "failures", *[f"rate_{k}" for k in windows]])
    return h.withColumn("failure_rate", _or(_ratio("failures", "n"), 0)).withColumns(
        {f"rate_{k}": _or(f"rate_{k}", 0) for k in windows})


def flakiness(df: DataFrame) -> DataFrame:
    h = history(df, want=["n", "flips", "exact_flips"])
    return h.withColumns({
        "flakiness_rate": F.when(F.col("n") > 1, _d("flips") / (F.col("n") - 1)).otherwise(0.0),
        "status_changes": _d("exact_flips") / F.greatest("n", F.lit(1)),
    })


def last_event_age(df: DataFrame, never_failed: float = 999.0) -> DataFrame:
    """Builds since the last failure, pass, first and last execution, seen from this build."""
    h = history(df, want=["n", "first_idx", "last_idx", "last_fail_idx", "last_pass_idx"])
    idx = F.col("build_idx")
    return h.withColumns({
        "since_fail": _or(idx - F.col("last_fail_idx"), never_failed),
        "since_pass": _or(idx - F.col("last_pass_idx"), never_failed),
        "test_age": _or(idx - F.col("first_idx"), 0),
        "builds_since_change": _or(idx - F.col("last_idx"), 0),
    })


def time_since_failure(df: DataFrame, cap: float = 50.0) -> DataFrame:
    h = history(df, want=["n", "last_idx", "last_fail_idx"])
    return h.withColumn("time_since_failure", tsf(cap))


def tsf(cap: float = 50.0) -> Column:
    return _or(F.least((F.col("last_idx") - F.col("last_fail_idx")) / F.lit(cap), F.lit(1.0)), 1)


def exec_frequency(n="n") -> Column:
    return _d(n) / (F.col("last_idx") - F.col("first_idx") + 1)


def execution_frequency(df: DataFrame, unseen: float = 0.5) -> DataFrame:
    h = history(df, want=["n", "first_idx", "last_idx"])
    return h.withColumn("execution_frequency", _if_seen(exec_frequency(), unseen))


def trend_features(df: DataFrame, as_temporal: bool = False) -> DataFrame:
    h = history(df, want=["n", "failures", "rate_2", "rate_5", "rate_10"])
    rate = _ratio("failures", "n")
    r2, r5, r10 = (F.col(f"rate_{k}") for k in (2, 5, 10))
    if as_temporal:
        trend, acc = r5 - r10, F.when(F.col("n") >= 2, r5 - r2).otherwise(0.0)
        dec, flat = F.coalesce((rate - r5) / F.nullif(rate, F.lit(0.0)), F.lit(0.0)), 0.0
    else:
        trend, acc = r5 - rate, r2 - r5
        dec, flat = F.coalesce(r5 / F.nullif(rate, F.lit(0.0)), F.lit(1.0)), 1.0
    return h.withColumns({
        "failure_trend": _if_seen(trend, 0), "acceleration": _if_seen(acc, 0),
        "deceleration_factor": _if_seen(dec, flat),
    })


def stability_features(df: DataFrame) -> DataFrame:
    """Stability, pass/fail ratio, stability of the last five, builds touched."""
    h = history(df, want=["n", "failures", "flips", "fail_flips_5"])
    flaky = F.when(F.col("n") > 1, F.col("flips") / (F.col("n") - 1)).otherwise(0.0)
    recent = F.least("n", F.lit(5))
    return h.withColumns({
        "stability_score": 1.0 - flaky,
        "pass_fail_ratio": (F.col("n") - F.col("failures")) / (F.col("failures") + 1),
        "recent_stability": F.when(recent > 1, 1.0 - F.col("fail_flips_5") / (recent - 1)).otherwise(1.0),
        "builds_affected": F.col("n"),
    })


def novelty(df: DataFrame) -> DataFrame:
    """First-appearance flag; commits above 1.5 times the average per execution."""
    h = history(df, want=["n"])
    avg = commit_total() / F.greatest("n", F.lit(1))
    return h.withColumns({
        "test_novelty": (F.col("n") == 0).cast("double"), "commit_count": commit_total(),
        "avg_commits_per_execution": avg,
        "recent_commit_surge": F.when(F.col("n") > 0, (commit_total() > avg * 1.5).cast("double")).otherwise(0.0),
    })


def decay_weights(kind: str, cycles: int = 10, factor: float = 0.8) -> list[float]:
    """Weight of the verdict k back, k = 1 first, summing to 1."""
    raw = {
        "exponential": lambda k: factor ** (k - 1), "linear": lambda k: cycles + 1 - k,
        "inverse": lambda k: 1.0 / k, "uniform": lambda k: 1.0,
    }[kind]
    weights = [raw(k) for k in range(1, cycles + 1)]
    total = sum(weights)
    return [w / total for w in weights]


def priority_expr(kind: str = "exponential") -> Column:
    terms = [F.when(F.col(f"verdict_{k}") == 1, F.lit(w)).otherwise(0.0)
             for k, w in enumerate(decay_weights(kind), start=1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def priority_score(df: DataFrame, kinds: Sequence[str] = ("exponential",),
                   carried: DataFrame | None = None) -> DataFrame:
    """Weighted sum of the last ten verdicts. Earlier splits are carried in as rows."""
    rows = df.withColumn("_here", F.lit(True))
    if carried is not None:
        rows = rows.unionByName(carried.withColumn("_here", F.lit(False)), allowMissingColumns=True)
    h = history(rows, want=[f"verdict_{k}" for k in range(1, 11)]).filter("_here").drop("_here")
    return h.withColumns({f"priority_{k}" if len(kinds) > 1 else "priority_score": priority_expr(k) for k in kinds})


def recent_status(df: DataFrame) -> DataFrame:
    """Nine columns on the newest verdicts. Needs the exact-fail rule in `fail`."""
    ks = (1, 2, 3, 5, 10)
    h = history(df, want=["n", "exact_flips", "pass_run", "first_verdict", "exact_rate_10",
                          *[f"verdict_{k}" for k in ks]])
    return h.withColumns(status_exprs())


def status_exprs() -> dict[str, Column]:
    code = lambda c: F.when(F.col(c) < 2, _d(c)).otherwise(0.5)
    hit = lambda c: (F.col(c) == 1).cast("double")
    out = {f"status_last_{k}": code(f"verdict_{k}") for k in (1, 2, 3, 5, 10)}
    out["distance"] = F.when(F.col("n") >= 2, F.abs(hit("verdict_1") - hit("first_verdict"))).otherwise(0.0)
    out["status_changes"] = _d("exact_flips") / F.greatest("n", F.lit(1))
    out["cycles_since_fail"] = F.least("pass_run", F.lit(20)) / 20.0
    out["fail_rate_last_10"] = _or("exact_rate_10", 0)
    return out


# ---- feature vectors ------------------------------------------------------

def features_v2_temporal(df: DataFrame, as_published: bool = False) -> DataFrame:
    """29 look-back columns. The published code never updates novelty, builds affected,
    stability and pass/fail ratio; `as_published` keeps those frozen values."""
    h = history(not_pass(df), want=[
        "n", "exact_failures", "exact_passes", "exact_n", "raw_flips_10", "exact_fail_run", "exact_pass_run",
        "max_exact_fail_run", "first_idx", "last_idx", "last_exact_fail_idx", "last_exact_pass_idx",
        "rate_2", "rate_5", "rate_10"])
    idx, n, last = F.col("build_idx"), F.col("n"), F.col("last_idx")
    fr = _or(_ratio("exact_failures", "exact_n"), 0)
    flaky = F.when(n > 1, F.col("raw_flips_10") / F.least(n, F.lit(10))).otherwise(0.0)
    seen = {
        "test_age": idx - F.col("first_idx"), "failure_rate": fr, "recent_failure_rate": F.col("rate_5"),
        "flakiness_rate": flaky, "execution_count": n, "failure_count": F.col("exact_failures"),
        "pass_count": F.col("exact_passes"), "consecutive_failures": F.col("exact_fail_run"),
        "consecutive_passes": F.col("exact_pass_run"), "max_consecutive_failures": F.col("max_exact_fail_run"),
        "last_failure_age": _or(last - F.col("last_exact_fail_idx"), -1),
        "last_pass_age": _or(last - F.col("last_exact_pass_idx"), -1),
        "execution_frequency": exec_frequency("exact_n"),
        "failure_trend": F.col("rate_5") - F.col("rate_10"), "recent_execution_count": F.least(n, F.lit(10)),
        "very_recent_failure_rate": F.col("rate_2"), "medium_term_failure_rate": F.col("rate_10"),
        "acceleration": F.when(n >= 2, F.col("rate_5") - F.col("rate_2")).otherwise(0.0),
        "deceleration_factor": F.coalesce((fr - F.col("rate_5")) / F.nullif(fr, F.lit(0.0)), F.lit(0.0)),
        "builds_since_change": idx - last,
    }
    cols = {k: _if_seen(v, 0) for k, v in seen.items()}
    avg = commit_total() / F.greatest(n, F.lit(1))
    cols |= {
        "commit_count": commit_total(), "cr_count": _d("n_crs"), "commit_count_actual": _d("n_commits"),
        "avg_commits_per_execution": avg,
        "recent_commit_surge": _if_seen((commit_total() > avg * 1.5).cast("int"), 0),
    }
    if as_published:
        cols |= {"test_novelty": F.lit(1.0), "builds_affected": _if_seen(F.lit(0), 1),
                 "stability_score": _if_seen(F.lit(1), 0.5), "pass_fail_ratio": _if_seen(F.lit(0), 1)}
    else:
        ratio = F.col("exact_passes") / (F.col("exact_failures") + 1)
        cols |= {"test_novelty": (n == 0).cast("double"), "builds_affected": _if_seen(n, 1),
                 "stability_score": _if_seen(1 - flaky, 0.5), "pass_fail_ratio": _if_seen(ratio, 1)}
    return h.select(*KEYS, *[cols[c].alias(c) for c in V2_NAMES])


def features_selected(v2: DataFrame, indices: Sequence[int] = tuple(SELECTED_INDICES)) -> DataFrame:
    return v2.select(*KEYS, *[V2_NAMES[i] for i in indices])


def _v3_seen(idx: Column) -> dict[str, Column]:
    rate = _ratio("failures", "n")
    return {
        "test_age": idx - F.col("first_idx"), "failure_rate": rate, "recent_failure_rate": F.col("rate_10"),
        "weighted_failure_rate": F.col("decayed_rate"),
        "flakiness_rate": F.when(F.col("n") > 1, F.col("flips") / (F.col("n") - 1)).otherwise(0.0),
        "failure_trend": F.col("rate_10") - rate, "last_verdict": 1 - F.col("fail_1"),
        "time_since_failure": tsf(), "consecutive_failures": F.col("fail_run"),
        "max_consecutive_failures": F.col("max_fail_run"), "execution_frequency": exec_frequency(),
    }


_V3_HISTORY = ["n", "failures", "flips", "decayed_rate", "first_idx", "last_idx", "last_fail_idx",
               "fail_run", "max_fail_run", "rate_10", "fail_1"]
_V3_UNSEEN = {"last_verdict": 1, "time_since_failure": 1, "execution_frequency": 0.5}


def features_v3_temporal(df: DataFrame, alpha: float = 0.1) -> DataFrame:
    h = history(not_pass(df), alpha=alpha, want=_V3_HISTORY)
    cols = {k: _if_seen(v, _V3_UNSEEN.get(k, 0)) for k, v in _v3_seen(F.col("build_idx")).items()}
    cols |= {"test_novelty": (F.col("n") == 0).cast("double"), "commit_count": commit_total(), "cr_count": _d("n_crs")}
    return h.select(*KEYS, *[cols[c].alias(c) for c in V3_NAMES])


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population std, min, max and exact median, one row per feature; nulls where a
    feature has no values."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), _d(c).alias("value")) for c in columns
    ])).alias("x")).select("x.feature", "x.value")
    basic = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return basic.join(exact_quantiles(long, ["feature"], "value", {"median": 0.5}), "feature", "left")


def cold_start_defaults(features: DataFrame, train: DataFrame, means: Sequence[str] = (),
                        medians: Sequence[str] = (), constants: dict[str, float] | None = None) -> DataFrame:
    """Fill nulls of unseen tests with training means, medians or constants."""
    return fill_defaults(features, default_row(train, means, medians), means, medians, constants)


def default_row(train: DataFrame, means: Sequence[str] = (), medians: Sequence[str] = ()) -> DataFrame:
    """One row of training statistics, all from one count of the values of all columns."""
    names = list(dict.fromkeys([*means, *medians]))
    counts = materialize(value_counts(train.withColumn("_row", F.lit(0)), ["_row", *names]), "values")
    of = lambda c, v: F.sum(F.when(F.col("feature") == c, v))
    known = F.when(F.col("value").isNotNull(), F.col("_c"))
    row = counts.agg(F.coalesce(of("_row", F.col("_c")), F.lit(0)).alias("_m_rows"),
                     *[(of(c, F.col("value") * F.col("_c")) / of(c, known)).alias(f"_m_{c}") for c in means])
    if medians:
        half = quantiles_of_counts(counts.filter(F.col("feature").isin(*medians) & F.col("value").isNotNull()), ["feature"], "value", {"q": 0.5})
        middle = half.agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"_m_{c}") for c in medians])
        row = row.crossJoin(F.broadcast(middle))  # one row each
    return row


def fill_defaults(features, row, means, medians, constants) -> DataFrame:
    fills = {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in [*means, *medians]}
    fills |= {c: _or(c, v) for c, v in (constants or {}).items()}
    return features.crossJoin(F.broadcast(row)).withColumns(fills).select(*features.columns)


# fixed values: features of a test that the training split never saw
_V1_DEFAULTS = {"means": ["failure_rate", "recent_failure_rate"], "medians": ["flakiness_rate"],
                "constants": {"test_age": 0}}
_V2_DEFAULTS = {
    "means": ["failure_rate", "recent_failure_rate", "very_recent_failure_rate", "medium_term_failure_rate"],
    "medians": ["flakiness_rate"],
    "constants": {"test_age": 0, "execution_count": 1, "failure_count": 0, "pass_count": 1,
                  "consecutive_failures": 0, "consecutive_passes": 1, "max_consecutive_failures": 0,
                  "last_failure_age": 999, "last_pass_age": 0, "execution_frequency": 0.1,
                  "failure_trend": 0, "recent_execution_count": 1, "acceleration": 0,
                  "deceleration_factor": 1, "builds_since_change": 0, "builds_affected": 1,
                  "stability_score": 0.5, "pass_fail_ratio": 1},
}
_V3_DEFAULTS = {
    "means": ["failure_rate", "recent_failure_rate", "weighted_failure_rate"],
    "medians": ["flakiness_rate", "execution_frequency"],
    "constants": {"test_age": 0, "failure_trend": 0, "last_verdict": 1, "time_since_failure": 1,
                  "consecutive_failures": 0, "max_consecutive_failures": 0},
}
# end of fixed values

_SNAP_WANT = ["n", "failures", "flips", "decayed_rate", "first_idx", "last_idx", "last_fail_idx",
              "last_pass_idx", "fail_run", "pass_run", "max_fail_run", "rate_2", "rate_5", "rate_10", "fail_1"]


def _snapshot_features(train: DataFrame, rows: DataFrame, names: Sequence[str], defaults: dict) -> DataFrame:
    """History of the whole training split put on any rows. Training rows would see
    their own future, so use it for later rows; look-back features are the other kind."""
    snap = materialize(snapshot(not_pass(train), want=_SNAP_WANT))  # one row per test, read several times
    clock = project_sizes(train).withColumnRenamed("n_builds", "_train_builds")

    def apply(target: DataFrame) -> DataFrame:
        j = target.drop(*[c for c in _SNAP_WANT if c in target.columns])
        j = j.join(snap, TEST, "left").join(clock, "project", "left")
        return j.select(*KEYS, *[c.alias(k) for k, c in _snap_exprs().items() if k in names])

    stats = default_row(apply(train), defaults["means"], defaults["medians"])
    return fill_defaults(apply(rows), stats, **defaults).select(*KEYS, *names)


def _snap_exprs() -> dict[str, Column]:
    n, last = F.col("n"), F.col("last_idx")
    now = F.least("build_idx", "_train_builds")
    rate = _ratio("failures", "n")
    flaky = F.when(n > 1, F.col("flips") / (n - 1)).when(n == 1, 0.0)
    avg = commit_total() / F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))
    return {
        "test_age": _d(now - F.col("first_idx")), "failure_rate": rate, "recent_failure_rate": F.col("rate_5"),
        "flakiness_rate": flaky, "execution_count": _d(n), "failure_count": _d("failures"),
        "pass_count": _d(n - F.col("failures")), "consecutive_failures": _d("fail_run"),
        "consecutive_passes": _d("pass_run"), "max_consecutive_failures": _d("max_fail_run"),
        "last_failure_age": F.when(n > 0, _or(last - F.col("last_fail_idx"), 999)),
        "last_pass_age": F.when(n > 0, _or(last - F.col("last_pass_idx"), 999)),
        "execution_frequency": exec_frequency(), "failure_trend": F.col("rate_5") - rate,
        "recent_execution_count": F.when(n > 0, _d(F.least(n, F.lit(5)))),
        "very_recent_failure_rate": F.col("rate_2"), "medium_term_failure_rate": F.col("rate_10"),
        "acceleration": F.col("rate_2") - F.col("rate_5"),
        "deceleration_factor": F.when(n > 0, F.coalesce(F.col("rate_5") / F.nullif(rate, F.lit(0.0)), F.lit(1.0))),
        "builds_since_change": _d(now - last),
        "commit_count": commit_total(),
        "test_novelty": F.when(now == F.col("first_idx"), 1.0).when(n.isNull(), 1.0).otherwise(0.0),
        "builds_affected": _d(n), "cr_count": _d("n_crs"), "commit_count_actual": _d("n_commits"),
        "avg_commits_per_execution": avg,
        "recent_commit_surge": F.when(n > 0, (commit_total() > avg * 1.5).cast("double")).otherwise(0.0),
        "stability_score": 1.0 - flaky,
        "pass_fail_ratio": (n - F.col("failures")) / (F.col("failures") + 1),
    }


def features_v1(train: DataFrame, rows: DataFrame) -> DataFrame:
    return _snapshot_features(train, rows, V1_NAMES, _V1_DEFAULTS)


def features_v2_snapshot(train: DataFrame, rows: DataFrame) -> DataFrame:
    return _snapshot_features(train, rows, V2_NAMES, _V2_DEFAULTS)


def features_v3_snapshot(train: DataFrame, rows: DataFrame) -> DataFrame:
    snap = materialize(snapshot(not_pass(train), want=_V3_HISTORY))
    clock = project_sizes(train).withColumnRenamed("n_builds", "_train_builds")

    def apply(target: DataFrame) -> DataFrame:
        j = target.join(snap, TEST, "left").join(clock, "project", "left")
        now = F.least("build_idx", "_train_builds")
        cols = {k: F.when(F.col("n") > 0, _d(v)) for k, v in _v3_seen(now).items()}
        cols |= {"test_novelty": F.when(now == F.col("first_idx"), 1.0).when(F.col("n").isNull(), 1.0).otherwise(0.0),
                 "commit_count": commit_total(), "cr_count": _d("n_crs")}
        return j.select(*KEYS, *[cols[c].alias(c) for c in V3_NAMES])

    stats = default_row(apply(train), _V3_DEFAULTS["means"], _V3_DEFAULTS["medians"])
    return fill_defaults(apply(rows), stats, **_V3_DEFAULTS)


_RUN_WANT = ["n", "failures", "duration_sum", "max_duration", "last_duration", "fail_run", "pass_run",
             "rate_10", "fail_1"]


def _normalised() -> dict[str, Column]:
    n = F.col("n")
    top = F.greatest(F.col("max_duration"), F.lit(0.0)) + F.lit(1e-6)
    return {
        "last_verdict": F.col("fail_1"), "last_duration": F.col("last_duration") / top,
        "failure_rate": _ratio("failures", "n"), "recent_failure_rate": F.col("rate_10"),
        "execution_share": n / (F.col("build_idx") + 1),
        "mean_duration": F.col("duration_sum") / n / top,
        "max_duration": F.greatest(F.col("max_duration"), F.lit(0.0)) / top,
        "since_failure": F.col("pass_run") / (n + 1),
        "same_verdict_run": F.when(F.col("fail_1") == 1, F.col("fail_run")).otherwise(F.col("pass_run")) / (n + 1),
    }


def features_deeporder8(df: DataFrame) -> DataFrame:
    h = history(df, want=_RUN_WANT)
    order = ["last_verdict", "last_duration", "failure_rate", "recent_failure_rate", "execution_share",
             "mean_duration", "since_failure", "same_verdict_run"]
    unseen = {"last_verdict": 0.5, "since_failure": 1}
    e = _normalised()
    return h.select(*KEYS, "fail", *[_if_seen(e[c], unseen.get(c, 0)).alias(c) for c in order])


def features_failrank8(df: DataFrame) -> DataFrame:
    h = history(df, want=_RUN_WANT)
    order = ["failure_rate", "recent_failure_rate", "mean_duration", "max_duration", "execution_share",
             "last_verdict", "since_failure", "same_verdict_run"]
    e = _normalised()
    return h.select(*KEYS, "fail", *[_if_seen(e[c], 0).alias(c) for c in order])


def features_noderank10(df: DataFrame, as_published: bool = False) -> DataFrame:
    """DeepOrder's eight, a failure velocity and execution regularity.

    The velocity is the failure rate of the newer half of a test's executions minus that of the
    older half, its first floor(n / 2). The failures of the first h executions are those seen before
    execution h + 1, so they come from an equi-join of the history with itself, addressed by
    position. `as_published` estimates the older half's failures from the overall rate at the last
    odd count.
    """
    h = history(df, want=_RUN_WANT)
    n = F.col("n")
    if as_published:
        even = F.when(n % 2 == 1, n - 1).otherwise(n - 2)
        known = F.when(n % 2 == 1, F.col("failures")).otherwise(F.col("failures") - F.col("fail_1"))
        old_n = even / 2
        old_f = F.floor(known * old_n / (even + 1))
    else:
        h = materialize(h, "history")  # read as both sides of the join
        first = h.select(*TEST, F.col("n").alias("_half"), F.col("failures").alias("_old"))
        h = h.withColumn("_half", F.when(n >= 3, F.floor(n / 2))).join(first, [*TEST, "_half"], "left")
        old_n, old_f = F.col("_half"), F.col("_old")
    velocity = F.when(n >= 3, (F.col("failures") - old_f) / (n - old_n) - old_f / old_n).otherwise(0.0)
    order = ["last_verdict", "last_duration", "failure_rate", "recent_failure_rate", "execution_share",
             "mean_duration", "since_failure", "same_verdict_run", "failure_velocity", "regularity"]
    unseen = {"last_verdict": 0.5, "since_failure": 1}
    e = _normalised() | {
        "failure_velocity": velocity,
        "regularity": 1.0 - (F.col("build_idx") - n) / (F.col("build_idx") + 1),
    }
    return h.select(*KEYS, "fail", *[_if_seen(e[c], unseen.get(c, 0)).alias(c) for c in order])


def features_tcpnet12(df: DataFrame) -> DataFrame:
    h = history(df, want=["n", "failures", "flips", "fail_run", "first_idx", "last_fail_idx", "fail_1",
                          "rate_2", "rate_3", "rate_5", "rate_10"])
    idx = F.col("build_idx")
    return h.select(
        *KEYS, "fail", _d("duration").alias("duration"), _or("fail_1", 0).alias("last_result"),
        *[_or(f"rate_{k}", 0).alias(f"status_last_{k}") for k in (2, 3, 5, 10)],
        _or(_ratio("failures", "n"), 0).alias("failure_rate"),
        _or(idx - F.col("last_fail_idx"), _d(idx)).alias("since_fail"),
        _d("n").alias("execution_count"), _d("flips").alias("status_changes"),
        _d("fail_run").alias("failure_streak"), _or(idx - F.col("first_idx"), 0).alias("test_age"))


def oldest_last(h: DataFrame) -> DataFrame:
    """(project, build_idx, oldest): at each build, the oldest last execution of any test seen before.

    An execution in build b is its test's last one until the test runs again, so b is alive up to the
    latest such build of its tests, and for ever if one of them never runs again. The oldest build alive
    at c is the first whose reach is c or more; with running maxima of the reach, that is the number of
    builds whose maximum is below c, a running sum over the clock.
    """
    again = h.filter("n > 0").groupBy("project", F.col("last_idx").alias("build_idx")).agg(F.max(F.col("build_idx")).alias("_reach"))
    ever = h.groupBy(*TEST).agg(F.max("build_idx").alias("build_idx")).select("project", "build_idx").distinct()
    reach = again.join(ever.withColumn("_ever", F.lit(True)), ["project", "build_idx"], "full").select(
        "project", "build_idx", F.when(F.col("_ever"), F.lit((1 << 62))).otherwise(F.col("_reach")).alias("_reach"))
    so_far = Window.partitionBy("project").orderBy("build_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = reach.withColumn("_top", F.max("_reach").over(so_far)).groupBy("project", (F.col("_top") + 1).alias("build_idx")).agg(
        F.count(F.lit(1)).alias("_gone"))
    clock = h.select("project", "build_idx").distinct().join(ends, ["project", "build_idx"], "left").na.fill(0, ["_gone"])
    return running_sums(clock, ["project"], [F.col("build_idx")], {"oldest": "_gone"}).select("project", "build_idx", "oldest")


def state_retecs6(df: DataFrame, as_published: bool = False) -> DataFrame:
    """Duration and recency scaled to [0, 1] and the last four verdicts, 1 = pass.

    Recency is scaled by the newest and the oldest last execution of any test. `as_published`
    keeps the oldest one at the first build, from which the published code never advances.
    """
    h = history(df, want=["n", "last_idx", "fail_1", "fail_2", "fail_3", "fail_4"])
    span = df.groupBy(*BUILD).agg(F.min("duration").alias("_lo"), F.max("duration").alias("_hi"),
                                  F.count(F.lit(1)).alias("_tests"))
    idx = F.col("build_idx")
    dur = F.when((F.col("_hi") > F.col("_lo")) & (F.col("_tests") > 1),
                 (F.col("_hi") - F.col("duration")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    if as_published:
        since = idx - F.col("last_idx")
        rec = F.when(F.col("n") == 0, 0.0).when(idx > 1, (idx - since) / (idx - 1)).otherwise(0.5)
    else:
        h = materialize(h, "history")  # read for the clock and for the rows
        h = h.join(oldest_last(h), ["project", "build_idx"])
        newest = idx - 1
        rec = F.when(F.col("n") == 0, 0.0).when(newest > F.col("oldest"), (F.col("last_idx") - F.col("oldest")) / (newest - F.col("oldest"))).otherwise(0.5)
    return h.join(span, BUILD).select(
        *KEYS, "fail", dur.alias("state_duration"), rec.alias("state_recency"),
        *[_or(1 - F.col(f"fail_{k}"), 1).alias(f"state_v{k}") for k in range(1, 5)])


def imputation_mask(df: DataFrame, min_history: int = 2) -> DataFrame:
    h = history(df, want=["n"])
    return h.withColumn("needs_imputation", (F.coalesce("n", F.lit(0)) < min_history).cast("int"))


def cumulative_features(df: DataFrame) -> DataFrame:
    """Totals over earlier rows. A new test's average duration is its own duration, and
    recent failures span eleven earlier rows, both as published."""
    h = history(df, want=["n", "failures", "duration_sum", "recent_fails_11", "last_fail_idx"])
    n, idx = F.col("n"), F.col("build_idx")
    return h.select(
        *KEYS, n.alias("total_executions"), F.col("failures").alias("total_failures"),
        F.coalesce(_ratio("duration_sum", "n"), _d("duration")).alias("avg_duration"),
        _or(_ratio("failures", "n"), 0).alias("failure_rate"), (n == 0).cast("int").alias("is_new_test"),
        F.least(n, F.lit(10)).alias("recent_executions"), F.col("recent_fails_11").alias("recent_failures"),
        F.coalesce(idx - F.col("last_fail_idx"), idx + 1).alias("last_failure_recency"))


def node_features(features: DataFrame, executions: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Newest feature row of each test; the label says whether it ever failed."""
    cols = [c for c in features.columns if c not in ("project", "tc_key", "fail", "label")]
    newest = features.groupBy(*TEST).agg(F.max_by(F.struct(*cols), "build_idx").alias("_r"))
    label = executions.groupBy(*TEST).agg(F.max("fail").alias("label"))
    out = newest.select(*TEST, "_r.*").join(label, TEST)
    return out if tests is None else out.join(tests, TEST, "left_semi")
