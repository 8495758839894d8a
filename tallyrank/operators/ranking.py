"""Ranking the tests of each build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions.hashing import hash_int
from tallyrank.operators.clean import BUILD
from tallyrank.operators.scale import HOT_ROWS, number_rows, running_sums


def rank_in_build(df: DataFrame, score: str = "score", sizes: DataFrame | None = None,
                  hot_rows: int = HOT_ROWS, name: str = "rank") -> DataFrame:
    """1 = highest score; ties go by test key."""
    return number_rows(df, BUILD, [F.col(score).desc_nulls_last(), F.col("tc_key")], name, hot_rows, sizes)


def rank_random(df: DataFrame, seed: int = 42, sizes: DataFrame | None = None) -> DataFrame:
    scored = df.withColumn("score", hash_int(F.col("project"), F.col("build_id"), F.col("tc_key"), seed).cast("double"))
    return rank_in_build(scored, sizes=sizes)


def since_failure() -> Column:
    """Whole builds between the last failure and now; the clock itself if none."""
    return F.coalesce(F.col("build_idx") - F.col("last_fail_idx") - 1, F.col("build_idx"))


def recency_score(as_published: bool = False) -> Column:
    """Most recently failed first. The published form sorts the other way round."""
    return since_failure().cast("double") * F.lit(1.0 if as_published else -1.0)


def recent_rate_score(n: int = 5) -> Column:
    return F.coalesce(F.col(f"rate_{n}"), F.lit(0.0))


def failure_rate_score(unknown: float = 0.0) -> Column:
    return F.coalesce(F.col("failures") / F.nullif(F.col("n"), F.lit(0)), F.lit(float(unknown)))


def with_greedy_score(hist: DataFrame) -> DataFrame:
    """0.5 recency + 0.3 failure rate + 0.2 novelty relative to the oldest test of the build."""
    age = F.coalesce(F.col("build_idx") - F.col("first_idx") - 1, F.lit(0))
    oldest = hist.groupBy(*BUILD).agg(F.greatest(F.max(age), F.lit(1)).alias("_oldest"))
    score = (
        0.5 / (1.0 + since_failure()) + 0.3 * failure_rate_score() + 0.2 * (1.0 - age / F.col("_oldest"))
    )
    return hist.join(oldest, BUILD).withColumn("score", score).drop("_oldest")


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k)


def top_pct(ranked: DataFrame, p: float) -> DataFrame:
    """The first max(1, ceil(p * n)) tests of each build."""
    sizes = ranked.groupBy(*BUILD).agg(F.count(F.lit(1)).alias("_n"))
    keep = F.greatest(F.ceil(F.col("_n") * F.lit(float(p))), F.lit(1))
    return ranked.join(sizes, BUILD).filter(F.col("rank") <= keep).drop("_n")


def rewards(ranked: DataFrame, kind: str = "tcfail") -> DataFrame:
    """`tcfail`: 1 for a failed test. `timerank`: all failures of the build for a failed
    test, for a passed one the failures ranked above it."""
    if kind == "tcfail":
        return ranked.withColumn("reward", F.col("fail").cast("double"))
    if kind != "timerank":
        raise ValueError(f"unknown reward {kind!r}")
    cum = running_sums(ranked, BUILD, [F.col("rank")], {"_above": "fail"})
    total = ranked.groupBy(*BUILD).agg(F.sum("fail").alias("_all"))
    return (
        cum.join(total, BUILD)
        .withColumn("reward", F.when(F.col("fail") == 1, F.col("_all")).otherwise(F.col("_above")).cast("double"))
        .drop("_above", "_all")
    )


def discretize_state(df: DataFrame) -> DataFrame:
    """Three duration buckets, three recency buckets and four last verdicts."""
    bucket = lambda c: F.least(F.floor(F.col(c) * 3), F.lit(2)).cast("int")
    return df.withColumns({
        "dur_bucket": bucket("state_duration"), "time_bucket": bucket("state_recency"),
        **{f"h{i}": F.round(F.col(f"state_v{i + 1}")).cast("int") for i in range(4)},
    })


def mean_reward(df: DataFrame) -> DataFrame:
    return df.groupBy("dur_bucket", "time_bucket", "h0", "h1", "h2", "h3").agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward")
    )
