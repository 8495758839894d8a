"""The integer build clock and splits along it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.operators.clean import BUILD
from tallyrank.operators.scale import HOT_ROWS, number_rows
from tallyrank.session import materialize


def build_table(df: DataFrame, start: str = "build_start", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per build with `build_idx` = 0, 1, … by first start date, then build id.

    Without dates, builds are ordered by number, then by name.
    """
    if start in df.columns:
        builds = df.groupBy(*BUILD).agg(F.min(start).alias("_start"))
    else:
        builds = df.select(*BUILD).distinct().withColumn("_start", F.expr("try_cast(build_id as bigint)"))
    builds = materialize(builds, "builds")  # numbered in several passes, which must not make the rows again
    order = [F.col("_start").asc_nulls_last(), F.col("build_id")]
    clock = number_rows(builds, ["project"], order, "_rn", hot_rows)
    return clock.select(*BUILD, (F.col("_rn") - 1).alias("build_idx"))


def with_clock(df: DataFrame, start: str = "build_start", hot_rows: int = HOT_ROWS) -> DataFrame:
    return df.join(build_table(df, start, hot_rows), BUILD)


def project_sizes(df: DataFrame) -> DataFrame:
    """One row per project. It is stored: rows joined with it stay where they are while its known size is
    small, where a join of unknown size would send each project to one task."""
    return materialize(df.groupBy("project").agg((F.max("build_idx") + 1).alias("n_builds")), "projects")


def temporal_split(df: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """`split` by whole builds, cut at int(n * train) and int(n * (train + val))."""
    n = F.col("n_builds")
    idx = F.col("build_idx")
    part = (
        F.when(idx < F.floor(n * F.lit(train)), "train")
        .when(idx < F.floor(n * F.lit(train + val)), "val").otherwise("test")
    )
    return df.join(project_sizes(df), "project").withColumn("split", part).drop("n_builds")


def holdout_split(df: DataFrame, ratio: float = 0.8, inner: float = 0.1) -> DataFrame:
    """Last builds are test; the tail of the training builds is inner validation."""
    cut = F.floor(F.col("n_builds") * F.lit(ratio))
    inner_cut = F.floor(cut * F.lit(1 - inner))
    idx = F.col("build_idx")
    part = F.when(idx >= cut, "test").when(idx >= inner_cut, "val").otherwise("train")
    return df.join(project_sizes(df), "project").withColumn("split", part).drop("n_builds")


def expanding_folds(df: DataFrame, k: int = 5, min_train: int = 5) -> DataFrame:
    """Fold f trains on builds before f*size and tests on the next size builds.

    A row joins only the folds it belongs to: it is tested in one and trains the later ones.
    """
    size = F.floor(F.col("n_builds") / k)
    block = F.floor(F.col("build_idx") / F.greatest(size, F.lit(1)))
    folds = F.sequence(F.greatest(block, F.lit(1)), F.lit(k - 1).cast("bigint"))
    out = (
        df.join(project_sizes(df), "project")
        .withColumns({"_size": size, "_block": block})
        .filter((F.col("_block") <= k - 1) & (F.col("_size") >= 1))
        .withColumn("fold", F.explode(folds))
        .filter(F.col("fold") * F.col("_size") >= min_train)
        .withColumn("role", F.when(F.col("_block") == F.col("fold"), "test").otherwise("train"))
    )
    return out.drop("n_builds", "_size", "_block")


def check_disjoint(df: DataFrame, split: str = "split") -> DataFrame:
    """Number of builds that sit in more than one split; a sound split gives 0."""
    per = df.select(*BUILD, split).distinct().groupBy(*BUILD).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.count(F.lit(1)).alias("n_builds"),
        F.coalesce(F.sum((F.col("c") > 1).cast("bigint")), F.lit(0)).alias("n_shared"),
    )
