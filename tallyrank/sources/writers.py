"""Sinks: rankings, grades, stored state, resumable results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.operators.metrics import apfd_summary, grand_mean
from tallyrank.operators.scale import exact_quantiles
from tallyrank.session import materialize, scratch_of

# fixed values: column order of the stored ranking
PRIORITIZED = ("build_id", "tc_key", "result", "label", "probability", "diversity_score", "priority_score", "rank")


def _write(df: DataFrame, path: str, fmt: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def prioritized(ranked: DataFrame) -> DataFrame:
    """Known columns that are present, in order, with the derived scores."""
    df = ranked.withColumns({"diversity_score": F.lit(0.0), "priority_score": F.col("probability")})
    return df.select(*[c for c in PRIORITIZED if c in df.columns])


def write_prioritized(ranked: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = ()) -> None:
    _write(prioritized(ranked), path, fmt, partition_by=partition_by)


def per_project(per_build: DataFrame) -> DataFrame:
    per_build = per_build if scratch_of(per_build) else materialize(per_build)  # read for the mean and the median
    g = per_build.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_builds_with_failures"), F.avg("apfd").alias("mean_apfd"), F.stddev_pop("apfd").alias("std_apfd"))
    return g.join(exact_quantiles(per_build, ["project"], "apfd", {"median_apfd": 0.5}), "project")


def aggregate_report(per_build: DataFrame) -> DataFrame:
    """One row: the summary over all builds, n_projects, n_builds_total, the unweighted mean, population
    deviation and median of the projects' means, and `per_project`, their reports in order of name."""
    projects = per_project(per_build)
    each = projects.agg(F.array_sort(F.collect_list(F.struct("project", "n_builds_with_failures", "mean_apfd", "std_apfd", "median_apfd"))).alias("per_project"))
    grand = grand_mean(per_build).select("n_projects", F.col("n_builds").alias("n_builds_total"), F.col("grand_mean").alias("grand_mean_apfd"),
                                         F.col("std").alias("grand_std_apfd"), F.col("median").alias("grand_median_apfd"))
    return apfd_summary(per_build).crossJoin(F.broadcast(grand)).crossJoin(F.broadcast(each))  # one row each


def write_apfd_reports(per_build: DataFrame, path: str) -> None:
    """Per build and per project as CSV, the aggregate as one JSON document."""
    per_build = materialize(per_build)
    _write(per_build, f"{path}/per_build", "csv")
    _write(per_project(per_build), f"{path}/per_project", "csv")
    _write(aggregate_report(per_build), f"{path}/aggregate", "json")


def rankings(ranked: DataFrame) -> DataFrame:
    return ranked.select("build_id", "rank", F.col("tc_key").alias("test_id"), F.col("fail").alias("label"))


def export_rankings(ranked: DataFrame, path: str, fmt: str = "csv") -> None:
    _write(rankings(ranked), path, fmt)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new_results(df: DataFrame, path: str, keys: Sequence[str] = ("project", "variant")) -> None:
    """Append rows whose key is not stored yet, so a stopped run can be resumed."""
    old = stored(df.sparkSession, path)
    new = df if old is None else df.join(old.select(*keys).distinct(), list(keys), "left_anti")
    _write(new, path, "parquet", mode="append")


def save_table(df: DataFrame, path: str) -> None:
    """Histories (one row per test) and graphs (one row per edge) are plain tables."""
    _write(df, path, "parquet")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free sum of row hashes over all rows."""
    cols = list(columns or df.columns)
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols])), 1, 12), 16, 10)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("fingerprint"))


def unchanged(df: DataFrame, saved: DataFrame, columns: Sequence[str] | None = None) -> bool:
    """Whether stored results made from `saved` are still valid."""
    return dataset_fingerprint(df, columns).exceptAll(saved).isEmpty()
