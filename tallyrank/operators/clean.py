"""Cleaning, label work and row filters on execution tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrank.functions.hashing import hash_int
from tallyrank.functions.verdict import FAIL, PASS, fail_from_code, strip, verdict_code
from tallyrank.operators.scale import number_rows
from tallyrank.session import materialize

BUILD = ["project", "build_id"]
TEST = ["project", "tc_key"]


def clean_strict(df: DataFrame, summary: str = "summary", result: str = "result",
                 steps: str | None = "steps", min_share: float = 0.1) -> DataFrame:
    """Drop rows without summary or verdict; steps count as required only when more than
    `min_share` of the rows have some (other than white space). `steps=None` never requires them."""
    required = [summary, result]
    if steps and steps in df.columns:
        share = df.agg(F.avg(F.when(strip(F.col(steps)) != "", 1.0).otherwise(0.0))).first()[0] or 0.0
        if share > min_share:
            required.append(steps)
    out = df.na.drop(subset=required)
    text = [c for c in (summary, steps, result) if c and c in df.columns]
    return out.withColumns({c: strip(F.coalesce(F.col(c), F.lit(""))) for c in text})


def clean_lenient(df: DataFrame, text_columns: Sequence[str] = ("summary", "steps", "commit"),
                  result: str = "result") -> DataFrame:
    """Keep every row; missing text becomes the empty string, absent columns are made."""
    cols = {
        c: strip(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
        for c in text_columns
    }
    if result in df.columns:
        cols[result] = strip(F.coalesce(F.col(result), F.lit("")))
    return df.withColumns(cols)


def encode_binary(df: DataFrame, strategy: str = "pass_vs_all", result: str = "result") -> DataFrame:
    """`label` = 1 for pass (`pass_vs_all`, `pass_vs_fail`) or for fail (`fail_vs_all`)."""
    r = strip(F.col(result))
    if strategy == "pass_vs_all":
        return df.withColumn("label", (r == "Pass").cast("int"))
    if strategy == "pass_vs_fail":
        return df.filter(r.isin("Pass", "Fail")).withColumn("label", (r == "Pass").cast("int"))
    if strategy == "fail_vs_all":
        return df.withColumn("label", (r == "Fail").cast("int"))
    raise ValueError(f"unknown strategy {strategy!r}")


def encode_multiclass(df: DataFrame, column: str = "result") -> DataFrame:
    """`label` numbers the distinct values in sorted order from 0; null is a value and comes first."""
    names = number_rows(df.select(column).distinct(), [], [F.col(column)], "_rn")
    names = names.select(F.col(column).alias("_name"), (F.col("_rn") - 1).alias("label"))
    return df.join(names, F.col(column).eqNullSafe(F.col("_name"))).drop("_name")


def class_weights(df: DataFrame, label: str = "label", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Balanced weights n / (k * n_c), k = classes present; an absent class gets 1."""
    spark = df.sparkSession
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    wanted = spark.createDataFrame([(int(c),) for c in classes], f"{label} int")
    return (
        wanted.join(counts, label, "left").crossJoin(F.broadcast(total))
        .select(
            F.col(label),
            F.coalesce(F.col("n"), F.lit(0)).alias("n"),
            F.coalesce(F.col("total") / (F.col("k") * F.col("n")), F.lit(1.0)).alias("weight"),
        )
    )


def collapse_executions(df: DataFrame, order: Sequence[str] = ("exec_ts", "exec_id"),
                        fail_rule: str = "fail_only", sums: Sequence[str] = (),
                        keep_first: Sequence[str] = ("build_start",)) -> DataFrame:
    """One row per (build, test): worst verdict, last duration, summed extras.

    All aggregates combine on the map side, so repeats of one hot pair cost nothing
    after the shuffle. Fail outranks other verdicts, which outrank pass.
    """
    code = verdict_code(F.col("result"))
    severity = F.when(code == FAIL, 2).when(code == PASS, 0).otherwise(1)
    last = F.struct(*order)
    out = df.groupBy(*BUILD, "tc_key").agg(
        *[F.min(c).alias(c) for c in keep_first],
        F.max_by("result", F.struct(severity, *order)).alias("result"),
        F.max_by("duration", last).alias("duration"),
        F.max("exec_ts").alias("exec_ts"),
        *[F.sum(c).alias(c) for c in sums],
        F.count(F.lit(1)).alias("n_rows"),
    )
    out = out.withColumn("verdict", verdict_code(F.col("result")))
    return out.withColumn("fail", fail_from_code(F.col("verdict"), fail_rule))


def failing_builds(df: DataFrame) -> DataFrame:
    return df.groupBy(*BUILD).agg(F.max("fail").alias("_f")).filter("_f = 1").select(*BUILD)


def builds_with_failures(df: DataFrame) -> DataFrame:
    """Keep rows of builds that have at least one failure."""
    return df.join(failing_builds(df), BUILD, "left_semi")


def filter_projects(df: DataFrame, min_builds: int = 1, min_failures: int = 1) -> DataFrame:
    per_build = df.groupBy(*BUILD).agg(F.sum("fail").alias("f"))
    good = (
        per_build.groupBy("project")
        .agg(F.count(F.lit(1)).alias("builds"), F.sum("f").alias("failures"))
        .filter((F.col("builds") >= min_builds) & (F.col("failures") >= min_failures))
    )
    return df.join(materialize(good.select("project"), "good"), "project", "left_semi")


def last_builds(df: DataFrame, n: int) -> DataFrame:
    """Newest n builds of each project; the clock is dense, so this is a comparison."""
    # stored, so that its size is known: rows stay where they are while it is small
    newest = materialize(df.groupBy("project").agg(F.max("build_idx").alias("_hi")), "newest")
    return (
        df.join(newest, "project").filter(F.col("build_idx") > F.col("_hi") - n).drop("_hi")
    )


def last_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Newest n rows overall; sort plus limit becomes a distributed top-n."""
    return df.orderBy(*order).limit(n)


def cap_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A uniform sample of n rows without replacement, the same one on every run."""
    pick = hash_int(*[F.col(k) for k in key], seed)
    return df.withColumn("_h", pick).orderBy("_h", *key).limit(n).drop("_h")


def label_distribution(df: DataFrame, *by: str) -> DataFrame:
    """Rows, builds, tests, failures and failure rate for each value of `by`.

    Each part is combined before it is shuffled, and distinct counts go through a first grouping, so a
    hot value is spread out.
    """
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("fail").alias("n_failures"))
    builds = df.select(*by, *[c for c in BUILD if c not in by]).distinct()
    tests = df.select(*by, *[c for c in TEST if c not in by]).distinct()
    nb = builds.groupBy(*by).agg(F.count(F.lit(1)).alias("n_builds"))
    nt = tests.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tests"))
    if not by:
        out = rows.crossJoin(nb).crossJoin(nt)
    else:
        # a null value is a group like any other
        out = rows
        for side in (nb, nt):
            named = side.select(*[F.col(c).alias(f"_{c}") for c in by], side.columns[-1])
            same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
            out = out.join(named, same).drop(*[f"_{c}" for c in by])
    return out.withColumn("failure_rate", F.col("n_failures") / F.col("n_rows"))
