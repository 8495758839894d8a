"""Execution tables derived from the given tables.

`events` gives one project: an hour is a build, a user is a test, `error` is a failure.
`lineitem` with `orders` and `customer` gives one project per market segment: an order
is a build, a supplier is a test, return flag R is a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.operators.chronology import with_clock
from tallyrank.operators.clean import collapse_executions
from tallyrank.session import materialize, release

_prepared: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a file with fewer splits than cores, dealt to all cores. A table that fills
    the cluster on its own stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.lit("ev").alias("project"),
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("build_id"),
        F.date_trunc("hour", "ts").alias("build_start"),
        F.concat(F.lit("u"), F.col("user_id")).alias("tc_key"),
        F.when(F.col("event_type") == "error", "Fail").when(F.col("event_type") == "signup", "Blocked")
        .otherwise("Pass").alias("result"),
        F.col("value").alias("duration"),
        F.col("ts").alias("exec_ts"),
        F.col("event_id").alias("exec_id"),
        F.array(F.concat(F.lit("k"), k)).alias("commits"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("CR_"), k % 5))).otherwise(F.array().cast("array<string>")).alias("crs"),
        F.concat(F.lit("c"), k % 7).alias("component"),
    )


def raw_lines(spark: SparkSession, sf_dir: str, test: str = "l_suppkey") -> DataFrame:
    prefix = "s" if test == "l_suppkey" else "p"
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # orders meet customers first, so the many lines are dealt once
    j = li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("c_mktsegment").alias("project"),
        F.col("l_orderkey").cast("string").alias("build_id"),
        F.col("o_orderdate").alias("build_start"),
        F.concat(F.lit(prefix), F.col(test)).alias("tc_key"),
        F.when(F.col("l_returnflag") == "R", "Fail").when(F.col("l_returnflag") == "A", "Pass")
        .otherwise("Blocked").alias("result"),
        F.col("l_quantity").alias("duration"),
        F.col("l_shipdate").alias("exec_ts"),
        F.col("l_extendedprice").alias("exec_id"),
        F.col("l_linestatus").alias("component"),
    )


def executions(spark: SparkSession, sf_dir: str, kind: str = "ev") -> DataFrame:
    """Collapsed executions with the clock, prepared once per session.

    Every query reads this table, so it is worth a checkpoint: without one, each
    would repeat the collapse and the clock.
    """
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _prepared:
        raw = raw_events(spark, sf_dir) if kind == "ev" else raw_lines(spark, sf_dir)
        if kind == "ev":
            raw = raw.withColumns({
                "n_commits": F.size("commits").cast("bigint"), "n_crs": F.size("crs").cast("bigint"),
            })
            one = collapse_executions(raw, sums=("n_commits", "n_crs"))
        else:
            one = collapse_executions(raw)
        one = materialize(one, "collapsed")  # read for the clock and for the rows
        _prepared[key] = materialize(with_clock(one))
        release(one)
    return _prepared[key]
