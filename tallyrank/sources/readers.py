"""Readers with fixed schemas; absent optional columns become typed nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.functions.text import camel_to_words, class_name, list_items
from tallyrank.functions.verdict import is_failure

# fixed values: schemas and names of the stored tables
EXECUTION_SCHEMA = (
    "Build_ID string, Build_ID_entry string, TP_Key string, TC_Key string, TE_Summary string, TE_Key string, "
    "Build_Test_Start_Date timestamp, TE_Date date, TE_Created_Date timestamp, TE_Test_Result string, TC_Steps string, "
    "TE_Updated_Date timestamp, commit string, CR string, CR_Resolution string, CR_Resolved_Date date, "
    "CR_Component_Name string, CR_Type string, CR_y string")
PROJECT_SCHEMA = ("travisJobId bigint, testName string, `index` int, duration double, count int, failures int, "
                  "errors int, skipped int")
STRATEGIES = ("untreated", "random", "recently-failed", "optimal-failure", "optimal-failure-duration",
              "matrix-naive", "matrix-conditional-prob")
# end of fixed values


def _csv(spark: SparkSession, schema: str, path, **options):
    reader = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
    return reader.options(**options).csv(path)


def read_executions(spark: SparkSession, path: str, fmt: str = "csv", limit: int | None = None) -> DataFrame:
    """Execution table; quoted text may span lines. `limit` takes the first rows read."""
    if fmt == "csv":
        df = _csv(spark, EXECUTION_SCHEMA, path, multiLine=True)
    else:
        df = with_schema(spark.read.format(fmt).load(path), EXECUTION_SCHEMA)
    return df if limit is None else df.limit(limit)


def with_schema(df: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema in order, cast; missing ones as nulls."""
    out: list[Column] = []
    for item in schema.split(", "):
        name, kind = item.replace("`", "").split(" ")
        col = F.col(f"`{name}`") if name in df.columns else F.lit(None)
        out.append(col.cast(kind).alias(name))
    return df.select(*out)


def change_list(*columns: Column) -> Column:
    """Distinct items of stored list literals, over several columns; text that is no list is one item."""
    empty = F.array().cast("array<string>")
    items = [F.coalesce(list_items(c), F.when(c.isNotNull(), F.array(c)), empty) for c in columns]
    return F.array_compact(F.array_distinct(F.concat(*items)))


def to_executions(df: DataFrame, project: str = "industry") -> DataFrame:
    """Stored execution columns under the names the operators use, with commits and change requests
    (of both columns that hold them, as far as they are there) as arrays."""
    requests = [F.col(c) for c in ("CR", "CR_y") if c in df.columns]
    return df.select(
        F.lit(project).alias("project"), F.col("Build_ID").alias("build_id"), F.col("Build_Test_Start_Date").alias("build_start"),
        F.col("TC_Key").alias("tc_key"), F.col("TE_Test_Result").alias("result"), F.lit(None).cast("double").alias("duration"),
        F.col("TE_Created_Date").alias("exec_ts"), F.col("TE_Key").alias("exec_id"), F.col("TE_Summary").alias("summary"),
        F.col("TC_Steps").alias("steps"), F.col("commit"), F.col("CR").alias("cr"), F.col("CR_Component_Name").alias("component"),
        change_list(F.col("commit")).alias("commits"), (change_list(*requests) if requests else F.array().cast("array<string>")).alias("crs"))


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    """All `<project>/<project>.csv` under the root in one table; other files and folders
    are skipped. Each may be one file or a folder of parts. The project comes from the path."""
    df = _csv(spark, PROJECT_SCHEMA, f"{root}/*/*.csv").withColumn("_path", F.col("_metadata.file_path"))
    path = F.url_decode("_path")
    df = df.withColumns({"project": F.regexp_extract(path, r"([^/]+)/[^/]+\.csv(/part-[^/]*)?$", 1),
                         "_stem": F.regexp_extract(path, r"([^/]+)\.csv(/part-[^/]*)?$", 1)})
    return df.filter(F.col("project") == F.col("_stem")).drop("_path", "_stem")


def read_strategy_rankings(spark: SparkSession, root: str, strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """Stored rankings `<project>/baseline/<project>@<strategy>.csv`; missing files are fine."""
    df = _csv(spark, PROJECT_SCHEMA, f"{root}/*/baseline/*.csv").withColumn("_path", F.url_decode("_metadata.file_path"))
    df = df.withColumns({"project": F.regexp_extract("_path", r"([^/]+)/baseline/", 1),
                         "strategy": F.regexp_extract("_path", r"@([^@/]+)\.csv(/part-[^/]*)?$", 1)})
    return df.filter(F.col("strategy").isin(*strategies)).drop("_path")


def to_canonical(df: DataFrame) -> DataFrame:
    """Raw project rows as executions; keys carry the project as prefix."""
    name = class_name(F.col("testName"))
    fail = is_failure("counts", failures=F.col("failures"), errors=F.col("errors"))
    return df.select(
        F.concat_ws("_", "project", F.col("travisJobId").cast("string")).alias("Build_ID"),
        F.concat_ws("::", F.col("project"), name).alias("TC_Key"), camel_to_words(name).alias("TE_Summary"),
        F.lit("").alias("TC_Steps"), F.when(fail == 1, "Fail").otherwise("Pass").alias("TE_Test_Result"),
        F.lit("").alias("commit"), F.lit("").alias("Build_Test_Start_Date"), F.col("travisJobId"))


def canonical_executions(df: DataFrame) -> DataFrame:
    """Raw project rows under the names the operators use."""
    fail = is_failure("counts", failures=F.col("failures"), errors=F.col("errors"))
    return df.select(
        "project", F.col("travisJobId").cast("string").alias("build_id"), F.col("travisJobId").alias("build_start"),
        F.col("testName").alias("tc_key"), F.when(fail == 1, "Fail").otherwise("Pass").alias("result"), "duration",
        F.col("index").alias("exec_ts"), F.col("index").alias("exec_id"))
