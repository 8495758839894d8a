"""Running history over a stream: features of an execution are emitted before its verdict
is learned. Micro-batches arrive in clock order. An older row of a test cannot change what
was emitted: it comes out marked `is_late`, without features, and is counted in `late`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyrank.operators.metrics import apfd_per_build
from tallyrank.operators.ranking import rank_in_build
from tallyrank.session import discard, scratch_path, write_cut

LAST = 10
OUTPUT = ("project string, tc_key string, build_id string, build_idx bigint, fail int, n bigint, failures bigint, "
          "rate_5 double, rate_10 double, fail_run bigint, pass_run bigint, last_idx bigint, last_fail_idx bigint, late bigint, is_late boolean")
SCORE = "failures / nullif(n, 0)"
STATE = "n long, failures long, fail_run long, pass_run long, last_idx long, last_fail_idx long, late long, recent array<int>"


def _advance(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, failures, fail_run, pass_run, last_idx, last_fail, late, recent = (
        state.get if state.exists else (0, 0, 0, 0, -1, -1, 0, []))
    recent = list(recent)
    rows = pd.concat(list(pdfs)).sort_values("build_idx")
    out = []
    for build_id, idx, fail in zip(rows["build_id"], rows["build_idx"], rows["fail"]):
        if idx <= last_idx:
            late += 1
            out.append((*key, build_id, idx, fail, *[None] * 8, late, True))
            continue
        rate = lambda k: sum(recent[-k:]) / len(recent[-k:]) if recent else None
        out.append((*key, build_id, idx, fail, n, failures, rate(5), rate(10), fail_run, pass_run,
                    last_idx if n else None, last_fail if last_fail >= 0 else None, late, False))
        n, failures, last_idx = n + 1, failures + int(fail), int(idx)
        fail_run, pass_run = (fail_run + 1, 0) if fail else (0, pass_run + 1)
        last_fail = int(idx) if fail else last_fail
        recent = [*recent, int(fail)][-LAST:]
    state.update((n, failures, fail_run, pass_run, last_idx, last_fail, late, recent))
    if not out:
        return
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    frame = pd.DataFrame(out, columns=names)
    whole = ("n", "failures", "fail_run", "pass_run", "last_idx", "last_fail_idx")
    yield frame.astype(dict.fromkeys(whole, "Int64") | {"rate_5": "float64", "rate_10": "float64"})


def stream_history(stream: DataFrame) -> DataFrame:
    """`stream` has project, tc_key, build_id, build_idx, fail; one row per (build, test), and
    one marked `is_late` for each row at or before its test's clock."""
    rows = stream.select("project", "tc_key", "build_id", "build_idx", "fail")
    return rows.groupBy("project", "tc_key").applyInPandasWithState(
        _advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _waiting(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-waiting"


def _grade(rows: DataFrame, score: str, path: str) -> None:
    scored = rows.withColumn("score", F.coalesce(F.expr(score).cast("double"), F.lit(0.0)))
    apfd_per_build(rank_in_build(scored)).write.mode("overwrite").parquet(path)


def stream_rank(history: DataFrame, path: str, checkpoint: str, score: str = SCORE, late: str | None = None):
    """Rank and grade each build once it is whole and append the grades.

    A build is whole when a later build of its project has come; until then its rows wait
    beside the checkpoint, one build per project. Rows of builds already graded are late:
    they go to `late`, if given. `grade_waiting` grades what waits when the stream has ended.
    Everything is written under the batch's number, so a repeated batch replaces itself.
    """
    waiting = _waiting(checkpoint)

    def grade(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, newest = batch.withColumn("_clock", F.lit(None).cast("bigint")), None
        if number:
            held = spark.read.schema(batch.schema).parquet(f"{waiting}/batch={number - 1}")
            newest = held.groupBy("project").agg(F.max("build_idx").alias("_clock"))
            rows = batch.join(newest, "project", "left").unionByName(held.withColumn("_clock", F.lit(None).cast("bigint")))
        # written once: the stream's state must not be advanced again by each use
        cut = scratch_path(spark, "stream-batch")
        rows = write_cut(rows.withColumn("is_late", F.col("is_late") | F.coalesce(F.col("build_idx") < F.col("_clock"), F.lit(False))), cut)
        if late:
            rows.filter("is_late").drop("_clock").write.mode("overwrite").parquet(f"{late}/batch={number}")
        rows = rows.filter("not is_late").drop("_clock")
        rows = rows.join(rows.groupBy("project").agg(F.max("build_idx").alias("_last")), "project")
        rows.filter("build_idx = _last").select(batch.columns).write.mode("overwrite").parquet(f"{waiting}/batch={number}")
        _grade(rows.filter("build_idx < _last").drop("_last"), score, f"{path}/batch={number}")
        discard(cut)
        if number > 1:
            discard(f"{waiting}/batch={number - 2}")

    return (history.writeStream.foreachBatch(grade).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True))


def grade_waiting(spark: SparkSession, path: str, checkpoint: str, score: str = SCORE) -> None:
    """Grade the builds that still wait for a later one. A stream that goes on afterwards
    replaces these grades by those of its next batch."""
    held = spark.read.parquet(_waiting(checkpoint))
    last = held.agg(F.max("batch")).first()[0]
    if last is not None:
        _grade(held.filter(F.col("batch") == last).drop("batch"), score, f"{path}/batch={last + 1}")
