"""Readers on a small tree, resumable results, and the stream against the batch."""

import pytest
from pyspark.sql import functions as F

from tallyrank.operators.history import history
from tallyrank.plans.fixtures import executions
from tallyrank.sources import readers as rd
from tallyrank.sources import writers as wr
from tallyrank.streaming.history_stream import stream_history

HEAD = "travisJobId,testName,index,duration,count,failures,errors,skipped\n"


@pytest.fixture
def tree(tmp_path):
    for name in ("own@alpha", "own@beta"):
        (tmp_path / name / "baseline").mkdir(parents=True)
        (tmp_path / name / f"{name}.csv").write_text(HEAD + "7,a.b.CacheTest,0,1.5,3,1,0,0\n8,a.b.CacheTest,0,1.0,3,0,0,0\n")
        (tmp_path / name / "notes.csv").write_text("x\n1\n")
        (tmp_path / name / "baseline" / f"{name}@untreated.csv").write_text(HEAD + "7,a.b.CacheTest,1,1.5,3,1,0,0\n")
        (tmp_path / name / "baseline" / f"{name}@other.csv").write_text(HEAD + "7,a.b.CacheTest,9,1.5,3,1,0,0\n")
    return str(tmp_path)


def test_project_tree(spark, tree):
    df = rd.read_projects(spark, tree)
    assert sorted((r.project, r.travisJobId) for r in df.collect()) == [(p, j) for p in ("own@alpha", "own@beta") for j in (7, 8)]
    c = rd.to_canonical(df).filter("travisJobId = 7 and Build_ID like 'own@alpha%'").first()
    assert (c.Build_ID, c.TC_Key, c.TE_Summary, c.TE_Test_Result) == ("own@alpha_7", "own@alpha::CacheTest", "cache", "Fail")
    s = rd.read_strategy_rankings(spark, tree).collect()
    assert {(r.project, r.strategy, r["index"]) for r in s} == {("own@alpha", "untreated", 1), ("own@beta", "untreated", 1)}


def test_quoted_text_over_lines(spark, tmp_path):
    cols = [c.split(" ")[0] for c in rd.EXECUTION_SCHEMA.split(", ")]
    row = {c: "" for c in cols} | {"Build_ID": "b1", "TC_Key": "t1", "TE_Summary": '"two ""quoted""\nlines"', "TE_Test_Result": "Pass"}
    (tmp_path / "e.csv").write_text(",".join(cols) + "\n" + ",".join(row[c] for c in cols) + "\n")
    got = rd.read_executions(spark, str(tmp_path / "e.csv")).collect()
    assert len(got) == 1 and got[0].TE_Summary == 'two "quoted"\nlines'
    assert rd.to_executions(rd.read_executions(spark, str(tmp_path / "e.csv"), limit=1)).first().tc_key == "t1"


def test_resume_and_fingerprint(spark, tmp_path):
    df = spark.createDataFrame([("a", "full", 1), ("b", "full", 2)], "project string, variant string, x int")
    path = str(tmp_path / "r")
    wr.append_new_results(df.filter("project = 'a'"), path)
    wr.append_new_results(df, path)
    assert sorted(map(tuple, spark.read.parquet(path).select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    saved = wr.dataset_fingerprint(df)
    assert wr.unchanged(df.orderBy(F.desc("x")).repartition(3), saved)
    assert not wr.unchanged(df.withColumn("x", F.col("x") + 1), saved)


def test_stream_equals_batch_and_counts_late_rows(spark, sf, tmp_path):
    e = executions(spark, sf).select("project", "tc_key", "build_id", "build_idx", "fail", "verdict", "result", "duration")
    src = str(tmp_path / "src")
    for low, high in ((0, 200), (200, 500), (500, 10_000)):
        e.filter(f"build_idx >= {low} and build_idx < {high}").coalesce(1).write.mode("append").parquet(src)
    e.orderBy("build_idx").limit(5).coalesce(1).write.mode("append").parquet(src)  # old rows again
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (stream_history(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    names = ["tc_key", "build_id", "n", "failures", "rate_5", "fail_run", "pass_run", "last_idx", "last_fail_idx"]
    out = spark.read.parquet(str(tmp_path / "out"))
    late = out.filter("is_late").collect()
    assert len(late) == 5 and all(r.late >= 1 and r.n is None for r in late)
    got = out.filter("not is_late").select(*names)
    want = history(e, want=names[2:]).select(*names)
    assert got.count() == e.count() and got.exceptAll(want).isEmpty()
