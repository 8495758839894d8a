"""Order lines are joined once, however many projects are written."""

from pyspark.sql import functions as F

from tallyrank.plans import data_queries as dq


def test_projects_are_written_at_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    lines = [(p, str(b), None, f"p{b}", "Fail" if b % 2 else "Pass", b / 2, None, None, "O") for p in ("A B", "x=1", "M", None) for b in range(5)]
    kind = "project string, build_id string, build_start date, tc_key string, result string, duration double, exec_ts date, exec_id double, component string"

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    raw = spark.createDataFrame(lines, kind)
    monkeypatch.setattr(dq, "raw_lines", lambda *a: raw.mapInArrow(count, raw.schema))
    path = dq._project_files(spark, "")
    assert made.value == 20
    monkeypatch.setattr(dq, "_project_files", lambda *a: path)
    back = dq._raw_projects(spark, "")
    assert sorted((r.project, r.travisJobId, r.testName, r.failures) for r in back.collect()) == sorted(
        (p, int(b), f"org.acme.O.Part{t.capitalize()}Test", int(v == "Fail")) for p, b, _, t, v, *_ in lines if p)
    assert back.filter(F.col("project") == "A B").count() == 5
