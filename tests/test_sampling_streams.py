"""Samples of several classes, batches, builds split over micro-batches, and cold-start defaults."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyrank.operators import sampling as s
from tallyrank.operators import similarity as sim
from tallyrank.operators.features import feature_stats
from tallyrank.operators.metrics import apfd_per_build
from tallyrank.operators.ranking import rank_in_build
from tallyrank.streaming.history_stream import grade_waiting, stream_history, stream_rank


def test_every_class_is_drawn_by_its_weight(spark):
    rows = [(i, c) for i, c in enumerate([0] * 40 + [1] * 10 + [2] * 30 + [None] * 5)]
    df = spark.createDataFrame(rows, "id int, label int")
    draws = 100_000
    got = s.balanced_sample(df, draws, ["id"])
    n = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert set(n) == {0, 1, 2} and sum(n.values()) == draws
    for c, share in ((0, 40 / 170), (1, 100 / 170), (2, 30 / 170)):
        assert abs(n[c] / draws - share) < 0.01
    assert got.select("id").distinct().count() == 80
    assert s.balanced_sample(df.filter("false"), 10, ["id"]).isEmpty()


def test_all_negatives_are_used_alike(spark):
    df = spark.createDataFrame([(i, int(i < 40)) for i in range(40 + 75)], "id int, fail int")
    got = s.stratified_batches(df, 32, 4, ["id"]).collect()
    size = Counter(r.batch for r in got)
    assert set(size) == set(range(10)) and set(size.values()) == {32}
    assert set(Counter(r.batch for r in got if r.fail).values()) == {4}
    used = Counter(r.id for r in got if not r.fail)
    assert len(used) == 75 and max(used.values()) - min(used.values()) <= 1
    few = s.stratified_batches(df.filter("id < 45"), 32, 4, ["id"]).collect()
    assert set(Counter((r.batch, r.id) for r in few).values()) == {1} and len(few) == 40 + 5 * 10


@pytest.fixture
def builds():
    fail = lambda b, t: int((b * 7 + t * 3) % 5 == 0)
    return [("p", f"t{t}", f"b{b}", b, fail(b, t)) for b in range(6) for t in range(8)]


def test_a_build_over_two_batches_is_graded_once(spark, builds, tmp_path):
    kind = "project string, tc_key string, build_id string, build_idx bigint, fail int"
    late = [("p", "t_new", "b1", 1, 1), ("p", "t0", "b0", 0, 1)]
    # the second file ends inside build 3; the last one has rows of builds graded long before
    for part in (builds[:13], builds[13:28], builds[28:], late):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream_rank(stream_history(stream), out, ckpt, late=str(tmp_path / "late")).start().awaitTermination()
    assert {r.build_id for r in spark.read.parquet(out).collect()} == {f"b{b}" for b in range(5)}
    for _ in range(2):  # grading again replaces itself
        grade_waiting(spark, out, ckpt)
        got = {r.build_id: (r.count_tc, round(r.apfd, 9)) for r in spark.read.parquet(out).collect()}
        assert spark.read.parquet(out).count() == len(got) == 6
    h = spark.createDataFrame([(*r, sum(x[4] for x in builds if x[1] == r[1] and x[3] < r[3]) / max(r[3], 1)) for r in builds], kind + ", score double")
    want = {r.build_id: (r.count_tc, round(r.apfd, 9)) for r in apfd_per_build(rank_in_build(h)).collect()}
    assert got == want
    gone = spark.read.parquet(str(tmp_path / "late")).collect()
    assert sorted((r.tc_key, r.build_id) for r in gone) == [("t0", "b0"), ("t_new", "b1")]
    assert {r.tc_key: r.late for r in gone}["t0"] == 1


def test_cold_start_rules(spark):
    base = spark.createDataFrame([(i, [1.0, float(i)], 5.0 + i, 0.2, f) for i, f in enumerate((0.0, 0.1, 0.9))],
                                 "vec_id int, embedding array<double>, test_age double, test_novelty double, flakiness_rate double")
    cols = ["test_age", "test_novelty", "flakiness_rate"]
    row = sim.conservative_defaults(base, cols).first()
    assert tuple(row) == (0.0, 1.0, 0.1)
    query = spark.createDataFrame([(9, [-1.0, 0.0])], "vec_id int, embedding array<double>")
    noisy = sim.knn_impute(query, base, cols, defaults=sim.conservative_defaults(base, cols), noise=50.0).first()
    assert noisy.neighbors == 0 and noisy.test_age >= 0 and 0 <= noisy.test_novelty <= 1 and 0 <= noisy.flakiness_rate <= 1
    scored = sim.score_orphans(query.withColumn("base_score", F.lit(0.5)).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0))),
                               base.withColumn("score", F.col("vec_id") / 2), temperature=1e-4).first()
    assert scored.score == pytest.approx(0.55 * 1.0 + 0.45 * 0.5)


def test_one_minority_row_and_a_feature_without_values(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 2.0])] + [(i, 0, [0.0, float(i)]) for i in range(1, 5)], "vec_id int, label int, embedding array<double>")
    made = sim.smote(df).collect()
    assert len(made) == 3 and {(r.vec_id, r.neighbor, tuple(r.embedding)) for r in made} == {(0, 0, (1.0, 2.0))}
    x = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    stats = {r.feature: (r.mean, r.median) for r in feature_stats(x, ["a", "b"]).collect()}
    assert stats == {"a": (2.0, 2.0), "b": (None, None)}
