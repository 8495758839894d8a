"""Worked examples and brute force for grading."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyrank.functions import text as t
from tallyrank.operators import features as feat
from tallyrank.operators import metrics as m
from tallyrank.operators.clean import class_weights
from tallyrank.operators.graph import co_failure_edges, co_outcome_edges
from tallyrank.operators.ranking import rank_in_build, rank_random, recency_score


def ranked(spark, builds):
    rows = [("p", b, f"t{i}", int(i in bad), i) for b, (n, bad) in builds.items() for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "project string, build_id string, tc_key string, fail int, rank int")


def test_apfd_examples(spark):
    df = ranked(spark, {"ten": (10, {2, 5}), "one": (1, {1}), "none": (4, set())})
    assert {r.build_id: round(r.apfd, 9) for r in m.apfd_per_build(df).collect()} == {"ten": 0.7, "one": 1.0}
    assert {r.build_id: round(r.apfd, 9) for r in m.apfd_plain(df).collect()} == {"ten": 0.7, "one": 0.5}


def test_repeated_rows_count_once_for_the_one_test_rule(spark):
    rows = [("p", "b", "t1", 1, 1), ("p", "b", "t1", 1, 2)]
    df = spark.createDataFrame(rows, "project string, build_id string, tc_key string, fail int, rank int")
    assert m.apfd_per_build(df).first().apfd == 1.0


def test_rank_breaks_ties_by_key_and_random_is_repeatable(spark):
    rows = [("p", "b", k, s) for k, s in (("z", 0.5), ("a", 0.5), ("m", 0.9), ("n", None))]
    df = spark.createDataFrame(rows, "project string, build_id string, tc_key string, score double")
    assert [r.tc_key for r in rank_in_build(df).orderBy("rank").collect()] == ["m", "a", "z", "n"]
    one = sorted(map(tuple, rank_random(df.drop("score"), 1).collect()))
    assert one == sorted(map(tuple, rank_random(df.drop("score").repartition(3), 1).collect()))


def test_recency_direction(spark):
    df = spark.createDataFrame([("new", 9, 7), ("old", 9, 1), ("never", 9, None)], "tc_key string, build_idx int, last_fail_idx int")
    s = {r.tc_key: r.s for r in df.select("tc_key", recency_score().alias("s")).collect()}
    assert s["new"] > s["old"] > s["never"]
    p = {r.tc_key: r.s for r in df.select("tc_key", recency_score(True).alias("s")).collect()}
    assert p["new"] < p["old"] < p["never"]


def test_priority_weights():
    assert abs(feat.decay_weights("exponential")[0] - 0.2 / (1 - 0.8**10)) < 1e-12
    for kind in feat.DECAYS:
        assert abs(sum(feat.decay_weights(kind)) - 1) < 1e-12


def test_edge_weights_of_the_worked_example(spark):
    rows = [("p", f"b{i}", "A", 1) for i in range(4)] + [("p", f"b{i}", "B", 1) for i in range(2)]
    df = spark.createDataFrame(rows, "project string, build_id string, tc_key string, fail int").withColumn("verdict", F.col("fail"))
    assert co_failure_edges(df).first().weight == 0.75
    assert co_outcome_edges(df).first().weight == 0.5


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    assert {r.label: round(r.weight, 4) for r in class_weights(df).collect()} == {0: 0.6667, 1: 2.0}
    assert {r.label: r.weight for r in class_weights(df.filter("label = 0")).collect()}[1] == 1.0


def test_effect_sizes(spark):
    rng = random.Random(2)
    a = [round(rng.random(), 1) for _ in range(60)]
    b = [round(rng.random() * 0.8, 1) for _ in range(60)]
    fa, fb = (spark.createDataFrame([("p", f"b{i}", v) for i, v in enumerate(x)], "project string, build_id string, apfd double") for x in (a, b))
    want = sum((x > y) - (x < y) for x in a for y in b) / 3600
    assert abs(m.cliffs_delta(fa, fb).first().delta - want) < 1e-12
    d = [round(x - y, 12) for x, y in zip(a, b) if round(x - y, 12) != 0]
    order = sorted(abs(x) for x in d)
    rank = {v: (order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in order}
    w = sum(rank[abs(x)] for x in d if x > 0)
    tie = sum(order.count(v) ** 3 - order.count(v) for v in set(order))
    n = len(d)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48)
    got = m.wilcoxon_greater(m.paired(fa, fb)).first()
    assert got.w_plus == w and abs(got.z - z) < 1e-9
    assert abs(got.p_value - 0.5 * math.erfc(z / math.sqrt(2))) < 1e-6


def test_thresholds(spark):
    rng = random.Random(4)
    rows = [(i, int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, label int, score double")
    got = m.best_threshold_youden(df).first()
    pos, neg = sum(r[1] for r in rows), sum(1 - r[1] for r in rows)
    j = {s: sum(r[1] for r in rows if r[2] >= s) / pos - sum(1 - r[1] for r in rows if r[2] >= s) / neg for s in {r[2] for r in rows}}
    best = max(j.values())
    assert abs(got.youden_j - best) < 1e-9 and got.threshold == max(s for s in j if abs(j[s] - best) < 1e-9)
    flat = spark.createDataFrame([(1, 0, 0.9), (2, 1, 0.1)], "id int, label int, score double")
    assert m.best_threshold_youden(flat).first().threshold == float("inf")
    t1 = m.threshold_metrics(df, [0.5]).first()
    assert t1.tp == sum(1 for r in rows if r[1] and r[2] >= 0.5) and t1.fn == pos - t1.tp


@pytest.mark.parametrize("text,want", [
    ("['a', 'b']", "a [SEP] b"), ('["it\'s", \'x\']', "it's [SEP] x"), ("[]", ""), ("not a list", ""), (None, ""),
    ("['a', None, 'c']", None), ("['it\\'s']", "it's"),
])
def test_list_literals(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string")
    got = df.select(t.parse_list_literal(F.col("c"))).first()[0]
    assert got == (want if want is not None else "a [SEP] c")


def test_commit_fields(spark):
    raw = '[{"message": "Fix: login #12 ABC-9 works", "author": " Ann ", "files_changed": ["a/b/c.py", "d.py"]}, "Merge: x", 3]'
    df = spark.createDataFrame([(raw,), ("plain text",), ("",), (None,), ("[broken",)], "c string")
    got = [r[0] for r in df.select(t.commits_text(F.col("c"))).collect()]
    assert got == ["Commit 1: login   works Author: Ann Files: c.py, d.py | Commit 2: x", "Commit 1: plain text", "", "", "Commit 1: [broken"]


def test_names_and_truncation(spark):
    df = spark.createDataFrame([("com.acme.HttpResponseCacheTest", "word " * 500)], "n string, x string")
    r = df.select(t.package_name(F.col("n")), t.class_name(F.col("n")), t.camel_to_words(t.class_name(F.col("n"))),
                  t.truncate_safe(F.col("x"), 512), t.camel_to_words(F.col("n"), "dotted")).first()
    assert r[:3] == ("com.acme", "HttpResponseCacheTest", "http response cache")
    assert t.char_budget(512) == 1840 and r[3] == ("word " * 500)[:1839] + " [TRUNCATED]"
    assert r[4] == "com acme http response cache test"
