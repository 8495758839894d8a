"""The paths for hot groups give the same numbers as the plain ones."""

import random
import statistics
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.operators import graph as g
from tallyrank.operators.chronology import build_table
from tallyrank.operators.pairs import pair_counts
from tallyrank.operators.scale import exact_quantiles, number_rows, running_sums
from tallyrank.operators.similarity import knn


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randint(0, 5)) for i in range(600)]
    return spark.createDataFrame(rows, "g string, k int, v int"), rows


@pytest.mark.parametrize("group", [["g"], []])
def test_number_rows(skewed, group):
    df, _ = skewed
    order = [F.col("v").desc(), F.col("k")]
    plain = number_rows(df, group, order, "rn").collect()
    hot = number_rows(df, group, order, "rn", hot_rows=50).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, hot))


@pytest.mark.parametrize("group", [["g"], []])
def test_running_sums(skewed, group):
    df, _ = skewed
    order = [F.col("v"), F.col("k")]
    plain = running_sums(df, group, order, {"s": "v", "c": "k"}).collect()
    hot = running_sums(df, group, order, {"s": "v", "c": "k"}, hot_rows=50).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, hot))


def test_exact_quantiles(skewed):
    df, rows = skewed
    for hot in (10**6, 3):
        got = {r.g: r for r in exact_quantiles(df, ["g"], "k", {"med": 0.5, "q": 0.9}, hot).collect()}
        for name in {r[0] for r in rows}:
            ks = [r[1] for r in rows if r[0] == name]
            assert abs(got[name].med - statistics.median(ks)) < 1e-9
            assert abs(got[name].q - np.quantile(ks, 0.9)) < 1e-9


def test_clock_by_ranges(spark):
    rows = [("p" if i % 4 else "q", f"b{i:03d}", (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "project string, build_id string, build_start int")
    plain = sorted(map(tuple, build_table(df).collect()))
    assert plain == sorted(map(tuple, build_table(df, hot_rows=20).collect()))
    for p in ("p", "q"):
        want = sorted((s, b) for q, b, s in rows if q == p)
        assert {b: i for q, b, i in plain if q == p} == {b: i for i, (_, b) in enumerate(want)}


def executions(spark, seed=5, builds=40, tests=30):
    """One build runs every test; it holds about a third of all rows."""
    rng = random.Random(seed)
    rows = [("p", "big", f"t{t:02d}", 1) for t in range(tests)]
    for b in range(builds):
        rows += [("p", f"b{b:02d}", f"t{t:02d}", 1) for t in rng.sample(range(tests), rng.choice([1, 2, 2, 3, 8]))]
    df = spark.createDataFrame(rows, "project string, build_id string, tc_key string, fail int")
    return df.withColumn("verdict", F.col("fail")), rows


@pytest.mark.parametrize("hot", [4, 10, 1000])
def test_pairs_with_a_hot_build(spark, hot):
    df, rows = executions(spark)
    builds = {}
    for _, b, t, _ in rows:
        builds.setdefault(b, set()).add(t)
    n = Counter(t for ts in builds.values() for t in ts)
    shared = Counter(p for ts in builds.values() for p in combinations(sorted(ts), 2))
    for low in (1, 2):
        got = {(r.src, r.dst): round(r.weight, 9) for r in g.co_failure_edges(df, low, 0.1, hot).collect()}
        mean = {p: (c / n[p[0]] + c / n[p[1]]) / 2 for p, c in shared.items()}
        assert got == {p: round(w, 9) for p, w in mean.items() if shared[p] >= low and w >= 0.1}
    got = {(r.src, r.dst): round(r.weight, 9) for r in g.co_outcome_edges(df, 1, 1, 0.3, hot).collect()}
    low = {p: c / max(n[p[0]], n[p[1]]) for p, c in shared.items()}
    assert got == {p: round(w, 9) for p, w in low.items() if w >= 0.3}


def test_pairs_of_a_hot_bucket_need_two(spark):
    """With two shared buckets needed, the one large bucket is never expanded."""
    rows = [("p", "big", f"n{i}") for i in range(50)] + [("p", "x", "n1"), ("p", "x", "n2"), ("p", "y", "n3")]
    m = spark.createDataFrame(rows, "project string, bucket string, node string")
    got = pair_counts(m, need=lambda n: F.lit(2), hot=10).collect()
    assert [(r.src, r.dst, r.shared) for r in got] == [("n1", "n2", 2)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "exp_euclidean"])
def test_knn_by_blocks(spark, metric):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 6)).astype(np.float32)
    v[10] = v[20] = v[30]  # ties
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in knn(df, df, 4, (("embedding", metric, 1.0),), skip_self=True, block=25).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbor"]))
    w = v.astype(np.float64)
    for i in range(90):
        if metric == "cosine":
            s = (w @ w[i]) / np.linalg.norm(w, axis=1) / np.linalg.norm(w[i])
        else:
            s = -np.linalg.norm(w - w[i], axis=1)
        s = np.round(s, 6)
        order = [int(j) for j in sorted(range(90), key=lambda j: (-s[j], j)) if j != i][:4]
        assert {n for _, n in got[i]} == set(order) or abs(s[order[-1]] - min(s[n] for _, n in got[i])) < 1e-6
