"""Fits against other solvers, and draws, batches, clocks and halves against plain loops."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.operators import features as feat
from tallyrank.operators import graph as g
from tallyrank.operators import learn as l
from tallyrank.operators import linear, trees
from tallyrank.operators import sampling as s


def table(spark, x, **columns):
    names = list(columns)
    rows = [([float(v) for v in r], *[float(columns[c][i]) for c in names]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "x array<double>, " + ", ".join(f"{c} double" for c in names))


def test_logistic_gradient_vanishes_and_is_the_plain_one(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 0] + [0, 100, 3, 5]  # one constant feature
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - (x[:, 1] - 100) / 10)))).astype(float)
    w = rng.integers(1, 4, 300)
    fit = linear.fit_logistic(table(spark, x, y=y, w=w), F.col("x"), F.col("y"), F.col("w"), 0.05)
    sd = x.std(axis=0)
    sd[sd < 1e-9] = 1
    b = np.append(fit.weights * sd, fit.offset + fit.weights @ x.mean(axis=0))
    z = np.hstack([(x - x.mean(axis=0)) / sd, np.ones((300, 1))])
    p = 1 / (1 + np.exp(-z @ b))
    gradient = z.T @ (w * (p - y)) / w.sum() + np.append(0.05 * b[:-1], 0)
    assert np.abs(gradient).max() < 1e-9 and fit.weights[3] == 0
    scored = table(spark, x[:5], y=y[:5]).select(fit.probability(F.col("x"))).collect()
    assert np.allclose([r[0] for r in scored], p[:5])


def test_logistic_of_one_class_no_rows_and_separable(spark):
    x = np.arange(6.0)[:, None]
    one = linear.fit_logistic(table(spark, x, y=np.ones(6)), F.col("x"), F.col("y"))
    assert one.offset == 30 and one.weights.tolist() == [0]
    none = linear.fit_logistic(table(spark, x, y=np.ones(6)).limit(0), F.col("x"), F.col("y"))
    assert none.offset == 0
    apart = linear.fit_logistic(table(spark, x, y=(x[:, 0] > 2)), F.col("x"), F.col("y"), ridge=0.01)
    assert np.isfinite(apart.weights).all() and np.abs(apart.gradient).max() < 1e-9


def test_control_vectors_score_near_one_half(spark):
    """Vectors that have nothing to do with the label rank unseen rows by chance."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(1200, 8)), (rng.random(1200) < 0.3).astype(float)
    fit = linear.fit_logistic(table(spark, x[:600], y=y[:600]), F.col("x"), F.col("y"))
    a = x[600:] @ fit.weights
    above = (a[y[600:] > 0][:, None] > a[y[600:] < 1][None, :]).mean()
    assert abs(above - 0.5) < 0.07


def test_ridge_of_many_targets_equals_single_fits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) * [1, 5, 1, 1, 0] + 7
    t = np.stack([x @ [1, 2, 0, 0, 0] + rng.normal(size=200), rng.normal(size=200) * 100, np.full(200, 3.0)], axis=1)
    df = table(spark, x, a=t[:, 0], b=t[:, 1], c=t[:, 2])
    both = linear.fit_ridge(df, F.col("x"), [F.col(c) for c in "abc"], 0.1)
    for k, c in enumerate("abc"):
        one = linear.fit_ridge(df, F.col("x"), [F.col(c)], 0.1)
        assert np.allclose(one.weights[:, 0], both.weights[:, k]) and np.allclose(one.offsets[0], both.offsets[k])
    sd = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
    z, y = (x - x.mean(axis=0)) / sd, (t[:, 0] - t[:, 0].mean()) / t[:, 0].std()
    want = np.linalg.solve(z.T @ z / 200 + 0.1 * np.eye(5), z.T @ y / 200) * t[:, 0].std() / sd
    assert np.allclose(both.weights[:, 0], want)
    assert np.allclose(both.weights[:, 2], 0) and both.offsets[2] == pytest.approx(3)


def test_a_stump_cuts_where_brute_force_does(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((150, 3)) * 31)
    x[:3] = [[0, 0, 0], [31, 31, 31], [5, 5, 5]]  # bins are the values 0..31
    y = ((x[:, 1] > 12) ^ (rng.random(150) < 0.2)).astype(float)
    model = trees.fit_boosted(table(spark, x, y=y), F.col("x"), F.col("y"), rounds=1, depth=1, rate=1.0, smooth=0.0, logistic=False)
    best = None
    for f in range(3):
        for c in range(31):
            left = np.minimum(np.floor(x[:, f] / 31 * 32), 31) <= c
            if 0 < left.sum() < 150:
                gain = sum((y[m] - y.mean()).sum() ** 2 / m.sum() for m in (left, ~left))
                if best is None or round(gain, 6) > best[0]:
                    best = (round(gain, 6), f, c)
    t = model.trees[0]
    assert (t.feature[1], t.cut[1]) == best[1:]
    pred = [r[0] for r in table(spark, x, y=y).select(model.predict(F.col("x"))).collect()]
    left = np.minimum(np.floor(x[:, best[1]] / 31 * 32), 31) <= best[2]
    assert np.allclose(pred, np.where(left, y[left].mean(), y[~left].mean()))


def test_trees_learn_and_are_the_same_on_any_partitions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) & (x[:, 2] > 0)).astype(float)
    df = table(spark, x, y=y, key=np.arange(400))
    fits = []
    for parts in (1, 5):
        d = df.repartition(parts)
        fits.append((trees.fit_forest(d, F.col("x"), F.col("y"), ["key"], n_trees=10), trees.fit_boosted(d, F.col("x"), F.col("y"), rounds=4, depth=2, rate=0.5)))
    for a, b in zip(*fits):
        assert all((s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value) for s, t in zip(a.trees, b.trees))
        p = np.array([r[0] for r in df.orderBy("key").select(a.predict(F.col("x"))).collect()])
        assert ((p > 0.5) == (y > 0.5)).mean() > 0.9 and (0 <= p).all() and (p <= 1).all()
    assert trees.fit_forest(df.limit(0), F.col("x"), F.col("y"), ["key"]) is None
    flat = trees.fit_boosted(table(spark, np.ones((5, 2)), y=[0, 1, 1, 0, 1]), F.col("x"), F.col("y"), logistic=False)
    assert flat.raw(np.zeros((1, 2), int))[0] == pytest.approx(0.6)


def test_ensemble_is_the_mean_of_its_parts(spark, monkeypatch):
    monkeypatch.setattr(l, "_GB", {"rounds": 2, "depth": 2})
    monkeypatch.setattr(l, "_RF", {"n_trees": 5, "depth": 2})
    rng = np.random.default_rng(8)
    rows = [(f"t{i}", float(a), float(b), int(a + b > 0)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "id string, a double, b double, fail int")
    model = l.fit_ensemble(df, ["a", "b"], ["id"])
    for r in l.score_ensemble(model, df, parts=True).collect():
        assert r["p_fail"] == pytest.approx((r["p_logistic"] + r["p_forest"] + r["p_boosted"]) / 3)
    assert l.fit_ensemble(df.filter("fail = 1"), ["a", "b"], ["id"]) is None


def test_holdout_never_sees_what_it_does_not_get(spark):
    rng = np.random.default_rng(9)
    rows = [(b, float(x), int(x > 0)) for b in range(30) for x in rng.normal(size=4)]
    df = spark.createDataFrame(rows, "build_idx bigint, a double, fail int")
    model, settings, errors = l.select_by_holdout(df, ["a"], candidates=({"depth": 1}, {"depth": 2}))
    late = df.filter("build_idx >= 24")
    early = trees.fit_boosted(df.filter("build_idx < 24"), l.listed(["a"]), F.col("fail"), rounds=10, logistic=False, depth=1)
    assert late.agg(F.avg(F.pow(early.predict(l.listed(["a"])) - F.col("fail"), F.lit(2)))).first()[0] == pytest.approx(errors[0])
    assert settings in ({"depth": 1}, {"depth": 2}) and len(errors) == 2


# ---- draws and batches

@pytest.mark.parametrize("size", [1, 20])
def test_batches_equal_one_by_one_packing(spark, size):
    rng = random.Random(size)
    rows = [("p", f"b{b}", f"t{t}", int(b % 9 > 0)) for b in range(60) for t in range(rng.choice((1, 2, 5, 9)))]
    df = spark.createDataFrame(rows, "project string, build_id string, tc_key string, fail int")
    got = s.build_batches(df, size).collect()
    by = {}
    for r in got:
        by.setdefault(r["build_id"], set()).add(r["batch"])
    n = Counter(r[1] for r in rows)
    hashes = {r["build_id"]: r["h"] for r in df.select("build_id", s.hash_int(F.col("project"), F.col("build_id"), 42).alias("h")).distinct().collect()}
    want, held, batch = {}, 0, 0
    for b in sorted((b for b in n if int(b[1:]) % 9 > 0), key=lambda b: (hashes[b], b)):
        if held and held + n[b] > size:
            held, batch = 0, batch + 1
        held += n[b]
        want[b] = {batch}
    assert by == want
    assert s.build_batches(df.limit(0), size).count() == 0


def edge_frames(spark, v, edges):
    names = [f"n{i:03}" for i in range(v)]
    nodes = spark.createDataFrame([("p", n) for n in names] + [("q", "a"), ("q", "b")], "project string, tc_key string")
    rows = [("p", names[i], names[j]) for i, j in edges] + [("q", "a", "b")]
    return nodes, spark.createDataFrame(rows, "project string, src string, dst string")


@pytest.mark.parametrize("v, left", [(12, 3), (12, 40), (9, 0)])
def test_non_edges_are_distinct_and_all_there_are(spark, v, left):
    rng = random.Random(v + left)
    every = list(combinations(range(v), 2))
    rng.shuffle(every)
    edges = every[left:]
    nodes, e = edge_frames(spark, v, edges)
    free = {(f"n{i:03}", f"n{j:03}") for i, j in every[:left]}
    for n in (5, 1000):
        got = [tuple(r) for r in s.negative_edges(nodes, e, n).collect()]
        assert len(got) == len(set(got)) == min(n, len(free))
        assert {r[1:] for r in got} <= free and {r[0] for r in got} <= {"p"}


def test_non_edges_are_uniform(spark):
    nodes, e = edge_frames(spark, 9, [(0, j) for j in range(1, 8)] + [(3, 4)])
    hits = Counter()
    for seed in range(8):
        hits.update(tuple(r)[1:] for r in s.negative_edges(nodes, e, 14, seed).collect())
    free = 9 * 8 // 2 - 8
    expect = 8 * 14 / free
    assert sum((c - expect) ** 2 / expect for c in hits.values()) < 55  # 27 degrees of freedom, far in the tail


def test_siblings_of_a_large_build_by_blocks(spark):
    rows = [("p", b, [f"c{k}"]) for b, n in ((0, 40), (1, 3), (2, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "project string, build_idx bigint, commits array<string>")
    dag = lambda block: sorted(map(tuple, g.commit_dag(df, None, 5, 0.2, block=block).collect()))
    assert dag(7) == dag(1000) and len([r for r in dag(7) if r[4] == "sibling"]) == 40 * 39 + 3 * 2


# ---- clocks and halves

def runs(seed):
    rng = random.Random(seed)
    rows = [(p, f"b{b}", f"t{t}", b, rng.random(), int(rng.random() < 0.4)) for p in "pq" for b in range(25) for t in range(9)
            if rng.random() < (0.15 if t < 3 else 0.6) or (t == 8)]
    return [(*r, r[5]) for r in rows]


EX = "project string, build_id string, tc_key string, build_idx bigint, duration double, fail int, verdict int"


def test_oldest_last_execution_advances(spark):
    rows = runs(1)
    df = spark.createDataFrame(rows, EX).withColumn("result", F.when(F.col("fail") == 1, "Fail").otherwise("Pass")).withColumn("exec_ts", F.current_timestamp())
    got = {(r["project"], r["build_id"], r["tc_key"]): r["state_recency"] for r in feat.state_retecs6(df).collect()}
    for p, b, t, idx, *_ in rows:
        last = {}
        for q, _, u, k, *_ in rows:
            if q == p and k < idx:
                last[u] = max(k, last.get(u, -1))
        if t not in last:
            want = 0.0
        else:
            low, high = min(last.values()), idx - 1
            want = (last[t] - low) / (high - low) if high > low else 0.5
        assert got[p, b, t] == pytest.approx(want), (p, b, t)


def test_velocity_compares_exact_halves(spark):
    rows = runs(2)
    df = spark.createDataFrame(rows, EX).withColumn("result", F.when(F.col("fail") == 1, "Fail").otherwise("Pass")).withColumn("exec_ts", F.current_timestamp())
    got = {(r["project"], r["build_id"], r["tc_key"]): r["failure_velocity"] for r in feat.features_noderank10(df).collect()}
    for p, b, t, idx, *_ in rows:
        past = [r[5] for r in sorted(rows, key=lambda r: r[3]) if r[0] == p and r[2] == t and r[3] < idx]
        h = len(past) // 2
        want = np.mean(past[h:]) - np.mean(past[:h]) if len(past) >= 3 else 0.0
        assert got[p, b, t] == pytest.approx(want)


def test_default_row_counts_all_columns_at_once(spark):
    rows = [(1.0, 5, None), (2.0, 5, 1.0), (None, 7, 4.0), (10.0, 9, None)]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    r = feat.default_row(df, ["a", "b"], ["c"]).first()
    assert (r["_m_rows"], r["_m_a"], r["_m_b"], r["_m_c"]) == (4, pytest.approx(13 / 3), 6.5, 2.5)
    none = feat.default_row(df.limit(0), ["a"], ["c"]).first()
    assert (none["_m_rows"], none["_m_a"], none["_m_c"]) == (0, None, None)
