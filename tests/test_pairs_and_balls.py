"""The three ways of counting pairs, and exact neighbours by balls, against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyrank.operators import graph as g
from tallyrank.operators import pairs as p
from tallyrank.operators import similarity as sim

MEMBERS = "project string, bucket string, node string"


def random_members(seed, buckets=60, nodes=45, hot=2):
    rng = random.Random(seed)
    rows = set()
    for scope in ("p", "q"):
        for b in range(buckets):
            size = nodes if b < hot else rng.choice((1, 2, 3, 8))
            rows |= {(scope, f"b{b}", f"n{n}") for n in rng.sample(range(nodes), size)}
    return sorted(rows)


def brute(rows, need, least=None):
    held = {}
    for scope, bucket, node in rows:
        held.setdefault((scope, node), set()).add(bucket)
    out = {}
    for (s, a), (t, b) in combinations(sorted(held), 2):
        if s == t:
            x, y = held[s, a], held[t, b]
            low = max(need(len(x)), need(len(y)), (least or {}).get(s, 1), 1)
            if len(x & y) >= low:
                out[s, a, b] = (len(x & y), len(x), len(y))
    return out


def got(rows, **options):
    return {(r["project"], r["src"], r["dst"]): (r["shared"], r["n_src"], r["n_dst"]) for r in p.pair_counts(rows, **options).collect()}


@pytest.mark.parametrize("way", ["join", "prefix", "product", None])
@pytest.mark.parametrize("low", [1, 3])
def test_ways_agree(spark, way, low):
    rows = random_members(low)
    df = spark.createDataFrame(rows, MEMBERS)
    share = lambda n: -(-n // 4)
    options = {"way": way, "block": 8, "hot": 10, "stretch": 16}
    assert got(df, need=lambda n: F.greatest(F.ceil(n / 4), F.lit(low)), **options) == brute(rows, lambda n: max(share(n), low))
    assert got(df, need=lambda n: F.lit(low), **options) == brute(rows, lambda n: low)


def test_least_of_a_scope(spark):
    rows = random_members(5)
    least = spark.createDataFrame([("p", 4), ("q", 1)], "project string, least bigint")
    for way in ("join", "prefix", "product"):
        assert got(spark.createDataFrame(rows, MEMBERS), way=way, least=least, block=16) == brute(rows, lambda n: 1, {"p": 4})


def test_pairs_without_a_scope_and_empty(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("z", "c")], "bucket string, node string")
    for way in ("join", "prefix", "product", None):
        assert [tuple(r) for r in p.pair_counts(df, scope=(), way=way).collect()] == [("a", "b", 2, 2, 2)]
        assert p.pair_counts(df.limit(0), scope=(), way=way).count() == 0


def test_the_way_with_fewest_pairs_is_taken(spark, monkeypatch):
    monkeypatch.setattr(p, "FEW", 50)

    def way(rows, need):
        seen = []
        for name in ("_by_join", "_by_prefix", "_by_product"):
            monkeypatch.setattr(p, name, lambda *a, _f=getattr(p, name), _n=name, **b: (seen.append(_n), _f(*a, **b))[1])
        p.pair_counts(spark.createDataFrame(rows, MEMBERS), need=need)
        monkeypatch.undo()
        monkeypatch.setattr(p, "FEW", 50)
        return seen

    dense = [("p", f"b{b}", f"n{n}") for b in range(30) for n in range(20)]
    assert way(dense, lambda n: F.lit(1)) == ["_by_product"]
    # one large bucket that a need of two never expands
    hot = [("p", "big", f"n{n}") for n in range(60)] + [("p", f"b{n // 2}", f"n{n}") for n in range(60)]
    assert way(hot, lambda n: F.lit(2)) == ["_by_prefix"]
    sparse = [("p", f"b{n // 3}", f"n{n}") for n in range(300)]
    assert way(sparse, lambda n: F.lit(1)) == ["_by_join"]


def test_prefix_joins_grow_with_the_rows(spark):
    """Of a bucket that all nodes share, a need of two joins nothing: pair rows follow the small buckets."""
    made = []
    for nodes in (200, 400):
        rows = [("p", "all", f"n{n:04}") for n in range(nodes)] + [("p", f"b{n // 4}", f"n{n:04}") for n in range(nodes)]
        df = spark.createDataFrame(rows, MEMBERS)
        sizes = df.groupBy("bucket").count().select("bucket", F.col("count").alias("s"))
        numbered = df.join(sizes, "bucket").select(F.col("node").alias("id"), F.struct("s", "bucket").alias("bucket"), F.lit(2).alias("n"), F.lit(2).alias("need"))
        short = p.prefix_rows(numbered)
        made.append(p._joined(short.select(F.xxhash64("id").alias("id"), "bucket"), 2000, 500).count())
        assert len(got(df, need=lambda n: F.lit(2), way="prefix")) == nodes // 4 * 6
    assert made == [200 // 4 * 6, 400 // 4 * 6]


def test_commit_edges_with_a_floor(spark):
    rng = random.Random(4)
    rows = [("p", f"t{rng.randrange(30)}", [f"c{rng.randrange(80)}"], [f"r{rng.randrange(3)}"]) for _ in range(900)]
    df = spark.createDataFrame(rows, "project string, tc_key string, commits array<string>, crs array<string>")
    sets = {}
    for _, t, c, r in rows:
        sets.setdefault(t, set()).update([*c, *[f"CR_{x}" for x in r]])
    shared = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}
    top = max(shared.values())
    for low, threshold in ((1, 0.1), (2, 0.6), (1, 0.95)):
        want = {k: round(v / top, 9) for k, v in shared.items() if v >= low and v / top >= threshold}
        edges = g.commit_edges(df, low, threshold).collect()
        assert {(r.src, r.dst): round(r.weight, 9) for r in edges} == want


# ---- neighbours

def brute_best(v, w, k, metric, skip):
    out = []
    for i, x in enumerate(v):
        if metric == "cosine":
            u = lambda a: a / max(np.linalg.norm(a), 1e-12)
            s = np.array([float((u(x) * u(y)).sum()) for y in w])
        else:
            d = np.array([float(np.sqrt(((x - y) ** 2).sum())) for y in w])
            s = -d if metric == "euclidean" else np.exp(-d)
        order = [j for j in sorted(range(len(w)), key=lambda j: (-s[j], j)) if not (skip and i == j)][:k]
        out += [(i, j, round(float(s[j]), 9)) for j in order]
    return out


def frame(spark, v):
    return spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")


def clustered(n, shift=0.0, seed=0, dim=5, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim)) * 3
    return centers[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim)) + shift


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "exp_euclidean"])
def test_balls_are_exact_and_visit_few(spark, metric):
    v = clustered(400)
    v[5] = v[6] = v[7] = v[300]
    df, seen = frame(spark, v), {}
    rows = sim.knn(df, df, 6, (("embedding", metric, 1.0),), skip_self=True, block=20, visits=seen).collect()
    found = sorted((r["query"], r["rank"], r["neighbor"], round(r["similarity"], 9)) for r in rows)
    want = brute_best(v, v, 6, metric, True)
    assert [(q, n, s) for q, _, n, s in found] == want
    assert seen["made"] < 0.5 * seen["possible"], seen


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_large_norms_and_many_equal_vectors(spark, metric):
    v = np.round(clustered(150, shift=1e6, seed=3), 3)
    v[:60] = v[0]  # more equal vectors than neighbours
    df = frame(spark, v)
    rows = sim.knn(df, df, 4, (("embedding", metric, 1.0),), skip_self=True, block=16).collect()
    found = [(q, n, s) for q, _, n, s in sorted((r["query"], r["rank"], r["neighbor"], round(r["similarity"], 9)) for r in rows)]
    if metric == "euclidean":
        assert found == brute_best(v, v, 4, metric, True)
    else:  # all nearly parallel: the order below 1e-15 is noise, the values are not
        assert np.allclose([s for *_, s in found], [s for *_, s in brute_best(v, v, 4, metric, True)])
    assert [n for q, n, _ in found if q == 10] == [0, 1, 2, 3]


def test_two_parts_other_base_and_nulls(spark):
    v, w = clustered(60, seed=5), clustered(300, seed=5, spread=0.3)
    extra = lambda df: df.withColumn("_struct", F.transform("embedding", lambda x: F.round(x, 1)))
    q, b = extra(frame(spark, v)), extra(frame(spark, w))
    null = spark.createDataFrame([(1000, None, None)], "vec_id bigint, embedding array<double>, _struct array<double>")
    parts = (("embedding", "exp_euclidean", 0.65), ("_struct", "cosine", 0.35))
    rows = sim.knn(q.unionByName(null), b.unionByName(null), 5, parts, block=25).collect()
    x, y = np.round(v, 1), np.round(w, 1)
    u = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    s = 0.65 * np.exp(-np.linalg.norm(v[:, None] - w[None], axis=2)) + 0.35 * u(x) @ u(y).T
    best = np.sort(s, axis=1)[:, ::-1][:, :5]
    found = {}
    for r in sorted(rows, key=lambda r: (r["query"], r["rank"])):
        found.setdefault(r["query"], []).append(r["similarity"])
    assert len(found) == 60 and np.allclose([found[i] for i in range(60)], best, atol=1e-9)


def test_probe_finds_most(spark):
    df = frame(spark, clustered(300, spread=0.6))
    exact = sim.knn(df, df, 5, skip_self=True, block=20)
    assert 0.5 < sim.recall(sim.knn(df, df, 5, skip_self=True, block=20, probe=2), exact) < 1
    assert sim.recall(sim.knn(df, df, 5, skip_self=True, block=20, probe=15), exact) == 1
    assert sim.recall(exact, exact) == 1


def test_string_ids_and_empty_sides(spark):
    df = frame(spark, clustered(50)).withColumn("vec_id", F.concat(F.lit("t"), F.lpad("vec_id", 3, "0")))
    assert sim.knn(df, df, 3, skip_self=True, block=10).count() == 150
    assert sim.knn(df, df.limit(0), 3).count() == 0
    assert sim.knn(df.limit(0), df, 3, block=10).count() == 0
