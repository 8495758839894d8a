"""Vectors are sent once, however many balls are visited."""

import numpy as np
from tallyrank.operators import similarity as sim
from tallyrank.session import materialize
from test_pairs_and_balls import brute_best, frame


def test_visits_are_no_rows(spark, monkeypatch):
    """Vectors without structure: every ball is visited, and no table grows with the visits."""
    v, seen, stored = np.random.default_rng(2).normal(size=(300, 8)), {}, []

    def spy(df, name="cut"):
        out = materialize(df, name)
        stored.append(out.count())
        return out

    monkeypatch.setattr(sim, "materialize", spy)
    monkeypatch.setattr(sim, "SLICE", 32)
    df = frame(spark, v)
    found = sim.knn(df, df, 3, skip_self=True, block=15, visits=seen).collect()
    rows = sorted((r["query"], r["rank"], r["neighbor"], round(r["similarity"], 9)) for r in found)
    assert [(q, n, s) for q, _, n, s in rows] == brute_best(v, v, 3, "cosine", True)
    assert seen["made"] > 0.9 * seen["possible"] == 0.9 * 300 * 20 and max(stored) == 300 * 3


def test_equal_vectors_and_ids_that_come_twice(spark):
    """Rows that come twice are two neighbours and two queries, as in SQL."""
    v = np.round(np.random.default_rng(4).normal(size=(40, 3)), 1)
    rows = [(i % 30, [float(x) for x in v[i % 30 if i < 60 else 0]]) for i in range(70)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = sorted((r.query, r["rank"], r.neighbor, round(r.similarity, 9)) for r in sim.knn(df, df, 4, skip_self=True, block=100).collect())
    got = sorted((r.query, r["rank"], r.neighbor, round(r.similarity, 9)) for r in sim.knn(df, df, 4, skip_self=True, block=7).collect())
    assert got == want and len(got) == 120
