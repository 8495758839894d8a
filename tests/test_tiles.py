"""What operators make of pairs inside the tasks that make them, against the same from rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallyrank.operators import graph as g
from tallyrank.operators import pairs as p
from test_layers import SUBSETS, WEIGHTS, layered, runs, same


@pytest.fixture
def made(spark, monkeypatch):
    monkeypatch.setattr(p, "FEW", -1)
    monkeypatch.setattr(p, "OUT_ROWS", 7)
    monkeypatch.setattr(p, "BLOCK", 8)
    monkeypatch.setattr(p, "CHEAP", 10 ** 9)
    e = runs(spark).filter("project is not null and tc_key is not null").cache()
    yield e
    e.unpersist()


def plain(edges):
    """The same edges as rows only."""
    rows = edges.select("*")
    assert p.tiles_of(edges, others=True) is not None and p.tiles_of(rows, others=True) is None
    return rows


def test_layers_as_rows(made):
    edges = layered(made)
    rows = plain(edges)
    for run in (lambda x: g.combine_edges(x, WEIGHTS), lambda x: g.combine_edges(x, {"co_failure": 1.0, "other": 2.0}, 0.2), g.edge_type_counts,
                lambda x: g.edge_ablation(x, WEIGHTS, SUBSETS), lambda x: g.edge_ablation(x, WEIGHTS | {"none": 1.0}, {"a": ["none"], "b": ["none", "temporal"]}, 0.0)):
        same(run(rows), run(edges))
    assert g.edge_type_counts(edges).count() == 6
    mean = g.combine_edges(edges, WEIGHTS)
    same(g.graph_stats(plain(mean), made), g.graph_stats(mean, made))
    two = g.layered_edges({"a": g.co_failure_layer(made), "b": g.commit_layer(made)}, block=8)
    same(g.hybrid_edges(plain(two)), g.hybrid_edges(two))


def test_weights_of_a_type(made, monkeypatch):
    """Product and join: equal edges, and the largest count without a row for a pair."""
    kinds = (lambda: g.co_failure_edges(made, 1, 0.2), lambda: g.co_outcome_edges(made, 0, 1, 0.1), lambda: g.commit_edges(made, 2, 0.4),
             lambda: g.component_edges(made.withColumn("component", F.col("commits")[0])))
    found = [run() for run in kinds]
    assert all(p.tiles_of(x) is not None for x in found)
    top = [r for r in g._largest(g._commit_pairs(g.commit_members(made), 1, 0.1, 100)).collect()]
    with monkeypatch.context() as m:
        m.setattr(p, "FEW", 10 ** 12)
        for run, tiled in zip(kinds, found):
            joined = run()
            assert p.tiles_of(joined) is None and tiled.columns == joined.columns and tiled.dtypes == joined.dtypes
            same(joined, tiled)
        assert sorted(map(tuple, top)) == sorted(map(tuple, g._largest(g._commit_pairs(g.commit_members(made), 1, 0.1, 100)).collect()))


def test_ends_drawn_edges_and_neighbours(spark, made):
    """Features come twice, are null, or belong to a test without edges; one project has no edge at all."""
    edges = g.co_outcome_edges(made, 1)
    rng = random.Random(8)
    feats = [(q, f"t{i}", None if i % 5 == 0 else rng.random(), None if q == "q" else i) for q, n in (("p", 40), ("q", 13), ("r", 3)) for i in range(n) for _ in range(1 + (i == 2))]
    feats = spark.createDataFrame(feats, "project string, tc_key string, x double, y int").filter("tc_key <> 't7'")
    nodes = feats.filter("tc_key not in ('t1', 't4')")
    for n in (edges, g.add_random_edges(edges, nodes, 30, 4)):
        same(plain(n).select("project", "src", "dst", "weight"), n.select("project", "src", "dst", "weight"))
        same(g.add_random_edges(plain(n), nodes, 12, 9), g.add_random_edges(n, nodes, 12, 9))
        sub = g.subgraph(n, nodes)
        same(g.subgraph(plain(n), nodes), sub)
        assert sub.filter("project = 'r' and src = dst").count() == 2 or n is not edges
        for columns in (["x", "y"], ["y"]):
            same(g.propagate(feats, plain(sub), columns), g.propagate(feats, sub, columns))
            same(g.propagate(nodes, plain(n), columns), g.propagate(nodes, n, columns))
    twice = g.subgraph(g.subgraph(edges, feats), nodes)
    same(g.subgraph(plain(g.subgraph(edges, feats)), nodes), twice)


def test_sums_leave_the_task_and_pairs_do_not(spark, made):
    """Of every two blocks there is a row for a project or a node, however many edges they have."""
    rows = [("p", f"b{b}", f"t{t}", 1, 1, t, [], []) for b in range(3) for t in range(60)]
    e = spark.createDataFrame(rows, made.schema)
    edges = g.layered_edges({"one": g.co_outcome_layer(e, 1), "two": g.co_failure_layer(e)}, block=20)
    assert [tuple(r) for r in g.edge_type_counts(edges).orderBy("edge_type").collect()] == [("p", "one", 1770), ("p", "two", 1770)]
    came = []

    def seen(tiles):
        rows = tiles.rows

        def spy(finish, schema):
            out = rows(finish, schema)
            came.append(out.count())
            return out
        tiles.rows = spy
        return tiles

    one = g.combine_edges(edges, {"one": 1.0})
    seen(one._tiles)
    stats = g.graph_stats(one, e).collect()[0]
    assert (stats.n_edges, stats.n_connected, stats.avg_weight) == (1770, 60, 1.0) and came.pop() < 300
    top = g.co_outcome_edges(e, 1)
    pairs = p.pair_counts(g.co_outcome_layer(e, 1).members, way="product", block=20)
    seen(pairs._tiles)
    assert g._largest(pairs).collect()[0]["_top"] == 3 and came.pop() <= 6
    assert top.count() == 1770
