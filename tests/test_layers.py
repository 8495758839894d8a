"""Edges of several types counted together, against the same edges made one type at a time."""

import random

from pyspark.sql import functions as F

from tallyrank.functions.hashing import hash_int
from tallyrank.operators import graph as g
from tallyrank.operators import pairs as p
from tallyrank.operators import sampling as s
from tallyrank.operators.chronology import holdout_split, temporal_split
from tallyrank.operators.clean import label_distribution, last_builds
from tallyrank.operators.scale import number_rows
from tallyrank.sources.writers import per_project

COLUMNS = "project string, build_id string, tc_key string, fail int, verdict int, exec_ts bigint, commits array<string>, crs array<string>"
WEIGHTS = {"co_failure": 1.0, "co_success": 0.5, "temporal": 0.3}
SUBSETS = {"all": list(WEIGHTS), "some": ["co_failure", "temporal"]}


def runs(spark):
    rng = random.Random(3)
    rows = []
    for project, tests in (("p", 40), ("q", 13), (None, 4)):
        for b in range(25):
            for i, t in enumerate(rng.sample(range(tests), rng.randrange(1, min(tests, 20)))):
                v = rng.choice((0, 0, 1, 2))
                rows.append((project, f"b{b}", None if t == 3 else f"t{t}", int(v == 1), v, i, [f"k{rng.randrange(30)}"], []))
    return spark.createDataFrame(rows, COLUMNS)


def layered(e, block=8):
    return g.layered_edges({"co_failure": g.co_outcome_layer(e, 1), "co_success": g.co_outcome_layer(e, 0)}, {"temporal": g.temporal_counts(e)}, block)


def typed(e):
    parts = {"co_failure": g.co_outcome_edges(e, 1), "co_success": g.co_outcome_edges(e, 0), "temporal": g.temporal_edges(e)}
    return [g.typed(x, t) for t, x in parts.items()]


def same(a, b):
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(a) == rows(b.select(a.columns)) and a.columns


def test_layers_agree_with_types(spark):
    e = runs(spark).filter("project is not null and tc_key is not null")
    x, y, z = typed(e)
    long, wide = x.unionByName(y).unionByName(z), layered(e)
    same(g.combine_edges(long, WEIGHTS), g.combine_edges(wide, WEIGHTS))
    same(g.edge_ablation(long, WEIGHTS, SUBSETS), g.edge_ablation(wide, WEIGHTS, SUBSETS))
    same(g.edge_type_counts(long), g.edge_type_counts(wide))
    assert wide.select("project", "src", "dst").distinct().count() == wide.count()
    both = g.layered_edges({"a": g.co_failure_layer(e), "b": g.commit_layer(e)}, block=8)
    same(g.hybrid_edges(g.co_failure_edges(e), g.commit_edges(e)), g.hybrid_edges(both))


def test_no_pair_is_shuffled(spark, monkeypatch):
    """What is put together of several types leaves the task that made it only as a result."""
    e = runs(spark)
    monkeypatch.setattr(p, "FEW", 0)
    for df in (g.combine_edges(layered(e), WEIGHTS), p.pair_counts(g.co_outcome_layer(e).members, way="product", block=8)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan[:plan.index("MapInArrow")].replace("BroadcastExchange", "")


def test_uneven_nodes_and_many_blocks(spark, monkeypatch):
    """Blocks by rows: one test in every build, many in few; batches and chunks of a few rows."""
    for name, value in (("GRID", 3), ("BLOCK_ROWS", 40), ("OUT_ROWS", 3), ("AT_ONCE", 5), ("MOST_TASKS", 2)):
        monkeypatch.setattr(p, name, value)
    rows = [("p", f"b{b}", "all") for b in range(70)] + [("p", f"b{b}", f"n{(b * k) % 17}") for b in range(70) for k in (1, 2, 5)]
    df = spark.createDataFrame(sorted(set(rows)), "project string, bucket string, node string")
    want = {tuple(r) for r in p.pair_counts(df, way="join").collect()}
    for dense in (0, 10 ** 9):
        monkeypatch.setattr(p, "DENSE", dense)
        got = p.pair_counts(df, way="product", block=4, stretch=8).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_drawn_edges_and_ends(spark):
    """Both directions and loops as before, each edge once."""
    e = runs(spark).filter("project is not null and tc_key is not null")
    edges = g.co_outcome_edges(e, 1)
    sub = g.subgraph(edges.filter("project = 'p'"), e)
    assert sub.filter("project = 'p'").count() == 2 * edges.filter("project = 'p'").count()
    assert sub.filter("project = 'q'").filter(F.col("src") == F.col("dst")).count() == e.filter("project = 'q'").select("tc_key").distinct().count()


def test_split_orders_only_edges_at_a_cut(spark, monkeypatch):
    """The shares of a hash order, whatever the number of digits counted, with next to nothing numbered."""
    rng = random.Random(9)
    rows = [(q, f"a{i}", f"b{rng.randrange(9)}", i / 7) for q, n in (("p", 400), ("q", 7), ("r", 1)) for i in range(n)]
    edges = spark.createDataFrame(rows, "project string, src string, dst string, weight double")
    order = edges.withColumn("h", hash_int(F.col("src"), F.col("dst"), 42)).orderBy("project", "h", "src", "dst").collect()
    want, sizes = {}, {"p": 400, "q": 7, "r": 1}
    for q, n in sizes.items():
        for i, r in enumerate([r for r in order if r.project == q]):
            want[q, r.src, r.dst] = "test" if i < int(n * 0.1) else "val" if i < 2 * int(n * 0.1) else "train"
    numbered = []
    monkeypatch.setattr(s, "number_rows", lambda df, *a, **b: (numbered.append(df.count()), number_rows(df, *a, **b))[1])
    for bits in (0, 3, 16):
        monkeypatch.setattr(s, "BIN_BITS", bits)
        got = s.split_edges(edges)
        assert {(r.project, r.src, r.dst): r.split for r in got.collect()} == want and got.columns == [*edges.columns, "split"]
    assert numbered[-1] <= 8
    whole = s.split_edges(edges, 0.5, 0.5).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in whole} == {"test": 203, "val": 203, "train": 2}


def test_project_tables_do_not_move_the_rows(spark):
    """Sizes, newest builds and counts: no join deals all rows by project, however large they are taken to be."""
    e = spark.createDataFrame([("p", f"b{i}", f"t{i % 3}", i, i % 2) for i in range(50)], "project string, build_id string, tc_key string, build_idx bigint, fail int")
    big = e.join(e.select(F.col("build_idx").alias("k")).repartition(3), F.col("build_idx") <= F.col("k") % 7)
    for df in (holdout_split(big), temporal_split(big), last_builds(big, 4)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan, plan
    per = label_distribution(e, "project").collect()[0]
    assert (per.n_rows, per.n_failures, per.n_builds, per.n_tests) == (50, 25, 50, 3)


def test_reports_make_the_grades_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    grades = spark.createDataFrame([("p", f"b{i}", 3, 1, i / 9) for i in range(10)], "project string, build_id string, count_tc bigint, n_failures bigint, apfd double")
    one = per_project(grades.mapInArrow(count, grades.schema)).collect()
    assert made.value == 10 and len(one) == 1
