"""No registered query with an SQL twin is empty or constant on the tables it is checked on."""

import pytest
from oracle_check import connect

from __spark_entry__ import oracle_sql

#: A query with no more than this says nothing.
ONE_ROW = 1


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", ["semantic_edges", "unseen_tests", "knn_adjacency", "knn_impute", "score_orphans", "co_run_edges_parts",
                                  "evaluate_strategies", "read_strategy_rankings", "negative_edges", "build_batches"])
def test_has_rows_that_differ(con, name):
    rows = con.execute(oracle_sql()[name]).fetchall()
    assert len(rows) > ONE_ROW and len(set(rows)) > ONE_ROW


def test_both_branches_are_taken(con):
    neighbours = [r[0] for r in con.execute(f"SELECT neighbors FROM ({oracle_sql()['knn_impute']})").fetchall()]
    assert 0 < sum(n == 0 for n in neighbours) < len(neighbours)
    assert {r[0] for r in con.execute(f"SELECT DISTINCT strategy FROM ({oracle_sql()['evaluate_strategies']})").fetchall()} == {
        "untreated", "random", "recently-failed", "optimal-failure", "optimal-failure-duration", "matrix-naive", "matrix-conditional-prob"}
