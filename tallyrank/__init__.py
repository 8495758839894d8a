"""Test-history analytics on Spark: history features, graphs, ranking, grading."""
