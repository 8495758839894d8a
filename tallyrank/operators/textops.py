"""Table-level text work: length profiles, commit counts, encoding of distinct texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions.hashing import hash_int
from tallyrank.functions.text import char_budget, distinct_changes
from tallyrank.operators.clean import BUILD
from tallyrank.operators.scale import running_sums


def length_profile(df: DataFrame, text: str, max_tokens: int = 512,
                   percentiles: Sequence[int] = (50, 75, 90, 95, 99)) -> DataFrame:
    """Count, extremes, mean, the length at index int(n * p / 100), share over the budget.

    Rows are counted per length first; only the distinct lengths are put in order.
    """
    limit = char_budget(max_tokens)
    lens = df.groupBy(F.length(F.coalesce(F.col(text), F.lit(""))).alias("len")).agg(F.count(F.lit(1)).alias("c"))
    cum = running_sums(lens, [], [F.col("len")], {"upto": "c"})
    n = lens.agg(F.sum("c").alias("n"))
    j = cum.crossJoin(F.broadcast(n))

    def at(p):
        idx = F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
        return F.min(F.when(F.col("upto") > idx, F.col("len")))

    over = F.sum(F.when(F.col("len") > limit, F.col("c")).otherwise(0))
    return j.agg(
        F.max("n").alias("count"), F.min("len").alias("min"), F.max("len").alias("max"),
        (F.sum(F.col("len") * F.col("c")) / F.max("n")).alias("mean"), at(50).alias("median"),
        *[at(p).alias(f"p{p}") for p in percentiles],
        over.alias("exceeding"), (over * 100.0 / F.max("n")).alias("exceeding_pct"))


def build_commit_count(df: DataFrame) -> DataFrame:
    """Distinct commits and change requests over all rows of a build, at least 1."""
    items = df.select(*BUILD, F.explode_outer(distinct_changes(F.col("commits"), F.col("crs"))).alias("c")).distinct()
    return items.groupBy(*BUILD).agg(F.greatest(F.count("c"), F.lit(1)).alias("count_commits"))


def encode_distinct(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "embedding") -> DataFrame:
    """Encode each distinct text once, in Arrow batches, and join the vectors back."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = np.asarray(encoder(list(b["text"])), dtype=np.float32)
            yield pd.DataFrame({"_key": b["_key"], out: list(vectors)})

    # grouped and joined by digest, so that the long text is not a sort key
    keyed = df.withColumn("_key", F.sha2(text, 256))
    once = keyed.filter(F.col(text).isNotNull()).groupBy("_key").agg(F.first(text).alias("text"))
    vectors = once.mapInPandas(run, f"_key string, {out} array<float>")
    return keyed.join(vectors, "_key", "left").drop("_key")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in a lambda; a plain reference is recomputed there."""
    return F.get(F.transform(F.array(value), use), 0)


def hash_embedding(text: Column, dim: int = 64, seed: int = 42) -> Column:
    """The same unit vector for the same text, whatever the run."""
    def numbers(key):
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: hash_int(key, i, seed, digits=8) / 2147483648.0 - 1.0)

    def unit(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return _let(norm, lambda n: F.transform(v, lambda x: x / n))

    return _let(F.md5(F.coalesce(text, F.lit(""))), lambda key: _let(numbers(key), unit))
