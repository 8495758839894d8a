"""A bounded sample of labelled texts for the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """Training texts with their label `y`: all labelled training rows, or the `most` of them with
    the smallest id hash. The labels' side is bounded by `most` before it is joined."""
    picked = labels.filter(train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    picked = picked.select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    picked = picked.orderBy(F.xxhash64("doc_id", "y"), "doc_id", "y").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def one_class(y) -> float | None:
    """The score of every text where the sample has no two classes."""
    seen = pd.unique(pd.Series(y))
    return None if len(seen) > 1 else float(seen[0]) if len(seen) else 0.5
