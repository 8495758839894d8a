"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.session import materialize, owner_of, release, scratch_of


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None]],
                schema: str, rows: int = 500) -> DataFrame:
    """`mapInArrow` with one prepared function per task, fed at most `rows` rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def text_key(text: str = "text") -> Column:
    """128-bit content key of a text; null and empty share one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def crc_mod(column: str, m: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def flat(arrays: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated values and Arrow list offsets."""
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    return (np.concatenate(arrays).astype(dtype) if arrays else np.empty(0, dtype)), ends


def list_column(arrays: list[np.ndarray], dtype) -> pa.Array:
    values, ends = flat(arrays, dtype)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of `edges` (a, b): one row (node, root) per node that has an edge,
    root being the smallest node of the component.

    Alternating star steps: each round joins every node's neighbours to the smallest of them,
    first for larger neighbours, then for smaller ones. Rows never exceed the edges, a hub's
    neighbours are aggregated before they are joined, and the rounds grow with the logarithm
    of the nodes. Every round is written to the shared folder and the round before deleted; `release`
    frees the last one.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), name)
    last = None
    while True:
        near = both(edges)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, large = edges, materialize(large.filter("a <> b").distinct(), name)
        # every edge now points to a smaller node; a node joins all its smaller ones to their smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), name)
        release(before, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == last:
            break
        last = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return owner_of(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), *scratch_of(edges))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of every run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(seed | 1) + words[k:k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))
