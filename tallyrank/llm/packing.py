"""Hierarchical residual packing of token pieces into sequences of bounded length.

Every partition packs its pieces best-fit, longest first. Bins that are nearly full are final.
The others travel up a tree as items of their own: `fan_in` partitions meet, their open bins
are packed best-fit into each other, and so on up to one partition. After best fit at most one bin
of a partition is half empty or emptier (two such would share a bin), and bins that are more than
half full never join each other. So a meeting joins no more than `fan_in` bins, and of bins with
equal fill it can use no more than that: a partition hands on every emptier bin and, of each fill,
`fan_in` bins for every round to come. What stays behind could not have been used, which bounds
every task by the number of fills and not by the rows.

Null and empty texts hold the end id alone. Repeated rows are packed each for itself; equal
lengths keep the order of the row numbers given when the pieces were written. An empty table
gives no rows. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import map_batches, texts_of
from tallyrank.llm.tokens import END_ID, encoder, tokenizer_path
from tallyrank.session import materialize

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """Encoded texts cut into pieces of at most `capacity` ids; only longer texts are cut.

    The first piece takes what does not fill a whole one. `keep_ids` adds the ids (binary,
    unsigned 32-bit little-endian).
    """
    path = tokenizer or tokenizer_path()

    def make() -> Callable:
        enc = encoder(path)

        def work(batch: pa.RecordBatch) -> pa.Table:
            ids_of, out = batch.column(0).to_pylist(), {k: [] for k in ("d", "p", "s", "l", "c", "b")}
            for doc, text in zip(ids_of, texts_of(batch)):
                data = enc.ids(text, end_id).tobytes()
                n = len(data) // 4
                first = n % capacity or capacity
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    size = first if k == 0 else capacity
                    part = data[4 * at:4 * (at + size)]
                    for key, v in zip("dpslcb", (doc, k, at, size, zlib.crc32(part), part)):
                        out[key].append(v)
            cols = [pa.array(out["d"], pa.int64()), pa.array(out["p"], pa.int32()), pa.array(out["s"], pa.int64()),
                    pa.array(out["l"], pa.int64()), pa.array(out["c"], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(out["b"], pa.binary())], [*names, "ids"]
            return pa.table(cols, names=names)

        return work

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, make, PIECE + (", ids binary" if keep_ids else ""))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin; items by falling size go to the
    fullest bin that takes them. Open room is kept as bits, so the tightest bin is one shift away."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, fills = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fitting = room >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                room ^= 1 << r
        else:
            b, r = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, capacity - r
        fills[b] = capacity - r + s
        if r > s:
            with_room[r - s].append(b)
            room |= 1 << (r - s)
    return bins, offsets, np.array(fills, np.int64)


def handed_on(fills: np.ndarray, capacity: int, slack: int, alike: int, carry: int | None = None) -> np.ndarray:
    """Which bins travel on: of each fill above half at most `alike`, and all others that are not
    nearly full; with `carry` only that many of them, the emptiest."""
    order = np.argsort(fills, kind="stable")
    size = fills[order]
    place = np.arange(len(size)) - np.searchsorted(size, size)
    on = order[(size < capacity - slack) & ((place < alike) | (size <= capacity // 2))]
    opened = np.zeros(len(fills), bool)
    opened[on[:carry]] = True
    return opened


def _pack_round(items: DataFrame, level: int, capacity: int, slack: int, alike: int, carry: int | None) -> DataFrame:
    """One best-fit round in every partition `part` of items (part, id, size)."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        part = int(group["part"].iloc[0])
        bins, offsets, fills = best_fit(group["size"].to_numpy(), capacity)
        opened = handed_on(fills, capacity, slack, alike, carry)
        return pd.DataFrame({
            "part": part, "id": group["id"], "bin": (level << 58) + (part << 26) + bins, "off": offsets,
            "fill": fills[bins], "open": opened[bins],
        })

    return items.groupBy("part").applyInPandas(run, "part bigint, id bigint, bin bigint, off bigint, fill bigint, open boolean")


def pack(cut: DataFrame, capacity: int = 1024, local_items: int = 16384, fan_in: int = 8, slack: int = 8,
         carry: int | None = None) -> DataFrame:
    """`cut` (from `pieces`) with sequence_id and offset: its place in the sequence, gapless from 0.

    `slack` ids short of full counts as nearly full. A task holds about `local_items` items in the
    first round, later at most `fan_in` times `fan_in` bins of each fill for each round to come;
    `carry` bounds them further, at the price of bins that could have been joined.
    """
    rows = materialize(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    items = rows.filter(F.col("length") < capacity).select(F.col("_row").alias("id"), F.col("length").alias("size"))
    parts = max(1, math.ceil(items.count() / local_items))
    items = items.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    level, found = 0, []
    while True:
        rounds, left = 0, parts
        while left > 1:
            rounds, left = rounds + 1, math.ceil(left / fan_in)
        done = materialize(_pack_round(items, level, capacity, slack, fan_in * rounds, carry), "packed")
        found.append(done)
        if parts == 1:
            break
        parts, level = math.ceil(parts / fan_in), level + 1
        items = done.filter(F.col("open") & (F.col("off") == 0)).select(
            F.floor(F.col("part") / fan_in).alias("part"), F.col("bin").alias("id"), F.col("fill").alias("size"))
    placed = found[0].select(F.col("id").alias("_row"), "bin", F.col("off").alias("offset"))
    for done in found[1:]:
        up = done.select(F.col("id").alias("bin"), F.col("bin").alias("_up"), "off")
        placed = placed.join(up, "bin", "left").select(
            "_row", F.coalesce("_up", "bin").alias("bin"), (F.col("offset") + F.coalesce("off", F.lit(0))).alias("offset"))
    out = rows.join(placed, "_row", "left")
    # a piece that fills a sequence alone never enters a bin; odd and even numbers keep the two apart
    return out.select(
        *[c for c in cut.columns], F.coalesce(F.col("bin") * 2, F.col("_row") * 2 + 1).alias("sequence_id"),
        F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence with its ids (binary, 32-bit little-endian); needs `keep_ids`."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["ids"])), "")).alias("ids"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs))
