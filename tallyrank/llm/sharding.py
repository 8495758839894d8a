"""K-d tree sharding: rows are split at weighted medians along their widest metadata dimension.

The weight of a row is its size, the UTF-8 bytes of its text plus 16, and the law is `bytes`:
leaves get nearly equal bytes. A node that is to give k leaves is cut so that its left part
holds floor(k/2)/k of its bytes. All nodes of a level are cut together: their widest dimension
comes from one grouping, and the cut from weighted histograms over the node's range that are
narrowed bin by bin until a bin holds one row or has no width left. The driver sees counts per
node and bin only, bounded by leaves times bins.

Dimensions: language, source (place of the value among all sorted values), log2 of the size, and
document id. Equal values are spread by a hash of the row, so a language, source or text with a
third of all rows can be cut like any other. Rows that are equal in everything cannot be told
apart and stay together.

Null and empty texts weigh 16; a null language, source or id sorts before all others. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.session import materialize

BINS = 256
#: Rounds of narrowing; 256^5 bins are finer than the hash that spreads equal values.
ROUNDS = 5
DIMS = ("d_lang", "d_source", "d_size", "d_id")


def _spread(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from a hash of the row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 33).cast("double") / F.lit(float(1 << 31))


def _place(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The number of distinct smaller values, as a dimension: one row per distinct value."""
    values = rows.select(column).distinct()
    ranked = values.select(F.col(column).alias("_v"), (F.dense_rank().over(W.orderBy(F.col(column).asc_nulls_first())) - 1).alias(name))
    return rows.join(ranked, rows[column].eqNullSafe(ranked["_v"])).drop("_v")


def coordinates(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions, without the text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialize(rows, "shard_rows")
    rows = _place(_place(rows, "lang", "_l"), "source", "_s")
    key = ("doc_id", "text_crc32", "size", "lang", "source")
    return materialize(rows.select(
        "doc_id", "size", "text_crc32", (F.col("_l") + _spread(1, *key)).alias("d_lang"),
        (F.col("_s") + _spread(2, *key)).alias("d_source"), (F.log2("size") + _spread(3, *key) / 1024).alias("d_size"),
        (F.coalesce(F.col("doc_id"), F.lit(-1)).cast("double") + _spread(4, *key) / 2).alias("d_id")), "coordinates")


def _by_node(values: dict[int, float | str], node: Column) -> Column:
    """A lookup over the nodes of one level, at most as many as leaves."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[node]


def _cuts(rows: DataFrame, nodes: dict[int, tuple[int, str, float, float]]) -> dict[int, float]:
    """For each node (leaves, dimension, low, high) the value below which its left bytes lie."""
    dim = {n: d for n, (_, d, _, _) in nodes.items()}
    value = F.coalesce(*[F.when(_by_node(dim, F.col("node")) == d, F.col(d)) for d in DIMS])
    at = rows.filter(F.col("node").isin(list(nodes))).select("node", "size", value.alias("v"))
    low, high = {n: x[2] for n, x in nodes.items()}, {n: x[3] for n, x in nodes.items()}
    share = {n: (k // 2) / k for n, (k, _, _, _) in nodes.items()}
    below = dict.fromkeys(nodes, 0.0)
    total: dict[int, float] = {}
    for _ in range(ROUNDS):
        a, b = _by_node(low, F.col("node")), _by_node(high, F.col("node"))
        inside = at.filter((F.col("v") >= a) & (F.col("v") <= b))
        width = F.when(b > a, (F.col("v") - a) / (b - a)).otherwise(0.0)
        bin_of = F.least(F.floor(width * BINS), F.lit(BINS - 1))
        got = inside.groupBy("node", bin_of.alias("bin")).agg(
            F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by_node: dict[int, list] = {n: [] for n in nodes}
        for r in got:
            by_node[r["node"]].append((r["bin"], r["w"], r["lo"], r["hi"]))
        for n, bins in by_node.items():
            bins.sort()
            total.setdefault(n, float(sum(w for _, w, _, _ in bins)))
            goal = share[n] * total[n]
            for _, w, lo, hi in bins:
                if below[n] + w >= goal:
                    low[n], high[n] = lo, hi
                    break
                below[n] += w
    # the last range goes to the side that leaves the smaller error
    out = {}
    for n in nodes:
        a, b = F.lit(low[n]), F.lit(high[n])
        out[n] = (low[n], high[n], below[n], share[n] * total[n], a, b)
    last = {r["node"]: float(r["w"]) for r in at.filter(
        (F.col("v") >= _by_node(low, F.col("node"))) & (F.col("v") <= _by_node(high, F.col("node"))))
        .groupBy("node").agg(F.sum("size").alias("w")).collect()}
    return {n: (lo if abs(under - goal) <= abs(under + last[n] - goal) else _after(hi))
            for n, (lo, hi, under, goal, _, _) in out.items()}


def _after(x: float) -> float:
    import math

    return math.nextafter(x, math.inf)


def kd_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 inside the shard)."""
    rows = coordinates(docs).withColumn("node", F.lit(0))
    ranges = rows.agg(*[F.min(d).alias(f"lo_{d}") for d in DIMS], *[F.max(d).alias(f"hi_{d}") for d in DIMS]).first()
    whole = {d: (ranges[f"hi_{d}"] - ranges[f"lo_{d}"]) or 1.0 for d in DIMS} if ranges["lo_d_id"] is not None else {}
    leaves, level = {0: shards}, 0  # a node is numbered by the first shard below it
    while whole and any(k > 1 for k in leaves.values()):
        stats = rows.groupBy("node").agg(
            *[F.min(d).alias(f"lo_{d}") for d in DIMS], *[F.max(d).alias(f"hi_{d}") for d in DIMS],
            *[F.stddev_pop(d).alias(f"sd_{d}") for d in DIMS]).collect()
        nodes = {}
        for r in stats:
            if leaves[r["node"]] > 1:
                widest = max(DIMS, key=lambda d: ((r[f"sd_{d}"] or 0.0) / whole[d], d))
                nodes[r["node"]] = (leaves[r["node"]], widest, r[f"lo_{widest}"], r[f"hi_{widest}"])
        if not nodes:
            break
        cuts = _cuts(rows, nodes)
        right = F.lit(False)
        for n, (k, d, _, _) in nodes.items():
            right = F.when(F.col("node") == n, F.col(d) >= cuts[n]).otherwise(right)
        half = {n: k // 2 for n, (k, _, _, _) in nodes.items()}
        rows = rows.withColumn("node", F.when(right, F.col("node") + _by_node(half, F.col("node"))).otherwise(F.col("node")))
        level += 1
        rows = materialize(rows, f"level{level}")
        leaves = {m: v for n, k in leaves.items() for m, v in (((n, k // 2), (n + k // 2, k - k // 2)) if k > 1 else ((n, 1),))}
    return _slots(rows.withColumn("shard", F.col("node").cast("int")))


def _slots(rows: DataFrame, rows_per_part: int = 20_000) -> DataFrame:
    """Number rows inside each shard: short runs are numbered on their own, and each adds the
    rows of the runs before it."""
    n = rows.count()
    parts = max(1, n // rows_per_part)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    sizes = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32")
    return rows.withColumn("_r", F.row_number().over(inside) - 1).join(sizes, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_r")).cast("bigint").alias("slot"))


def op6(spark, sf_dir: str) -> DataFrame:
    out = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
