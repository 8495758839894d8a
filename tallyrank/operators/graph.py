"""Weighted test-to-test graphs and the commit graph. Edges have src < dst."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrank.functions.hashing import hash_int, uniform
from tallyrank.operators.clean import BUILD
from tallyrank.operators.pairs import BLOCK, HOT_BUCKET, Tile, busiest_overlap, others_of, pair_counts, pair_layers, tiles_of
from tallyrank.operators.scale import number_rows
from tallyrank.session import materialize

SCOPE = ["project"]


def _at_least(share: float, min_count: int):
    """The fewest shared buckets for a node with n: a share of n, at least min_count."""
    return lambda n: F.greatest(F.ceil(n * F.lit(float(share)) - F.lit(1e-9)), F.lit(int(min_count)))


def _members(df: DataFrame, node: str, bucket: Column) -> DataFrame:
    return df.select(*SCOPE, bucket.alias("bucket"), F.col(node).alias("node")).distinct()


def co_failure_edges(df: DataFrame, min_count: int = 2, threshold: float = 0.1,
                     hot: int = HOT_BUCKET) -> DataFrame:
    """Tests failing in the same builds; weight = mean of the two conditional shares."""
    layer = co_failure_layer(df, min_count, threshold)
    return _edges(pair_counts(layer.members, SCOPE, layer.need, hot), layer.weight, threshold)


def co_outcome_edges(df: DataFrame, verdict: int = 1, min_count: int = 1, threshold: float = 0.05,
                     hot: int = HOT_BUCKET) -> DataFrame:
    """Tests with the same verdict in the same builds; weight = smaller conditional share."""
    layer = co_outcome_layer(df, verdict, min_count, threshold)
    return _edges(pair_counts(layer.members, SCOPE, layer.need, hot), layer.weight, threshold)


class Layer(NamedTuple):
    """What makes one type of edges: who shares what, how much is needed, the weight of (shared, n_src, n_dst, greatest),
    columns or arrays, or of shared ÷ the largest count of its project if `top` (project, _top) is given."""

    members: DataFrame
    need: Callable[[Column], Column]
    weight: Callable | None
    threshold: float
    top: DataFrame | None = None


def co_failure_layer(df: DataFrame, min_count: int = 2, threshold: float = 0.1) -> Layer:
    members = _members(df.filter("fail = 1"), "tc_key", F.col("build_id"))
    # the mean reaches t only if the smaller share is at least 2t - 1
    return Layer(members, _at_least(max(2 * threshold - 1, 0.0), min_count),
                 lambda shared, n, m, most: (shared / n + shared / m) / 2.0, threshold)


def co_outcome_layer(df: DataFrame, verdict: int = 1, min_count: int = 1, threshold: float = 0.05) -> Layer:
    members = _members(df.filter(F.col("verdict") == verdict), "tc_key", F.col("build_id"))
    return Layer(members, _at_least(threshold, min_count), lambda shared, n, m, most: shared / most(n, m), threshold)


def commit_layer(df: DataFrame, min_count: int = 1, threshold: float = 0.1, hot: int = HOT_BUCKET) -> Layer:
    members = materialize(commit_members(df), "commits")
    return Layer(members, lambda n: F.lit(int(min_count)), None, threshold, _largest(_commit_pairs(members, min_count, threshold, hot)))


def _largest(pairs: DataFrame) -> DataFrame:
    """The largest count of each project, combined where the pairs are made: one row a project is kept."""
    tiles = tiles_of(pairs)
    if tiles is None:
        return materialize(pairs.groupBy(*SCOPE).agg(F.max("shared").alias("_top")), "largest")

    def finish(made: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        for tile in made:
            at, start = tile.by_scope()
            yield _sums(tile, at, {"_top": np.maximum.reduceat(tile.counts[0], start)})

    top = tiles.rows(finish, _of_scope(tiles) + "_top bigint").groupBy(*SCOPE).agg(F.max("_top").alias("_top"))
    return materialize(top, "largest")


def _of_scope(tiles) -> str:
    return "".join(f"{c} {kind}, " for c, kind in zip(SCOPE, tiles.kinds))


def _sums(tile: Tile, at: np.ndarray, columns: dict) -> pa.RecordBatch:
    """Sums of a tile, a row for the scope of each node in `at`."""
    return pa.RecordBatch.from_pydict({c: v.take(pa.array(at)) for c, v in zip(SCOPE, tile.left.columns)} | {c: pa.array(v) for c, v in columns.items()})


def _columns(*names: str) -> Callable[[Tile], dict]:
    return lambda tile: {c: pa.array(tile.values[c], mask=np.isnan(tile.values[c]) if tile.values[c].dtype.kind == "f" else None) for c in names}


def _weighed(parts: Sequence[tuple], shared: bool = False) -> Callable[[Tile], Tile]:
    """Weights of (type, layer, weight, threshold, top), NaN where there is no edge; pairs without any edge are left out."""
    def step(tile: Tile) -> Tile:
        values = {}
        for name, x, weight, threshold, top in parts:
            there = np.flatnonzero(tile.counts[x] >= 0) if len(tile.counts) > 1 else slice(None)
            count, i, j = tile.counts[x][there].astype(np.float64), tile.i[there], tile.j[there]
            w = weight(count, tile.left.n[x][i], tile.right.n[x][j], np.maximum) if top is None else count / tile.left.values[top][i]
            values[name] = np.full(len(tile.i), np.nan)
            values[name][there] = np.where(w >= threshold, w, np.nan)
        keep = reduce(np.logical_or, [~np.isnan(v) for v in values.values()])
        return tile.having(values | ({"shared": tile.counts[0]} if shared else {})).kept(keep)
    return step


def _unless_null(tile: Tile, name: str) -> np.ndarray:
    return np.where(np.isnan(tile.values[name]), 0.0, tile.values[name])


def layered_edges(layers: dict[str, Layer], given: dict[str, DataFrame] | None = None, block: int = BLOCK) -> DataFrame:
    """The edges of several types with one row for a pair: project, src, dst and a column for each type with
    its weight, null where there is no such edge.

    All types are counted together (`pair_layers`), so that putting them side by side moves no edge. `given`
    names one more type and its counts (project, src, dst, shared), weighed by the largest.
    """
    (name, known), = (given or {None: None}).items()
    counts = None if known is None else known.select(*SCOPE, "src", "dst", F.col("shared").alias("given"))
    tiles = tiles_of(pair_layers([(x.members, x.need) for x in layers.values()], counts, SCOPE, block))
    parts = [(t, x.weight, x.threshold, x.top) for t, x in layers.items()]
    if known is not None:
        parts.append((name, None, 0.0, _largest(known)))
    weighed = []
    for k, (t, weight, threshold, top) in enumerate(parts):
        if top is not None:
            tiles = tiles.with_values(top, SCOPE, ["_top"], [f"top_{k}"])
        weighed.append((t, k, weight, threshold, None if top is None else f"top_{k}"))
    return tiles.then(_weighed(weighed)).frame(", ".join(f"{t} double" for t, *_ in parts), _columns(*[t for t, *_ in parts]))


def _edges(pairs: DataFrame, weight: Callable, threshold: float, top: DataFrame | None = None) -> DataFrame:
    """Edges of `pairs` by `weight` of (shared, n_src, n_dst, greatest), or shared ÷ the project's `top`."""
    tiles = tiles_of(pairs)
    if tiles is None:
        pairs = pairs if top is None else pairs.join(top, SCOPE)
        value = weight(F.col("shared"), F.col("n_src"), F.col("n_dst"), F.greatest) if top is None else F.col("shared") / F.col("_top")
        return pairs.select(*SCOPE, "src", "dst", "shared", value.alias("weight")).filter(F.col("weight") >= threshold)
    if top is not None:
        tiles = tiles.with_values(top, SCOPE, ["_top"], ["top"])
    step = _weighed([("weight", 0, weight, threshold, None if top is None else "top")], shared=True)
    return tiles.then(step).frame("shared bigint, weight double", _columns("shared", "weight"))


def commit_members(df: DataFrame) -> DataFrame:
    """Distinct (commit or change request, test)."""
    changes = F.concat("commits", F.transform("crs", lambda c: F.concat(F.lit("CR_"), c)))
    return _members(df.withColumn("_c", F.explode(changes)), "tc_key", F.col("_c"))


def commit_edges(df: DataFrame, min_count: int = 1, threshold: float = 0.1, hot: int = HOT_BUCKET) -> DataFrame:
    """Tests sharing commits or change requests; weight = shared ÷ largest shared.

    The largest count is at least that of the busiest tests, so a pair below the threshold's
    share of theirs is no edge and need not be counted.
    """
    members = materialize(commit_members(df), "commits")
    # counted twice, for the largest count and for the edges: cheaper than storing the pairs
    pairs = _commit_pairs(members, min_count, threshold, hot)
    return _edges(pairs, None, threshold, _largest(pairs))


def _commit_pairs(members: DataFrame, min_count: int, threshold: float, hot: int) -> DataFrame:
    least = lambda rows: busiest_overlap(rows, SCOPE).withColumn(
        "least", F.ceil(F.col("least") * F.lit(float(threshold)) - F.lit(1e-9)))
    return pair_counts(members, SCOPE, lambda n: F.lit(int(min_count)), hot, least=least)


def component_edges(df: DataFrame, threshold: float = 0.05, hot: int = HOT_BUCKET) -> DataFrame:
    """Jaccard overlap of the component sets of two tests."""
    members = _members(df.filter(F.col("component").isNotNull()), "tc_key", F.col("component"))
    pairs = pair_counts(members, SCOPE, _at_least(threshold, 1), hot)
    return _edges(pairs, lambda shared, n, m, most: shared / (n + m - shared), threshold)


def temporal_edges(df: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Tests run next to each other in a build; weight = count ÷ largest count.

    Positions are numbered and each is joined to the next, which splits large builds.
    """
    c = temporal_counts(df, sizes)
    return c.join(_largest(c), SCOPE).select(*SCOPE, "src", "dst", "shared", (F.col("shared") / F.col("_top")).alias("weight"))


def temporal_counts(df: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """How often two tests run next to each other in a build."""
    pos = number_rows(df.select(*BUILD, "tc_key", "exec_ts"), BUILD, [F.col("exec_ts"), F.col("tc_key")], "_i", sizes=sizes)
    nxt = pos.select(*BUILD, (F.col("_i") - 1).alias("_i"), F.col("tc_key").alias("_next"))
    j = pos.join(nxt, [*BUILD, "_i"]).filter(F.col("tc_key") != F.col("_next"))
    c = j.groupBy(*SCOPE, F.least("tc_key", "_next").alias("src"), F.greatest("tc_key", "_next").alias("dst")).agg(
        F.count(F.lit(1)).alias("shared"))
    return materialize(c)  # read twice: for the largest count and for the edges


def hybrid_edges(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Mean of two graphs; an edge in only one of them counts half. Two types of `layered_edges` are already
    side by side."""
    if b is None and tiles_of(a) is not None:
        one, other = _types(a)
        step = lambda tile: tile.having({"weight": (_unless_null(tile, one) + _unless_null(tile, other)) / 2.0})
        return tiles_of(a).then(step).frame("weight double", _columns("weight"))
    if b is None:
        first, second = [F.coalesce(F.col(t), F.lit(0.0)) for t in _types(a)]
        return a.select(*SCOPE, "src", "dst", ((first + second) / 2.0).alias("weight"))
    both = a.select(*SCOPE, "src", "dst", "weight").unionByName(b.select(*SCOPE, "src", "dst", "weight"))
    return both.groupBy(*SCOPE, "src", "dst").agg((F.sum("weight") / 2.0).alias("weight"))


def _types(edges: DataFrame) -> list[str]:
    """The columns of `layered_edges` that are types."""
    return [c for c in edges.columns if c not in (*SCOPE, "src", "dst")]


def typed(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.select(*SCOPE, "src", "dst", F.lit(edge_type).alias("edge_type"), "weight")


def combine_edges(edges: DataFrame, weights: dict[str, float], threshold: float = 0.05) -> DataFrame:
    """Weighted mean over all enabled edge types; a missing type counts 0. `edges` are typed edges, or
    layered ones, which need no grouping."""
    total = sum(weights.values())
    if "edge_type" not in edges.columns:
        have = [t for t in weights if t in edges.columns]
        if tiles_of(edges) is not None:
            def step(tile: Tile) -> Tile:
                mean = sum((_unless_null(tile, t) * float(weights[t]) for t in have), 0.0) / float(total)
                there = reduce(np.logical_or, [~np.isnan(tile.values[t]) for t in have])
                return tile.having({"weight": mean}).kept(there & (mean >= threshold))

            return tiles_of(edges).then(step).frame("weight double", _columns("weight"))
        mean = sum((F.coalesce(F.col(t), F.lit(0.0)) * F.lit(float(weights[t])) for t in have), F.lit(0.0)) / F.lit(float(total))
        out = edges.filter(F.coalesce(*have).isNotNull()).select(*SCOPE, "src", "dst", mean.alias("weight"))
        return out.filter(F.col("weight") >= threshold)
    w = F.coalesce(*[F.when(F.col("edge_type") == t, F.lit(float(v))) for t, v in weights.items()], F.lit(0.0))
    out = edges.filter(F.col("edge_type").isin(*weights)).groupBy(*SCOPE, "src", "dst").agg(
        (F.sum(w * F.col("weight")) / F.lit(float(total))).alias("weight"))
    return out.filter(F.col("weight") >= threshold)


def edge_ablation(edges: DataFrame, weights: dict[str, float], subsets: dict[str, Sequence[str]],
                  threshold: float = 0.05) -> DataFrame:
    """`combine_edges` for several subsets of edge types, from one grouping, or none for layered edges."""
    by_type = {t: F.sum(F.when(F.col("edge_type") == t, F.col("weight")).otherwise(0.0)).alias(f"_{t}") for t in weights}
    have = {t: F.max((F.col("edge_type") == t).cast("int")).alias(f"_has_{t}") for t in weights}
    if "edge_type" not in edges.columns and tiles_of(edges) is not None:
        return _ablation_of_tiles(edges, weights, subsets, threshold)
    if "edge_type" in edges.columns:
        g = edges.groupBy(*SCOPE, "src", "dst").agg(*by_type.values(), *have.values())
    else:
        held = {t: F.col(t) if t in edges.columns else F.lit(None).cast("double") for t in weights}
        g = edges.select(*SCOPE, "src", "dst", *[F.coalesce(c, F.lit(0.0)).alias(f"_{t}") for t, c in held.items()],
                         *[c.isNotNull().cast("int").alias(f"_has_{t}") for t, c in held.items()])
    variants = []
    for name, types in subsets.items():
        total = sum(weights[t] for t in types)
        value = sum((F.col(f"_{t}") * F.lit(float(weights[t])) for t in types), F.lit(0.0)) / F.lit(float(total))
        present = F.greatest(*[F.col(f"_has_{t}") for t in types], F.lit(0))
        variants.append(F.struct(F.lit(name).alias("variant"), F.when(present == 1, value).alias("weight")))
    out = g.select(*SCOPE, "src", "dst", F.explode(F.array(*variants)).alias("v")).select(*SCOPE, "src", "dst", "v.*")
    return out.filter(F.col("weight") >= threshold)


def _ablation_of_tiles(edges: DataFrame, weights: dict[str, float], subsets: dict[str, Sequence[str]], threshold: float) -> DataFrame:
    tiles, held = tiles_of(edges), set(_types(edges))
    names = [f"_c{k}" for k in range(len(tiles.kinds))]

    def finish(made: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        for tile in made:
            for name, types in subsets.items():
                have = [t for t in types if t in held]
                if not have:
                    continue
                value = sum((_unless_null(tile, t) * float(weights[t]) for t in have), 0.0) / float(sum(weights[t] for t in types))
                there = reduce(np.logical_or, [~np.isnan(tile.values[t]) for t in have])
                for some in tile.having({"weight": value}).kept(there & (value >= threshold)).slices():
                    yield some.batch(names, {"variant": pa.repeat(name, len(some.i)), **_columns("weight")(some)})

    return tiles.named(tiles.rows(finish, tiles.schema("variant string, weight double")))


def _from_tiles(tiles, others: Sequence[DataFrame]) -> DataFrame:
    """Weighted edges of `tiles`, and those of `others`."""
    made = tiles.frame("weight double", _columns("weight"))
    out = reduce(DataFrame.unionByName, [made, *others])
    out._tiles, out._others = tiles, tuple(others)
    return out


def subgraph(edges: DataFrame, nodes: DataFrame, node: str = "tc_key") -> DataFrame:
    """Edges with both ends in `nodes`, in both directions; self-loops if there are none."""
    n = materialize(nodes.select(*SCOPE, node).distinct(), "ends")  # stored, its size is known: edges stay where they are if it is small
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    tiles = tiles_of(edges, others=True)
    rows = [edges] if tiles is None or tiles.both else others_of(edges)
    kept = [e.join(n.withColumnRenamed(node, "src"), [*SCOPE, "src"], "left_semi").join(
        n.withColumnRenamed(node, "dst"), [*SCOPE, "dst"], "left_semi").select(*SCOPE, "src", "dst", "weight") for e in rows]
    turned = [e.select(*SCOPE, both, "weight").select(*SCOPE, "e.src", "e.dst", "weight") for e in kept]
    found = [e.select(*SCOPE) for e in kept]
    if tiles is not None and not tiles.both:
        inside = f"inside_{len(tiles.values)}"
        tiles = tiles.with_values(n.withColumnRenamed(node, "node").withColumn("_in", F.lit(1.0)), [*SCOPE, "node"], ["_in"], [inside])
        tiles = tiles.then(lambda tile: tile.kept(~(np.isnan(tile.left.values[inside][tile.i]) | np.isnan(tile.right.values[inside][tile.j]))))
        found.append(_scopes(tiles))
    else:
        tiles = None
    loops = n.join(reduce(DataFrame.unionByName, found).distinct(), SCOPE, "left_anti").select(
        *SCOPE, F.col(node).alias("src"), F.col(node).alias("dst"), F.lit(1.0).alias("weight"))
    if tiles is None:
        return turned[0].unionByName(loops)
    return _from_tiles(tiles.in_both_directions(), [*turned, loops])


def _scopes(tiles) -> DataFrame:
    """The projects that have a pair. Two blocks are done with when all of theirs are found."""
    def finish(made: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for tile in made:
            at, _ = tile.by_scope()
            new = np.array([x for x in at if tile.left.scope[x] not in seen], np.int64)
            seen.update(tile.left.scope[new].tolist())
            if len(new):
                yield _sums(tile, new, {})
            if len(seen) == tile.left.scope[-1] + 1:
                return

    return tiles.rows(finish, _of_scope(tiles)[:-2])


def graph_stats(edges: DataFrame, nodes: DataFrame, node: str = "tc_key") -> DataFrame:
    """Nodes, edges, density, mean degree over all and over connected nodes, weights."""
    nn = nodes.select(*SCOPE, node).distinct().groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_nodes"))
    tiles = tiles_of(edges)
    if tiles is not None and not tiles.both:
        ends, e = _stats_of_tiles(tiles)
    else:
        ends = edges.select(*SCOPE, F.explode(F.array("src", "dst")).alias("v")).distinct()
        e = edges.groupBy(*SCOPE).agg(
            F.count(F.lit(1)).alias("n_edges"), F.min("weight").alias("min_weight"), F.avg("weight").alias("avg_weight"),
            F.max("weight").alias("max_weight"))
    ends = ends.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_connected"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    return nn.join(e, SCOPE).join(ends, SCOPE).withColumns({
        "density": m / (n * (n - 1) / 2.0), "avg_degree": 2.0 * m / n, "avg_degree_connected": 2.0 * m / F.col("n_connected")})


def _stats_of_tiles(tiles) -> tuple[DataFrame, DataFrame]:
    """The nodes that have an edge, and number and weights of the edges of each project: sums of tiles, and the nodes of two
    blocks, come as rows."""
    def finish(made: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        ends = None
        for tile in made:
            if ends is None:
                left, right = tile.left, tile.right
                ends = [(left, np.zeros(left.size, bool)), (right, np.zeros(right.size, bool))]
            ends[0][1][tile.i] = ends[1][1][tile.j] = True
            (at, start), w = tile.by_scope(), tile.values["weight"]
            yield _sums(tile, at, {
                "node": pa.nulls(len(at), left.columns[-1].type), "n_edges": np.diff(np.append(start, len(w))), "min_weight": np.minimum.reduceat(w, start),
                "sum_weight": np.add.reduceat(w, start), "max_weight": np.maximum.reduceat(w, start)})
        for block, there in ends or ():
            at = pa.array(np.flatnonzero(there))
            yield pa.RecordBatch.from_pydict(
                {c: v.take(at) for c, v in zip([*SCOPE, "node"], block.columns)} | {c: pa.nulls(len(at), t) for c, t in [
                    ("n_edges", pa.int64()), *[(f"{c}_weight", pa.float64()) for c in ("min", "sum", "max")]]})

    parts = tiles.rows(finish, f"{_of_scope(tiles)}node {tiles.kinds[-1]}, n_edges bigint, min_weight double, sum_weight double, max_weight double")
    parts = materialize(parts.groupBy(*SCOPE, "node").agg(
        F.sum("n_edges").alias("n_edges"), F.min("min_weight").alias("min_weight"), F.sum("sum_weight").alias("sum_weight"),
        F.max("max_weight").alias("max_weight")), "stats")
    return parts.filter("n_edges is null").select(*SCOPE, "node"), parts.filter("n_edges is not null").select(
        *SCOPE, "n_edges", "min_weight", (F.col("sum_weight") / F.col("n_edges")).alias("avg_weight"), "max_weight")


def edge_type_counts(edges: DataFrame) -> DataFrame:
    """Edges of each type, from typed or layered edges."""
    if "edge_type" not in edges.columns:
        types = _types(edges)
        tiles = tiles_of(edges)
        if tiles is None:
            counts = edges.groupBy(*SCOPE).agg(*[F.count(t).alias(t) for t in types])
        else:
            def finish(made: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
                for tile in made:
                    at, start = tile.by_scope()
                    yield _sums(tile, at, {t: np.add.reduceat((~np.isnan(tile.values[t])).astype(np.int64), start) for t in types})

            counts = tiles.rows(finish, _of_scope(tiles) + ", ".join(f"{t} bigint" for t in types)).groupBy(*SCOPE).agg(*[F.sum(t).alias(t) for t in types])
        each = F.explode(F.array(*[F.struct(F.lit(t).alias("edge_type"), F.col(t).alias("n_edges")) for t in types])).alias("c")
        return counts.select(*SCOPE, each).select(*SCOPE, "c.*").filter("n_edges > 0")
    return edges.groupBy(*SCOPE, "edge_type").agg(F.count(F.lit(1)).alias("n_edges"))


def propagate(features: DataFrame, edges: DataFrame, columns: Sequence[str], node: str = "tc_key") -> DataFrame:
    """Row-normalised neighbour mean. `edges` hold both directions."""
    if tiles_of(edges, others=True) is not None:
        return _propagated_in_tiles(features, edges, columns, node)
    held = materialize(features.select(*SCOPE, F.col(node).alias("dst"), *columns), "features")  # its size is known: edges stay where they are if it is small
    j = edges.join(held, [*SCOPE, "dst"])
    total = F.sum("weight") + F.lit(1e-6)
    return j.groupBy(*SCOPE, F.col("src").alias(node)).agg(
        *[(F.sum(F.col("weight") * F.col(c)) / total).alias(c) for c in columns])


def _propagated_in_tiles(features: DataFrame, edges: DataFrame, columns: Sequence[str], node: str) -> DataFrame:
    """Sums over the neighbours in the other block, made where the edges are; only they are rows."""
    tiles, each = tiles_of(edges, others=True), range(len(columns))
    x = [F.col(c).cast("double") for c in columns]
    # a node's rows together: their number, and for each column sum and number of those that are not null
    held = materialize(features.groupBy(*SCOPE, F.col(node).alias("node")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"_s{k}") for k, c in enumerate(x)],
        *[F.count(c).alias(f"_m{k}") for k, c in enumerate(x)]), "features")
    fields = ["_n", *[f"_s{k}" for k in each], *[f"_m{k}" for k in each]]
    at = {c: f"{c}_{len(tiles.values)}" for c in fields}
    tiles = tiles.with_values(held, [*SCOPE, "node"], fields, [at[c] for c in fields])
    both = tiles.both

    def finish(made: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        total = None
        for tile in made:
            if total is None:
                left, right = tile.left, tile.right
                # (nodes, their neighbours' block, sums by column): either way only if edges go both ways
                ways = [(left, right, True), (right, left, False)][:1 + both]
                known = [~np.isnan(b.values[at["_n"]]) for _, b, _ in ways]
                theirs = [{c: np.where(k, b.values[at[c]], 0.0) for c in fields} for (_, b, _), k in zip(ways, known)]
                # as many values as rows: one count is enough
                full = [all((v[f"_m{k}"] == v["_n"]).all() for k in each) for v in theirs]
                total = [{c: np.zeros(a.size) for c in ("_w", *fields)} for a, _, _ in ways]
            w = tile.values["weight"]
            for (a, _, forth), v, own, whole in zip(ways, theirs, total, full):
                mine, other = (tile.i, tile.j) if forth else (tile.j, tile.i)
                add = lambda c, value: np.add(own[c], np.bincount(mine, value, a.size), out=own[c])
                n = v["_n"][other]
                add("_n", n)
                add("_w", w * n)
                for k in each:
                    add(f"_s{k}", w * v[f"_s{k}"][other])
                    if not whole:
                        add(f"_m{k}", v[f"_m{k}"][other])
        for (a, _, _), own, whole in zip(ways, total, full) if total else ():
            there = np.flatnonzero(own["_n"])
            if whole:
                own |= {f"_m{k}": own["_n"] for k in each}
            yield pa.RecordBatch.from_pydict({c: v.take(pa.array(there)) for c, v in zip([*SCOPE, "node"], a.columns)} | {c: pa.array(own[c][there]) for c in ("_w", *fields[1:])})

    sums = ["_w", *fields[1:]]
    parts = [tiles.rows(finish, f"{_of_scope(tiles)}node {tiles.kinds[-1]}, " + ", ".join(f"{c} double" for c in sums))]
    for more in others_of(edges):
        met = more.join(held.withColumnRenamed("node", "dst"), [*SCOPE, "dst"])
        parts.append(met.select(*SCOPE, F.col("src").alias("node"), (F.col("weight") * F.col("_n")).alias("_w"), *[
            (F.col("weight") * F.col(f"_s{k}")).alias(f"_s{k}") for k in each], *[F.col(f"_m{k}").cast("double").alias(f"_m{k}") for k in each]))
    total = F.sum("_w") + F.lit(1e-6)
    return reduce(DataFrame.unionByName, parts).groupBy(*SCOPE, F.col("node").alias(node)).agg(
        *[F.when(F.sum(f"_m{k}") > 0, F.sum(f"_s{k}") / total).alias(c) for k, c in enumerate(columns)])


def numbered_nodes(nodes: DataFrame, node: str = "tc_key") -> DataFrame:
    return number_rows(nodes.select(*SCOPE, node).distinct(), SCOPE, [F.col(node)], "_no")


def random_pairs(nodes: DataFrame, n: int, seed: int, node: str = "tc_key") -> DataFrame:
    """n hash-drawn node pairs per project. Draws look nodes up by number."""
    no = numbered_nodes(nodes, node)
    size = no.groupBy(*SCOPE).agg(F.max("_no").alias("_size"))
    draws = size.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(int(n) - 1).cast("bigint"))))
    at = lambda side: F.pmod(hash_int(F.col("draw"), side, seed), F.col("_size")) + 1
    draws = draws.select(*SCOPE, "draw", at("a").alias("_a"), at("b").alias("_b")).filter("_a <> _b")
    a = no.select(*SCOPE, F.col("_no").alias("_a"), F.col(node).alias("_na"))
    b = no.select(*SCOPE, F.col("_no").alias("_b"), F.col(node).alias("_nb"))
    return draws.join(a, [*SCOPE, "_a"]).join(b, [*SCOPE, "_b"]).select(
        *SCOPE, "draw", F.least("_na", "_nb").alias("src"), F.greatest("_na", "_nb").alias("dst"))


def add_random_edges(edges: DataFrame, nodes: DataFrame, n: int = 5, seed: int = 42, node: str = "tc_key") -> DataFrame:
    """The graph with up to n extra edges of weight 1; drawn edges replace existing ones."""
    new = materialize(random_pairs(nodes, n, seed, node).select(*SCOPE, "src", "dst").distinct().withColumn("weight", F.lit(1.0)), "drawn")
    tiles = tiles_of(edges, others=True)
    rows = [edges] if tiles is None or tiles.both else others_of(edges)
    old = [e.select(*SCOPE, "src", "dst", "weight").join(new, [*SCOPE, "src", "dst"], "left_anti") for e in rows]
    if tiles is None or tiles.both:
        return old[0].unionByName(new)
    return _from_tiles(tiles.without(new), [*old, new])


def perturb_features(df: DataFrame, columns: Sequence[str], key: Sequence[str], alpha: float = 0.1, seed: int = 42) -> DataFrame:
    """x + alpha * |x| * u with u in [-1, 1)."""
    u = lambda c: uniform(*[F.col(k) for k in key], c, seed) * 2.0 - 1.0
    return df.withColumns({c: F.col(c) + F.lit(float(alpha)) * F.abs(F.col(c)) * u(c) for c in columns})


def orphans(df: DataFrame, edges: DataFrame, score: str = "score", node: str = "tc_key") -> DataFrame:
    """Tests outside the graph get probability 0.5 and index -1, others their index."""
    ends = edges.select(*SCOPE, F.explode(F.array("src", "dst")).alias(node)).distinct()
    index = numbered_nodes(materialize(ends, "ends"), node).select(*SCOPE, node, (F.col("_no") - 1).alias("node_index"))
    j = df.join(index, [*SCOPE, node], "left")
    return j.withColumns({
        score: F.when(F.col("node_index").isNull(), 0.5).otherwise(F.col(score)),
        "node_index": F.coalesce("node_index", F.lit(-1)),
    })


# ---- commits --------------------------------------------------------------

def frequent_commits(df: DataFrame, max_commits: int | None = None) -> DataFrame:
    """Commits with their frequency; with `max_commits`, only the most frequent (ties by text)."""
    c = df.select(*SCOPE, F.explode("commits").alias("commit")).filter(F.trim("commit") != "")
    freq = c.groupBy(*SCOPE, F.trim("commit").alias("commit")).agg(F.count(F.lit(1)).alias("freq"))
    if max_commits is None:
        return freq
    return number_rows(freq, SCOPE, [F.col("freq").desc(), F.col("commit")], "_r").filter(
        F.col("_r") <= max_commits).drop("_r")


def _commit_builds(df: DataFrame, commits: DataFrame) -> DataFrame:
    rows = df.select(*SCOPE, "build_idx", F.explode("commits").alias("commit")).withColumn("commit", F.trim("commit"))
    return rows.join(commits.select(*SCOPE, "commit"), [*SCOPE, "commit"], "left_semi").distinct()


def commit_dag(df: DataFrame, max_commits: int | None = None, window: int = 10, min_weight: float = 0.1,
               max_edges: int | None = None, block: int = BLOCK) -> DataFrame:
    """Edges from commits of the previous `window` builds to a commit first seen now, and
    both ways between commits of one build.

    The look-back is an equi-join on each of the `window` clock positions. Where the cap
    on edges per commit bites, nearer builds come first, then the commit text.
    """
    cb = materialize(_commit_builds(df, frequent_commits(df, max_commits)))
    first = cb.groupBy(*SCOPE, "commit").agg(F.min("build_idx").alias("first"))
    reach = min(window, int(1.0 / min_weight - 1.0 + 1e-9)) if min_weight > 0 else window
    back = first.withColumn("distance", F.explode(F.sequence(F.lit(1), F.lit(max(reach, 1))))).select(
        *SCOPE, F.col("commit").alias("dst"), (F.col("first") - F.col("distance")).alias("build_idx"), "distance")
    temporal = back.join(cb.withColumnRenamed("commit", "src"), [*SCOPE, "build_idx"]).select(
        *SCOPE, "src", "dst", "build_idx", F.lit("temporal").alias("kind"), (1.0 / (1.0 + F.col("distance"))).alias("weight"))
    temporal = temporal.filter(F.col("weight") >= min_weight)
    if max_edges is not None:
        w = Window.partitionBy(*SCOPE, "dst").orderBy(F.desc("build_idx"), "src")
        temporal = temporal.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_edges).drop("_r")
    # commits of a build in blocks: a task joins a block with a block, however large the build
    sizes = cb.groupBy(*SCOPE, "build_idx").agg(F.count(F.lit(1)).alias("_n"))
    dealt = cb.join(sizes, [*SCOPE, "build_idx"]).withColumn("_parts", F.ceil(F.col("_n") / block).cast("int"))
    own, every = F.pmod(F.xxhash64("commit"), F.col("_parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = dealt.select(*SCOPE, "build_idx", F.col("commit").alias("src"), own.alias("_p"), every.alias("_q"))
    right = dealt.select(*SCOPE, "build_idx", F.col("commit").alias("dst"), every.alias("_p"), own.alias("_q"))
    siblings = left.join(right, [*SCOPE, "build_idx", "_p", "_q"]).filter("src <> dst").select(
        *SCOPE, "src", "dst", "build_idx", F.lit("sibling").alias("kind"), F.lit(0.8).alias("weight"))
    return temporal.unionByName(siblings)


def commit_path_lengths(edges: DataFrame) -> DataFrame:
    return edges.withColumns({
        "path_length": 1.0 / (F.col("weight") + F.lit(1e-6)), "merge": (F.col("weight") <= 0.7).cast("int")})


def test_to_commits(df: DataFrame, commits: DataFrame) -> DataFrame:
    """The known commits of each test; at most as many as there are known commits."""
    rows = df.select(*SCOPE, "tc_key", F.explode("commits").alias("commit")).withColumn("commit", F.trim("commit"))
    known = rows.join(commits.select(*SCOPE, "commit"), [*SCOPE, "commit"], "left_semi")
    return known.distinct().groupBy(*SCOPE, "tc_key").agg(F.array_sort(F.collect_set("commit")).alias("commits"))
