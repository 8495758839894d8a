"""Counting what two nodes share, without emitting all pairs of every bucket.

`members` has one distinct row per (scope, bucket, node): a failing test of a build, a
test touched by a commit, a test in a component. Three ways give the same counts; the
numbers of pair rows that each would make are known before any is made, and the smallest
is taken.

`prefix`. A node that must share `need` of its n buckets with another one shares one among
any n - need + 1 of them. Nodes order their buckets from rare to common, so only this
prefix is joined, and large buckets fall out of it. A pair's common prefix buckets, plus
the fewer of the buckets that either node has behind the last of them, bound what it can
share: pairs that cannot reach `need` are dropped, pairs without anything behind it are
exact, and the rest are counted from the buckets of the smaller node.

`product`. Where many pairs share something, nodes are cut into blocks, packed with all their
buckets and names. Two blocks meet in one task, which counts tile by tile, by products of 0/1
matrices or by their common buckets, and keeps what is enough: each pair is made once, whole
and named, and never shuffled. Several kinds of buckets can be counted at once (`pair_layers`).
What is made of the pairs is made where they are (`Tiles`): weights and thresholds, and the sums
of what only needs sums, so that a pair leaves its task only if it is a result.

`join`. All buckets are joined with themselves, the cheapest way for few pairs.

Joined buckets of more than `hot` rows are cut into blocks, so no task sees more than a
block by a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.operators.scale import number_rows, running_sums
from tallyrank.session import materialize, scratch_of

HOT_BUCKET = 2000
BLOCK = 500
#: Buckets of one stretch of the product.
STRETCH = 4096
#: Pair rows below which the plain join is taken without weighing the others.
FEW = 10_000_000
#: Blocks of a product, more only where one would have too many rows or nodes.
GRID = 16
BLOCK_ROWS = 4_000_000
BLOCK_NODES = 50_000
#: Pairs of blocks beyond which a partition has several.
MOST_TASKS = 4096
#: Cells of a matrix product that cost as much as one pair row made from a common bucket.
DENSE = 400
#: Pair rows held at once inside a task, and rows of a batch that it returns.
AT_ONCE, OUT_ROWS = 4_000_000, 100_000
#: Pairs of nodes compared in blocks that cost as much as one joined and shuffled pair row.
CHEAP = 32


def partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _joined(rows: DataFrame, hot: int, block: int, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs a < b inside each bucket; columns of `carry` come once for either node."""
    rows = rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1"), "bucket")
    parts = F.when(F.col("_size") > hot, F.ceil(F.col("_size") / block)).otherwise(1).cast("int")
    mine = F.pmod(F.col("id"), parts)
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    left = rows.select("bucket", F.col("id").alias("a"), mine.alias("_i"), every.alias("_j"), *[F.col(c).alias(f"{c}_a") for c in carry])
    right = rows.select(F.col("bucket").alias("_bucket"), F.col("id").alias("b"), every.alias("_ri"), mine.alias("_rj"),
                        *[F.col(c).alias(f"{c}_b") for c in carry])
    # few input bytes make many pairs, so the partition count is set, not coalesced by size
    n = partitions(rows)
    left, right = left.repartition(n, "bucket", "_i", "_j"), right.repartition(n, "_bucket", "_ri", "_rj")
    same = (F.col("bucket") == F.col("_bucket")) & (F.col("_i") == F.col("_ri")) & (F.col("_j") == F.col("_rj"))
    return left.join(right, same & (F.col("a") < F.col("b"))).select("a", "b", *[f"{c}_{s}" for c in carry for s in "ab"])


def _by_join(rows: DataFrame, hot: int, block: int) -> DataFrame:
    return _joined(rows, hot, block).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def prefix_rows(rows: DataFrame) -> DataFrame:
    """Rows of each node's prefix, with `pos`, the bucket's place among the node's, rare ones first."""
    placed = number_rows(rows, ["id"], [F.col("bucket")], "pos")
    return placed.filter(F.col("pos") <= F.col("n") - F.col("need") + 1)


def _by_prefix(rows: DataFrame, prefix: DataFrame, nodes: DataFrame, hot: int, block: int) -> DataFrame:
    found = _joined(prefix.select("id", "bucket", "pos"), hot, block, ["pos"]).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("seen"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"))
    of = lambda s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("need").alias(f"need_{s}"))
    behind = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    found = found.join(of("a"), "a").join(of("b"), "b").withColumn("behind", behind)
    found = materialize(found.filter(F.col("seen") + F.col("behind") >= F.greatest("need_a", "need_b")).select(
        "a", "b", "seen", "behind", "n_a", "n_b"), "candidates")
    smaller = F.col("n_a") <= F.col("n_b")
    open_ = found.filter("behind > 0").select(
        "a", "b", F.when(smaller, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(smaller, F.col("b")).otherwise(F.col("a")).alias("_other"))
    theirs = rows.select(F.col("id").alias("_other"), "bucket")
    counted = open_.join(rows.select("id", "bucket"), "id").join(theirs, ["_other", "bucket"]).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("shared"))
    return found.filter("behind = 0").select("a", "b", F.col("seen").alias("shared")).unionByName(counted)


def _by_product(rows: DataFrame, nodes: DataFrame, scope: Sequence[str], block: int, stretch: int) -> DataFrame:
    one = nodes.select(*scope, "node", "id", F.array("n").alias("n"), F.array("need").alias("need"))
    pairs = block_pairs(one, rows.select("id", F.lit(0).alias("layer"), "bucket"), scope, 1, block, stretch)
    named = pairs.select(*scope, "src", "dst", F.col("shared_0").alias("shared"), F.col("n_src_0").alias("n_src"), F.col("n_dst_0").alias("n_dst"))
    named._tiles = tiles_of(pairs)
    return named


def _blocked(nodes: DataFrame, scope: Sequence[str], block: int) -> DataFrame:
    """`nodes` with the number `i` of a block: a run of ids with about the same number of rows, and
    `lo` and `hi`, the first and last block of the node's scope."""
    nodes = nodes.withColumn("_w", F.greatest(F.aggregate("n", F.lit(0).cast("bigint"), lambda x, y: x + y), F.lit(1)))
    total, count = nodes.agg(F.coalesce(F.sum("_w"), F.lit(0)), F.count(F.lit(1))).first()
    grid = max(1, min(max(GRID, -(-total // BLOCK_ROWS), -(-count // BLOCK_NODES)), -(-count // block)))
    upto = running_sums(nodes, [], [F.col("id")], {"_upto": "_w"})
    placed = upto.withColumn("i", F.floor((F.col("_upto") - F.col("_w")) / F.lit(max(1, -(-total // grid)))).cast("int"))
    placed = materialize(placed.drop("_upto", "_w"), "placed")
    reach = placed.groupBy(*scope).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    return placed.join(reach, list(scope)) if scope else placed.crossJoin(F.broadcast(reach))


def block_pairs(nodes: DataFrame, rows: DataFrame, scope: Sequence[str], layers: int, block: int = BLOCK, stretch: int = STRETCH,
                given: DataFrame | None = None) -> DataFrame:
    """Each pair of nodes that share enough buckets in some layer, as one row: scope, src, dst and for each
    layer shared_<l>, n_src_<l>, n_dst_<l>, null where they share fewer than either needs.

    `nodes` has scope, node, id (numbered by scope and node), and n and need, arrays with a value for each
    layer; `rows` has id, layer, bucket, the buckets of all layers numbered apart. `given` (a, b, given, ids
    with a < b) has counts made elsewhere, which come in column `given`.

    A block travels packed, once to every block of its scope, and a task compares two blocks tile by tile:
    no pair row is ever shuffled, and what is grows with the rows as long as the number of blocks is GRID.
    """
    scope, node = list(scope), nodes.schema["node"].dataType.simpleString()
    kinds = [*[nodes.schema[c].dataType.simpleString() for c in scope], node]
    held = _blocked(nodes, scope, block).select(
        "i", "lo", "hi", "id", "n", "need", *[F.col(c).alias(f"_c{k}") for k, c in enumerate([*scope, "node"])])
    names = [f"_c{k}" for k in range(len(kinds))]

    def pack(key, mine, theirs):
        mine = mine.sort_by("id").combine_chunks()
        first = mine.column("id")[0].as_py() if len(mine) else 0
        row, layer, bucket = (theirs.column(c).to_numpy() for c in ("id", "layer", "bucket"))
        off, held = [], []
        for x in range(layers):
            here = layer == x
            r, b = row[here] - first, bucket[here]
            order = np.lexsort((b, r))
            off.append(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(mine)))]).astype(np.int64).tobytes())
            b = b[order]
            held.append((b.astype(np.uint32) if not len(b) or b.max() < 1 << 32 else b).tobytes())
        matrix = lambda c: np.array(mine.column(c).to_pylist(), np.int64).reshape(len(mine), layers).T.tobytes()
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine.column(c).combine_chunks())
        if not len(mine):
            return pa.table({c: pa.array([], t) for c, t in [
                ("i", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("first", pa.int64()), ("off", pa.list_(pa.binary())), ("held", pa.list_(pa.binary())),
                ("n", pa.binary()), ("need", pa.binary()), *[(c, pa.list_(mine.schema.field(c).type)) for c in names]]})
        return pa.table({
            "i": pa.array([key[0].as_py()], pa.int32()), "lo": pa.array([min(mine.column("lo").to_pylist())], pa.int32()),
            "hi": pa.array([max(mine.column("hi").to_pylist())], pa.int32()), "first": pa.array([first], pa.int64()),
            "off": pa.array([off], pa.list_(pa.binary())), "held": pa.array([held], pa.list_(pa.binary())),
            "n": pa.array([matrix("n")], pa.binary()), "need": pa.array([matrix("need")], pa.binary()), **{c: whole(c) for c in names}})

    packed_schema = "i int, lo int, hi int, first bigint, off array<binary>, held array<binary>, n binary, need binary, " + ", ".join(
        f"{c} array<{t}>" for c, t in zip(names, kinds))
    sites = held.select(F.col("id").alias("id"), F.col("i").alias("_i"))  # fresh names: both sides come from one table
    placed_rows = rows.join(sites, "id").select(F.col("_i").alias("i"), F.col("id").alias("id"), F.col("layer").cast("int").alias("layer"), F.col("bucket").cast("bigint").alias("bucket"))
    packed = materialize(held.groupBy("i").cogroup(placed_rows.groupBy("i")).applyInArrow(pack, packed_schema), "blocks")
    sited = None
    if given is not None:
        at = held.select("id", "i")
        sited = given.join(at.select(F.col("id").alias("a"), "i"), "a").join(at.select(F.col("id").alias("b"), F.col("i").alias("j")), "b").select(
            "i", "j", *[F.col(c).cast("bigint").alias(c) for c in ("a", "b", "given")])
    tasks = packed.agg(F.sum(F.col("hi") - F.col("i") + 1)).first()[0] or 0
    tiles = Tiles(packed, held, sited, scope, kinds, layers, block, stretch, max(1, min(tasks, MOST_TASKS)))
    fields = [f"{c}_{x} bigint" for x in range(layers) for c in ("shared", "n_src", "n_dst")] + (["given bigint"] if given is not None else [])
    return tiles.frame(", ".join(fields), _counted)


class Tiles:
    """Pairs that are made when they are asked for: the packed blocks, and what becomes of each tile.

    `rows` runs `finish` over the tiles of two blocks, in one task; `then` adds a step from a tile to a
    tile; `frame` gives the pairs as rows. A DataFrame of pairs carries its tiles (`tiles_of`), so that an
    operator which keeps some pairs or sums them up does so in that task, where no pair costs a row.
    """

    def __init__(self, packed: DataFrame, held: DataFrame, sited: DataFrame | None, scope: Sequence[str], kinds: Sequence[str], layers: int,
                 block: int, stretch: int, tasks: int, values: tuple = (), dropped: DataFrame | None = None, steps: tuple = (), both: bool = False):
        self.packed, self.held, self.sited, self.scope, self.kinds, self.layers = packed, held, sited, list(scope), list(kinds), layers
        self.block, self.stretch, self.tasks, self.values, self.dropped, self.steps, self.both = block, stretch, tasks, values, dropped, steps, both

    def _with(self, **changed) -> Tiles:
        return Tiles(**vars(self) | changed)

    def then(self, *steps: Callable[[Tile], Tile]) -> Tiles:
        return self._with(steps=(*self.steps, *steps))

    def in_both_directions(self) -> Tiles:
        return self._with(both=True)

    def with_values(self, table: DataFrame, by: Sequence[str], columns: Sequence[str], names: Sequence[str]) -> Tiles:
        """`columns` of `table`, which has one row for a scope or for a scope and node (`by`), as `names` in
        `Block.values`, NaN where there is none."""
        at = {c: f"_c{k}" for k, c in enumerate([*self.scope, "node"])}
        own = self.held.select("i", "id", *[F.col(at[c]).alias(c) for c in by])
        theirs = table.select(*by, *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
        own = own.join(theirs, list(by), "left") if by else own.crossJoin(F.broadcast(theirs))
        listed = F.array_sort(F.collect_list(F.struct("id", *[F.coalesce(n, F.lit(float("nan"))).alias(n) for n in names])))
        held = own.groupBy("i").agg(listed.alias("_v")).select("i", *[F.col(f"_v.{n}").alias(n) for n in names])
        return self._with(values=(*self.values, (materialize(held, "values"), tuple(names))))

    def without(self, pairs: DataFrame) -> Tiles:
        """Leaves the pairs (scope, src, dst) out, of src < dst."""
        at = lambda end, a, i: self.held.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(self.scope)], F.col(f"_c{len(self.scope)}").alias(end),
                                                F.col("id").alias(a), F.col("i").alias(i))
        out = pairs.select(*self.scope, "src", "dst").join(at("src", "a", "i"), [*self.scope, "src"]).join(at("dst", "b", "j"), [*self.scope, "dst"])
        out = materialize(out.select("i", "j", *[F.col(c).cast("bigint").alias(c) for c in ("a", "b")], F.lit(0).cast("bigint").alias("given")), "dropped")
        return self._with(dropped=out if self.dropped is None else materialize(self.dropped.unionByName(out), "dropped"))

    def frame(self, fields: str, columns: Callable[[Tile], dict]) -> DataFrame:
        """Every pair as a row: scope, src, dst and what `columns` makes of a tile, declared by `fields`."""
        names, both = [f"_c{k}" for k in range(len(self.kinds))], self.both

        def finish(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
            for tile in tiles:
                for some in tile.slices():
                    yield some.batch(names, columns(some))
                    if both:
                        yield some.batch(names, columns(some), True)

        out = self.named(self.rows(finish, self.schema(fields)))
        out._tiles = self
        return out

    def schema(self, fields: str) -> str:
        return ", ".join([*[f"_c{k} {t}" for k, t in enumerate(self.kinds)], f"_dst {self.kinds[-1]}", fields])

    def named(self, out: DataFrame) -> DataFrame:
        """`out` of `schema` under the names of its columns."""
        back = {f"_c{k}": c for k, c in enumerate([*self.scope, "src"])} | {"_dst": "dst"}
        return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns])

    def rows(self, finish: Callable[[Iterator[Tile]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What `finish` makes of the tiles of each two blocks."""
        names, layers, block, stretch = [f"_c{k}" for k in range(len(self.kinds))], self.layers, self.block, self.stretch
        steps, with_given, more = self.steps, self.sited is not None, tuple(n for _, some in self.values for n in some)
        packed = self.packed
        for table, _ in self.values:
            packed = packed.join(table, "i")
        body = ["first", "off", "held", "n", "need", *names, *more]
        nothing = F.lit(None).cast("binary").alias("pairs")
        sent = packed.select("i", F.explode(F.sequence("i", "hi")).alias("j"), F.lit(0).alias("side"), *body, nothing).unionByName(
            packed.filter("lo < i").select(F.explode(F.sequence("lo", F.col("i") - 1)).alias("i"), F.col("i").alias("j"), F.lit(1).alias("side"), *body, nothing))
        for side, sited in ((2, self.sited), (3, self.dropped)):
            if sited is not None:
                pairs = sited.groupBy("i", "j").applyInArrow(_pack_pairs, "i int, j int, pairs binary")
                sent = sent.unionByName(pairs.withColumn("side", F.lit(side)), allowMissingColumns=True)
        sent = sent.repartition(self.tasks, "i", "j").sortWithinPartitions("i", "j", "side")

        def tiles(key, have):
            for tile in _compared(key, have, layers, block, stretch, with_given):
                for step in steps:
                    tile = step(tile)
                if len(tile.i):
                    yield tile

        def compare(batches):
            now, have = None, {}
            for batch in batches:
                for k in range(batch.num_rows):
                    key = batch.column("i")[k].as_py(), batch.column("j")[k].as_py()
                    if key != now:
                        if now is not None:
                            yield from finish(tiles(now, have))
                        now, have = key, {}
                    side = batch.column("side")[k].as_py()
                    have[side] = (np.frombuffer(batch.column("pairs")[k].as_py(), np.int64).reshape(3, -1) if side > 1
                                  else _Block(batch, k, names, layers, block, more))
            if now is not None:
                yield from finish(tiles(now, have))

        return sent.mapInArrow(compare, schema)


def tiles_of(df: DataFrame, others: bool = False) -> Tiles | None:
    """The tiles that the rows of `df` come from, if that is how they are made. With `others`, also if there are
    more rows, in `others_of`."""
    return getattr(df, "_tiles", None) if others or not others_of(df) else None


def others_of(df: DataFrame) -> tuple[DataFrame, ...]:
    return getattr(df, "_others", ())


def _pack_pairs(key, table):
    three = np.stack([table.column(c).to_numpy() for c in ("a", "b", "given")]).astype(np.int64)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()), "pairs": pa.array([three.tobytes()], pa.binary())})


class _Block:
    """A packed block: node columns, sizes and needs, and for each layer and tile the rows by bucket."""

    def __init__(self, batch: pa.RecordBatch, k: int, names: Sequence[str], layers: int, tile: int, values: Sequence[str] = ()):
        self.columns = [batch.column(c)[k].values for c in names]
        self.first, self.size = batch.column("first")[k].as_py(), len(self.columns[0])
        self.n, self.need = (np.frombuffer(batch.column(c)[k].as_py(), np.int64).reshape(layers, self.size) for c in ("n", "need"))
        self.most_needed = self.need.max(axis=1, initial=1)
        self.values = {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in values}
        other = np.zeros(self.size, bool)
        for c in self.columns[:-1]:
            other[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, self.size - 1)), True).to_numpy(zero_copy_only=False)
        #: number of the node's scope in the block
        self.scope = np.cumsum(other)
        off, held = batch.column("off")[k].as_py(), batch.column("held")[k].as_py()
        self.tiles = []
        for x in range(layers):
            o = np.frombuffer(off[x], np.int64)
            b = np.frombuffer(held[x], np.uint32 if len(held[x]) == 4 * o[-1] else np.int64).astype(np.int64)
            self.tiles.append([_by_bucket(o[s:min(s + tile, self.size) + 1], b) for s in range(0, self.size, tile)])


def _by_bucket(off: np.ndarray, bucket: np.ndarray) -> tuple:
    """Distinct buckets of a tile, where the rows of each start, and the nodes of the rows, by bucket."""
    row, own = np.repeat(np.arange(len(off) - 1), np.diff(off)), bucket[off[0]:off[-1]]
    order = np.argsort(own, kind="stable")
    distinct, start = np.unique(own[order], return_index=True)
    return distinct, np.append(start, len(own)), row[order]


def _shared(mine: tuple, other: tuple, height: int, width: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells a * width + b of two tiles that share a bucket, and the number of buckets they share."""
    (u, us, ur), (v, vs, vr) = mine, other
    _, iu, iv = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    cu, cv = us[iu + 1] - us[iu], vs[iv + 1] - vs[iv]
    made = int((cu * cv).sum())
    if height * width * len(iu) <= DENSE * made:
        counts = None
        for s in range(0, len(iu), stretch):
            part = slice(s, s + stretch)
            product = _incidence(ur, us[iu[part]], cu[part], height) @ _incidence(vr, vs[iv[part]], cv[part], width).T
            # sums up to 2^24 are exact in four bytes, as the products are
            counts = product if counts is None else counts + (product if len(iu) <= 1 << 24 else product.astype(np.float64))
        if counts is None:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        cell = np.flatnonzero(counts)
        return cell, counts.ravel()[cell].astype(np.int64)
    counts = np.zeros(height * width, np.int64)
    # rows of `mine` in common buckets, each to be met with all rows of the bucket in `other`
    row, times, begin = ur[_spans(us[iu], cu)], np.repeat(cv, cu), np.repeat(vs[iv], cu)
    cuts = np.searchsorted(np.cumsum(times), np.arange(AT_ONCE, made + AT_ONCE, AT_ONCE), side="right")
    for lo, hi in zip([0, *cuts[:-1]], [*cuts[:-1], len(row)]):
        counts += np.bincount(np.repeat(row[lo:hi] * width, times[lo:hi]) + vr[_spans(begin[lo:hi], times[lo:hi])], minlength=height * width)
    cell = np.flatnonzero(counts)
    return cell, counts[cell]


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, … of every span, one after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


class Tile:
    """Pairs of two blocks: numbers `i` and `j` of the nodes in them, ascending by i, for each layer, and for what is
    given, the count, -1 where there is none, and `values` by name, NaN where there is none."""

    def __init__(self, left: _Block, right: _Block, i: np.ndarray, j: np.ndarray, counts: Sequence[np.ndarray], values: dict | None = None):
        self.left, self.right, self.i, self.j, self.counts, self.values = left, right, i, j, counts, values or {}

    def taken(self, some: slice | np.ndarray) -> Tile:
        return Tile(self.left, self.right, self.i[some], self.j[some], [c[some] for c in self.counts], {k: v[some] for k, v in self.values.items()})

    def kept(self, there: np.ndarray) -> Tile:
        return self if there.all() else self.taken(np.flatnonzero(there))

    def slices(self) -> Iterator[Tile]:
        for at in range(0, len(self.i), OUT_ROWS):
            yield self.taken(slice(at, at + OUT_ROWS))

    def having(self, values: dict) -> Tile:
        """The same pairs with other values; the counts are of no more use."""
        return Tile(self.left, self.right, self.i, self.j, [], values)

    def batch(self, names: Sequence[str], columns: dict, turned: bool = False) -> pa.RecordBatch:
        mine, other = pa.array(self.i), pa.array(self.j)
        out = {}
        for c, v in zip(names[:-1], self.left.columns):  # mostly one scope: nothing to pick
            one = len(self.i) and self.left.scope[self.i[0]] == self.left.scope[self.i[-1]]
            out[c] = pa.repeat(v[int(self.i[0])], len(self.i)) if one else v.take(mine)
        ends = self.left.columns[-1].take(mine), self.right.columns[-1].take(other)
        out[names[-1]], out["_dst"] = ends[::-1] if turned else ends
        return pa.RecordBatch.from_pydict(out | columns)

    def by_scope(self) -> tuple[np.ndarray, np.ndarray]:
        """A node of each scope, and where its pairs start."""
        of = self.left.scope[self.i]
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        return self.i[start], start


def _compared(key, have: dict, layers: int, tile: int, stretch: int, with_given: bool) -> Iterator[Tile]:
    """The pairs of two blocks, tile by tile."""
    if 0 not in have or (key[0] != key[1] and 1 not in have):
        return  # a block number that no node has
    left, right = have[0], have[0] if key[0] == key[1] else have[1]
    across = -(-right.size // tile)

    def sited(side):
        a, b, g = have.get(side, np.zeros((3, 0), np.int64))
        a, b = a - left.first, b - right.first
        order = np.lexsort((b // tile, a // tile))
        a, b, g = a[order], b[order], g[order]
        return a, b, g, (a // tile) * across + b // tile

    a, b, g, site = sited(2)
    da, db, _, dsite = sited(3)
    for p, s in enumerate(range(0, left.size, tile)):
        height = min(tile, left.size - s)
        for q, t in enumerate(range(0, right.size, tile)):
            if left is right and q < p:
                continue
            width = min(tile, right.size - t)
            found = []
            for x in range(layers):
                cell, count = _shared(left.tiles[x][p], right.tiles[x][q], height, width, stretch)
                keep = None
                if left.most_needed[x] > 1 or right.most_needed[x] > 1:
                    keep = count >= np.maximum(left.need[x][s + cell // width], right.need[x][t + cell % width])
                if left is right and p == q:
                    upper = cell // width < cell % width
                    keep = upper if keep is None else keep & upper
                found.append((cell, count) if keep is None else (cell[keep], count[keep]))
            if with_given:
                lo, hi = np.searchsorted(site, [p * across + q, p * across + q + 1])
                found.append(((a[lo:hi] - s) * width + b[lo:hi] - t, g[lo:hi]))
            if len(found) == 1:
                cells, counts = found[0][0], [found[0][1]]
            else:
                full = np.full((len(found), height * width), -1)
                for x, (cell, count) in enumerate(found):
                    full[x, cell] = count
                cells = np.flatnonzero((full >= 0).any(axis=0))
                counts = [row[cells] for row in full]
            whole = Tile(left, right, s + cells // width, t + cells % width, counts)
            lo, hi = np.searchsorted(dsite, [p * across + q, p * across + q + 1])
            if hi > lo:
                whole = whole.taken(~np.isin(cells, (da[lo:hi] - s) * width + db[lo:hi] - t))
            yield whole


def _counted(tile: Tile) -> dict:
    """The columns of `block_pairs`."""
    out, layers = {}, len(tile.left.n)
    for x, count in enumerate(tile.counts):
        none = count < 0 if len(tile.counts) > 1 else None
        if x < layers:
            out |= {f"shared_{x}": pa.array(count, mask=none), f"n_src_{x}": pa.array(tile.left.n[x][tile.i], mask=none),
                    f"n_dst_{x}": pa.array(tile.right.n[x][tile.j], mask=none)}
        else:
            out["given"] = pa.array(count, mask=none)
    return out


def _incidence(row: np.ndarray, start: np.ndarray, size: np.ndarray, height: int) -> np.ndarray:
    """0/1 matrix of a tile's nodes by some of its buckets; products up to 2^24 are exact."""
    out = np.zeros((height, len(start)), np.float32)
    out[row[_spans(start, size)], np.repeat(np.arange(len(start)), size)] = 1
    return out


def pair_counts(members: DataFrame, scope: Sequence[str] = ("project",),
                need: Callable[[Column], Column] | None = None,
                hot: int = HOT_BUCKET, block: int = BLOCK, least: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
                way: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """Columns scope, src, dst, shared, n_src, n_dst for every pair that shares at least
    `need(n)` buckets for both of its node sizes n; other pairs may be missing.

    `least` (scope, least) raises the need of whole scopes; given as a function of the members it is
    asked for only where a higher need can save pair rows. `way` fixes one of "join", "prefix" and
    "product". Nodes and buckets are numbered by name and by scope and size first, so the many pair
    rows hold two numbers.
    """
    scope = list(scope)
    of_scope = (F.struct(*scope) if scope else F.lit(0)).alias("scope")
    members = materialize(members.select(*scope, "bucket", "node"), "members")
    sizes = members.groupBy(*scope, "bucket").agg(F.count(F.lit(1)).alias("_size"))
    sizes = number_rows(sizes, [], [*[F.col(c) for c in scope], F.col("_size"), F.col("bucket")], "_no")

    def incidence(raised: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        totals = members.groupBy(*scope, "node").agg(F.count(F.lit(1)).alias("n"))
        wanted = need(F.col("n")) if need else F.lit(1)
        if raised is not None:
            totals = totals.join(raised, scope)
            wanted = F.greatest(wanted, F.col("least"))
        totals = totals.withColumn("need", F.greatest(wanted, F.lit(1)).cast("bigint"))
        nodes = materialize(number_rows(totals, [], [F.col(c) for c in [*scope, "node"]], "id"), "nodes")
        rows = members.join(sizes, [*scope, "bucket"]).join(nodes, [*scope, "node"]).select(
            of_scope, "id", F.col("_no").alias("bucket"), "_size", "n", "need")
        return materialize(rows, "incidence"), nodes

    rows, nodes = incidence(None if callable(least) else least)
    if way is None:
        full = rows.agg(F.sum("_size") / 2).first()[0] or 0
        per_scope = nodes.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
        dense = per_scope.agg(F.sum(F.col("n").cast("double") * F.col("n")) / 2).first()[0] or 0
        if full <= FEW:
            way = "join"
        elif 8 * dense <= full:
            way = "product"
        else:
            if callable(least):
                rows, nodes = incidence(least(members))
            way, prefix = _way(rows, full, dense)
    else:
        prefix = prefix_rows(rows) if way == "prefix" else None
    if way == "prefix":
        counts = _by_prefix(rows, prefix, nodes, hot, block)
    elif way == "product":
        return _by_product(rows, nodes, scope, block, stretch)
    else:
        counts = _by_join(rows.select("id", "bucket"), hot, block)
    left = nodes.select(*scope, F.col("node").alias("src"), F.col("n").alias("n_src"), F.col("need").alias("_need_a"), F.col("id").alias("a"))
    right = nodes.select(F.col("node").alias("dst"), F.col("n").alias("n_dst"), F.col("need").alias("_need_b"), F.col("id").alias("b"))
    out = counts.join(left, "a").join(right, "b").filter(F.col("shared") >= F.greatest("_need_a", "_need_b"))
    return out.select(*scope, "src", "dst", "shared", "n_src", "n_dst")


def pair_layers(layers: Sequence[tuple[DataFrame, Callable[[Column], Column] | None]], given: DataFrame | None = None,
                scope: Sequence[str] = ("project",), block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """`block_pairs` of several (members, need): one row for a pair of nodes, whatever the layers it is in.

    `given` (scope, src, dst, given) are counts made elsewhere, of src < dst."""
    scope = list(scope)
    every = [m.select(F.lit(x).alias("layer"), *scope, "bucket", "node") for x, (m, _) in enumerate(layers)]
    members = materialize(reduce(DataFrame.unionByName, every), "members")
    buckets = number_rows(members.select("layer", *scope, "bucket").distinct(), [], [F.col(c) for c in ["layer", *scope, "bucket"]], "_no")
    counts = members.groupBy(*scope, "node").agg(*[F.sum((F.col("layer") == x).cast("bigint")).alias(f"_n{x}") for x in range(len(layers))])
    if given is not None:
        given = given if scratch_of(given) else materialize(given, "given")
        ends = given.select(*scope, F.explode(F.array("src", "dst")).alias("node")).distinct()
        counts = counts.unionByName(ends, allowMissingColumns=True).groupBy(*scope, "node").agg(
            *[F.coalesce(F.max(f"_n{x}"), F.lit(0)).alias(f"_n{x}") for x in range(len(layers))])
    n = [F.col(f"_n{x}") for x in range(len(layers))]
    need = [F.greatest(f(c) if f else F.lit(1), F.lit(1)).cast("bigint") for c, (_, f) in zip(n, layers)]
    counts = counts.select(*scope, "node", F.array(*n).alias("n"), F.array(*need).alias("need"))
    nodes = materialize(number_rows(counts, [], [F.col(c) for c in [*scope, "node"]], "id"), "nodes")
    rows = members.join(buckets, ["layer", *scope, "bucket"]).join(nodes, [*scope, "node"]).select("id", "layer", F.col("_no").alias("bucket"))
    if given is not None:
        at = lambda end, name: nodes.select(*scope, F.col("node").alias(end), F.col("id").alias(name))
        given = given.join(at("src", "a"), [*scope, "src"]).join(at("dst", "b"), [*scope, "dst"]).select("a", "b", "given")
    return block_pairs(nodes, rows, scope, len(layers), block, stretch, given)


def _way(rows: DataFrame, full: float, dense: float) -> tuple[str, DataFrame | None]:
    """The way with the fewest pair rows, and the prefixes if it is theirs."""
    if rows.agg(F.max("need")).first()[0] > 1:
        prefix = materialize(prefix_rows(rows), "prefixes")
        short = prefix.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")) / 2).first()[0] or 0
        # candidates are joined with buckets once more to be counted
        if 4 * short <= min(full, dense / 4):
            return "prefix", prefix
    return ("product" if dense <= CHEAP * full else "join"), None


def busiest_overlap(members: DataFrame, scope: Sequence[str] = ("project",), busiest: int = 64) -> DataFrame:
    """(scope, least): the largest overlap among the `busiest` nodes of each scope, a bound from
    below on the largest one of all, from at most `busiest` rows a bucket."""
    from pyspark.sql.window import Window

    scope = list(scope)
    totals = members.groupBy(*scope, "node").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*scope).orderBy(F.desc("n"), "node")
    top = totals.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= busiest).select(*scope, "node")
    rows = materialize(members.join(top, [*scope, "node"], "left_semi").select(*scope, "bucket", "node"), "busiest")
    other = rows.withColumnRenamed("node", "_other")
    pairs = rows.join(other, [*scope, "bucket"]).filter("node < _other").groupBy(*scope, "node", "_other").agg(F.count(F.lit(1)).alias("c"))
    found = pairs.groupBy(*scope).agg(F.max("c").alias("least"))
    return rows.select(*scope).distinct().join(found, scope, "left").na.fill(1, ["least"])
