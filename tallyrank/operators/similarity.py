"""Exact nearest neighbours by balls, and what is built on them.

Base rows are gathered in balls around pivots. A query first meets the balls nearest to it that
hold k rows. The k-th best so far is a bound from below, and the triangle inequality bounds from
above what any other ball can offer: a ball that cannot reach the bound is never visited. Balls are
stored once, cut into blocks, in the shared folder; queries are dealt once, near ones together, and
a task reads the blocks that a block of its queries has to visit, one at a time. Two blocks meet in a
matrix product of which the k best per query are kept, so neither side is ever held whole, no vector
is sent again for another visit, and no pair leaves a task. Rows near the k-th best are measured again term by term, so equal vectors give equal numbers
wherever they meet, and large norms cost no digits. Of base rows with equal vectors only the k + 1
smallest ids can be neighbours; the others are left out before anything is compared. The result is
exact; `probe` asks for the nearest balls only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrank.functions.hashing import hash_int, uniform
from tallyrank.operators.pairs import partitions
from tallyrank.operators.scale import exact_quantiles
from tallyrank.session import discard, materialize, scratch_path

BLOCK = 4096
#: Most balls, so pivots and radii stay small enough for every task. Larger balls are cut into blocks.
BALLS = 1024
#: Pairs measured term by term at once.
PAIRS = 100_000
#: Queries of a block compared at once.
SLICE = 1024

Part = tuple[str, str, float]  # vector column, metric, weight


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _space(a: np.ndarray, metric: str) -> np.ndarray:
    """Where the metric is a function of Euclidean distance: unit vectors for the cosine."""
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12) if metric == "cosine" else a


def _of_distance(d: np.ndarray, metric: str) -> np.ndarray:
    return 1.0 - d * d / 2.0 if metric == "cosine" else -d if metric == "euclidean" else np.exp(-d)


def _distances(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """All distances by one product, and how far off they may be."""
    c = b.mean(axis=0)
    q, b = q - c, b - c
    qq, bb = (q * q).sum(1), (b * b).sum(1)
    d = np.sqrt(np.maximum(qq[:, None] + bb[None, :] - 2.0 * (q @ b.T), 0.0))
    return d, float(np.sqrt(1e-15 * q.shape[1] * (qq.max() + bb.max())))


def _rough(q: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """All similarities by one product, and how far off they may be."""
    if metric == "cosine":
        return _space(q, metric) @ _space(b, metric).T, 1e-14 * q.shape[1]
    d, off = _distances(q, b)
    return _of_distance(d, metric), off


def _exact(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of row pairs, term by term."""
    if metric == "cosine":
        return (_space(q, metric) * _space(b, metric)).sum(axis=1)
    return _of_distance(np.sqrt(((q - b) ** 2).sum(axis=1)), metric)


def best_rows(q_ids: np.ndarray, q: list[np.ndarray], b_ids: np.ndarray, b: list[np.ndarray], k: int, parts: Sequence[Part], skip_self: bool,
              least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of b, similarity) of the k best rows of b for each row of q; ties by neighbour id. What is
    below `least`, of each row of q, may be missing."""
    rough, off = np.zeros((len(q_ids), len(b_ids))), 1e-15
    for x, y, (_, metric, weight) in zip(q, b, parts):
        sim, error = _rough(x, y, metric)
        rough, off = rough + weight * sim, off + abs(weight) * error
    if skip_self:
        rough[q_ids[:, None] == b_ids[None, :]] = -np.inf
    low = np.full(len(rough), -np.inf) if least is None else least
    near = rough >= low[:, None] - 2 * off
    if rough.shape[1] > k and np.count_nonzero(near) > 2 * k * len(rough):
        low = np.maximum(low, np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k])
        near = rough >= low[:, None] - 2 * off
    row, col = np.nonzero(near)
    there = np.isfinite(rough[row, col])
    row, col = row[there], col[there]
    sim = np.empty(len(row))
    for at in range(0, len(row), PAIRS):
        r, c = row[at:at + PAIRS], col[at:at + PAIRS]
        sim[at:at + PAIRS] = sum(weight * _exact(x[r], y[c], metric) for x, y, (_, metric, weight) in zip(q, b, parts))
    return _best(row, col, sim, np.unique(b_ids, return_inverse=True)[1][col], k)


def _best(row: np.ndarray, col: np.ndarray, sim: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar of each row, the best first."""
    order = np.lexsort((tie, -sim, row))
    row, col, sim = row[order], col[order], sim[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], col[best], sim[best]


def best_of_block(q_ids: np.ndarray, q: list[np.ndarray], b_ids: np.ndarray, b: list[np.ndarray], k: int,
                  parts: Sequence[Part], skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, similarity) of the k best rows of b for each row of q; ties by neighbour id."""
    row, col, sim = best_rows(q_ids, q, b_ids, b, k, parts, skip_self)
    return q_ids[row], b_ids[col], sim


class Balls:
    """Pivots of all parts with the radii and sizes of their balls; bounded by BALLS."""

    def __init__(self, pivots: list[np.ndarray], parts: Sequence[Part]) -> None:
        self.parts = parts
        self.pivots = [_space(p, metric) for p, (_, metric, _) in zip(pivots, parts)]
        self.radius: list[np.ndarray] = []
        self.size = np.empty(0, np.int64)

    def nearest(self, vectors: list[np.ndarray]) -> np.ndarray:
        """The ball of each row, by the first part."""
        return _distances(_space(vectors[0], self.parts[0][1]), self.pivots[0])[0].argmin(axis=1)

    def reach(self, vectors: list[np.ndarray], ball: np.ndarray) -> list[np.ndarray]:
        """Distances of rows to their pivot, one array a part."""
        return [np.sqrt(((_space(v, metric) - p[ball]) ** 2).sum(axis=1)) for v, p, (_, metric, _) in zip(vectors, self.pivots, self.parts)]

    def bounds(self, vectors: list[np.ndarray]) -> np.ndarray:
        """What each ball can offer each row at best."""
        out = 0.0
        for v, p, r, (_, metric, weight) in zip(vectors, self.pivots, self.radius, self.parts):
            d, off = _distances(_space(v, metric), p)
            out = out + weight * _of_distance(np.maximum(d - r[None, :] - off - 1e-12, 0.0), metric)
        return out + 1e-12

    def order(self, vectors: list[np.ndarray]) -> np.ndarray:
        """Balls of each row from the nearest pivot outwards, empty ones last."""
        d = _distances(_space(vectors[0], self.parts[0][1]), self.pivots[0])[0]
        return np.argsort(np.where(self.size[None, :] > 0, d, np.inf), axis=1, kind="stable")

    def first(self, vectors: list[np.ndarray], want: int) -> np.ndarray:
        """Marks of the nearest balls that hold `want` rows together."""
        order = self.order(vectors)
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, (before < want) & (self.size[order] > 0), axis=1)
        return out


def _meet(visits: DataFrame, base: DataFrame, cuts: DataFrame, k: int, parts: Sequence[Part], skip_self: bool, id_type: str) -> DataFrame:
    """The k best per query and pair of blocks. `visits` and `base` have _ball, _id and vectors; `cuts`
    has the numbers of blocks of a ball on either side (_ball, _nq, _nb)."""
    block = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vecs = list(dict.fromkeys(f"_v_{p[0]}" for p in parts))
    cuts = F.broadcast(cuts)  # a row per ball, at most BALLS
    q = visits.join(cuts, "_ball").select("_ball", "_id", *vecs, block("_nq").alias("_q"), each("_nb").alias("_b"))
    b = base.join(cuts, "_ball").select("_ball", "_id", *vecs, block("_nb").alias("_b"), each("_nq").alias("_q"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            lv, rv = ([_matrix(t.column(f"_v_{p[0]}")) for p in parts] for t in (left, right))
            ids = (t.column("_id").to_numpy() for t in (left, right))
            out = best_of_block(next(ids), lv, next(ids), rv, k, parts, skip_self)
        return pa.table({"query": pa.array(out[0], left.schema.field("_id").type), "neighbor": pa.array(out[1], left.schema.field("_id").type),
                         "similarity": pa.array(out[2], pa.float64())})

    keys = ["_ball", "_q", "_b"]
    return q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(best, f"query {id_type}, neighbor {id_type}, similarity double")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _stored_balls(rows: DataFrame, cuts: DataFrame, folder: str) -> list[tuple[int, str]]:
    """Writes `rows` (_ball, _id, vectors) in blocks, `cuts` (_ball, _nb) for a ball, under `folder`; (ball, file) of each
    block. A retried task writes other files, and only those of the one that counts are named."""
    def write(key, table):
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        with store.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        return pa.table({"ball": pa.array([key[0].as_py()], pa.int32()), "file": pa.array([name])})

    vecs = [c for c in rows.columns if c.startswith("_v_")]
    dealt = rows.join(F.broadcast(cuts), "_ball").select("_ball", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int").alias("_b"), "_id", *vecs)
    files = materialize(dealt.groupBy("_ball", "_b").applyInArrow(write, "ball int, file string"), "files")
    return [(r["ball"], r["file"]) for r in files.collect()]  # a row for a block


def _search(balls: Balls, files: list[tuple[int, str]], folder: str, k: int, parts: Sequence[Part], skip_self: bool, probe: int | None, block: int):
    """The task that finds the k best of its queries (_id, vectors), a block of them at a time: query, neighbor, similarity,
    and how many balls were visited, in the first row of a block."""
    want = k + 1 if skip_self else k

    def read(store, root: str, ball: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for at, name in files:
            if at == ball:
                with store.open_input_stream(f"{root}/{name}") as stream:
                    table = pa.ipc.open_stream(stream).read_all()
                yield table.column("_id").to_numpy(), [_matrix(table.column(f"_v_{p[0]}")) for p in parts]

    def found(table: pa.Table, store, root: str) -> pa.RecordBatch:
        ids, vectors = table.column("_id").to_numpy(), [_matrix(table.column(f"_v_{p[0]}")) for p in parts]
        n, some = len(ids), [slice(at, at + SLICE) for at in range(0, len(ids), SLICE)]
        piece = lambda rows: [v[rows] for v in vectors]
        first = np.concatenate([balls.first(piece(s), want) if probe is None else _nearest_marks(balls.order(piece(s)), probe) for s in some])
        bounds = np.concatenate([balls.bounds(piece(s)) for s in some]) if probe is None else None
        best, sims, have = np.empty((n, k), ids.dtype), np.full((n, k), -np.inf), np.zeros(n, np.int64)
        visited = 0
        # the nearest balls of all queries, then what the others may still have to offer, the most promising balls first
        rounds = [(ball, True) for ball in np.flatnonzero(first.any(axis=0))]
        if probe is None:
            rounds += [(ball, False) for ball in np.argsort(-bounds.mean(axis=0), kind="stable") if balls.size[ball] > 0]
        for ball, near in rounds:
            here = first[:, ball] if near else ~first[:, ball] & (bounds[:, ball] >= sims[:, -1])
            rows = np.flatnonzero(here)
            visited += len(rows)
            if not len(rows):
                continue
            for b_ids, b in read(store, root, ball):
                for at in range(0, len(rows), SLICE):
                    mine = rows[at:at + SLICE]
                    row, col, sim = best_rows(ids[mine], piece(mine), b_ids, b, k, parts, skip_self, sims[mine, -1])
                    if not len(row):
                        continue
                    # those found before beside the new ones, in the rows that have new ones
                    new = np.unique(row)
                    kept = np.repeat(new, have[mine[new]])
                    place = np.concatenate([np.arange(h) for h in have[mine[new]]]).astype(np.int64)
                    every = np.concatenate([best[mine[kept], place], b_ids[col]])
                    row, pick, sim = _best(np.concatenate([kept, row]), np.arange(len(every)), np.concatenate([sims[mine[kept], place], sim]),
                                           np.unique(every, return_inverse=True)[1], k)
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    best[mine[row], place], sims[mine[row], place] = every[pick], sim
                    have[mine[new]] = np.bincount(row, minlength=len(mine))[new]
        row = np.repeat(np.arange(n), have)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        made = np.zeros(len(row), np.int64)
        made[:1] = visited
        kind = table.schema.field("_id").type
        return pa.RecordBatch.from_pydict({"query": pa.array(ids[row], kind), "neighbor": pa.array(best[row, place], kind),
                                           "similarity": pa.array(sims[row, place], pa.float64()), "made": pa.array(made)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), held, n = _filesystem(folder), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                n += held[-1].num_rows
                if n >= block:
                    yield found(pa.Table.from_batches(held).combine_chunks(), store, root)
                    held, n = [], 0
        if n:
            yield found(pa.Table.from_batches(held).combine_chunks(), store, root)

    return run


def _placed(rows: DataFrame, parts: Sequence[Part], place: Callable[[list[np.ndarray], pa.RecordBatch], list[tuple[np.ndarray, ...]]],
            schema: str) -> DataFrame:
    """Rows made from batches of vectors: `place` gives columns of arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                yield place([_matrix(some.column(f"_v_{p[0]}")) for p in parts], some)

    return rows.mapInArrow(run, schema)


def knn(query: DataFrame, base: DataFrame, k: int, parts: Sequence[Part] = (("embedding", "cosine", 1.0),),
        id_col: str = "vec_id", skip_self: bool = False, block: int = BLOCK, probe: int | None = None,
        visits: dict | None = None) -> DataFrame:
    """The k most similar base rows of each query row: query, neighbor, similarity, rank.

    `parts` adds similarities with weights of at least 0: "cosine", "euclidean" (as minus the
    distance) or "exp_euclidean". Rows without a vector have no neighbours and are none. With
    `probe` a query visits that many nearest balls only, and neighbours may be missed; without it
    the result is exact. `visits` gets the numbers of (query, ball) visits `made` and `possible`.
    """
    spark = query.sparkSession
    vecs = list(dict.fromkeys(p[0] for p in parts))
    id_type = dict(query.dtypes)[id_col]
    # fresh aliases: both sides may come from one table
    cols = [F.col(id_col).alias("_id"), *[F.col(v).alias(f"_v_{v}") for v in vecs]]
    there = " and ".join(f"_v_{v} is not null" for v in vecs)
    q, b = query.select(*cols).filter(there), base.select(*cols).filter(there)
    nq, nb = q.count(), b.count()
    n_balls = min(BALLS, max(1, -(-nb // block)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbor"))
    if n_balls == 1:
        cuts = [(0, max(1, -(-nq // block), min(spark.sparkContext.defaultParallelism, nq // 256)), 1)]
        whole = lambda rows: rows.withColumn("_ball", F.lit(0))
        found = _meet(whole(q), whole(b), spark.createDataFrame(cuts, "_ball int, _nq int, _nb int"), k, parts, skip_self, id_type)
        if visits is not None:
            visits.update(made=nq, possible=nq)
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)
    b = _few_equal(b, k + 1)
    drawn = b.orderBy(F.xxhash64("_id"), "_id").limit(n_balls).toArrow()
    balls = Balls([_matrix(drawn.column(f"_v_{p[0]}")) for p in parts], parts)

    def assign(vectors: list[np.ndarray], some: pa.RecordBatch) -> pa.RecordBatch:
        ball = balls.nearest(vectors)
        extra = [pa.array(ball, pa.int32()), *[pa.array(r) for r in balls.reach(vectors, ball)]]
        return pa.RecordBatch.from_arrays([*some.columns, *extra], names=[*some.schema.names, "_ball", *[f"_r{i}" for i in range(len(parts))]])

    schema = ", ".join(f"{n} {t}" for n, t in b.dtypes) + ", _ball int, " + ", ".join(f"_r{i} double" for i in range(len(parts)))
    base_rows = _placed(b, parts, assign, schema)
    stats = base_rows.groupBy("_ball").agg(F.count(F.lit(1)).alias("n"), *[F.max(f"_r{i}").alias(f"r{i}") for i in range(len(parts))]).collect()
    balls.size = np.zeros(len(balls.pivots[0]), np.int64)
    balls.radius = [np.zeros(len(balls.size)) for _ in parts]
    for r in stats:  # a row per ball
        balls.size[r["_ball"]] = r["n"]
        for i, radius in enumerate(balls.radius):
            radius[r["_ball"]] = r[f"r{i}"]
    folder = scratch_path(spark, "balls")
    cuts = spark.createDataFrame([(r["_ball"], max(1, -(-r["n"] // block))) for r in stats], "_ball int, _nb int")
    files = _stored_balls(base_rows, cuts, folder)

    def nearest(vectors: list[np.ndarray], some: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*some.columns, pa.array(balls.nearest(vectors), pa.int32())], names=[*some.schema.names, "_ball"])

    # near queries come together, so that they visit the same balls
    tasks = max(1, min(max(partitions(q), -(-nq // block)), -(-nq // 256)))
    dealt = _placed(q, parts, nearest, ", ".join(f"{n} {t}" for n, t in q.dtypes) + ", _ball int").repartitionByRange(
        tasks, "_ball", F.xxhash64("_id")).sortWithinPartitions("_ball").drop("_ball")
    found = materialize(dealt.mapInArrow(_search(balls, files, folder, k, parts, skip_self, probe, block),
                                         f"query {id_type}, neighbor {id_type}, similarity double, made bigint"), "nearest")
    discard(folder)
    if visits is not None:
        visits.update(made=found.agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0], possible=nq * int((balls.size > 0).sum()))
    return found.drop("made").withColumn("rank", rank).filter(F.col("rank") <= k)


def _few_equal(rows: DataFrame, most: int) -> DataFrame:
    """Of rows (_id, vectors) with equal vectors, the `most` smallest ids: another one is never among the
    neighbours. Only vectors that may come more often are moved."""
    vecs = [c for c in rows.columns if c != "_id"]
    hashed = rows.withColumn("_h", F.xxhash64(*vecs))
    often = materialize(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("_h"), "often")
    if often.isEmpty():
        return rows
    same = Window.partitionBy(*vecs).orderBy("_id")
    few = hashed.join(often, "_h", "left_semi").withColumn("_same", F.row_number().over(same)).filter(F.col("_same") <= most)
    return hashed.join(often, "_h", "left_anti").select(*rows.columns).unionByName(few.select(*rows.columns))


def _nearest_marks(order: np.ndarray, probe: int) -> np.ndarray:
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order[:, :probe], True, axis=1)
    return out


def recall(approximate: DataFrame, exact: DataFrame) -> float:
    """The share of exact (query, neighbor) rows that the other result has."""
    n = exact.count()
    keys = ["query", "neighbor"]
    return exact.join(approximate.select(*keys), keys, "left_semi").count() / n if n else 1.0


# ---- graphs from vectors --------------------------------------------------

def semantic_edges(emb: DataFrame, k: int = 10, threshold: float = 0.7, id_col: str = "vec_id") -> DataFrame:
    """Undirected top-k cosine neighbours above the threshold, larger weight kept."""
    n = knn(emb, emb, k, id_col=id_col, skip_self=True).filter(F.col("similarity") >= threshold)
    return n.groupBy(F.least("query", "neighbor").alias("src"), F.greatest("query", "neighbor").alias("dst")).agg(
        F.max("similarity").alias("weight"))


def knn_graph(emb: DataFrame, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """Directed Euclidean neighbours, weight 1 / (1 + distance)."""
    n = knn(emb, emb, k, (("embedding", "euclidean", 1.0),), id_col, skip_self=True)
    return n.select(F.col("query").alias("src"), F.col("neighbor").alias("dst"),
                    (1.0 / (1.0 - F.col("similarity"))).alias("weight"))


def knn_adjacency(features: DataFrame, k: int = 5, threshold: float = 0.5, vec: str = "embedding",
                  id_col: str = "vec_id", connect_few: bool = True) -> DataFrame:
    """Symmetric 0/1 edges to cosine neighbours. With at most k nodes all are connected, as
    published; `connect_few=False` holds the threshold there as well."""
    few = connect_few and features.limit(k + 1).count() <= k
    n = knn(features, features, k, ((vec, "cosine", 1.0),), id_col, skip_self=True)
    if not few:
        n = n.filter(F.col("similarity") >= threshold)
    both = n.select(F.explode(F.array(
        F.struct(F.col("query").alias("src"), F.col("neighbor").alias("dst")),
        F.struct(F.col("neighbor").alias("src"), F.col("query").alias("dst")))).alias("e")).select("e.*")
    return both.distinct()


# ---- scaling --------------------------------------------------------------

def zscore(df: DataFrame, columns: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """(x - mean) / (population std + eps) from one aggregate."""
    s = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    return df.crossJoin(F.broadcast(s)).withColumns({
        c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(eps)) for c in columns}).select(*df.columns)


def _standardised(df: DataFrame, columns: Sequence[str], out: str, eps: float = 1e-8) -> DataFrame:
    """All columns as one vector of (x - mean) / (population std + eps); statistics are of whole vectors."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    s = df.select(array_to_vector(x).alias("v")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    n = F.col("s.count").cast("double")
    spread = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n) + F.lit(eps))
    s = s.select(vector_to_array("s.mean").alias("_mean"), spread.alias("_spread"))
    off = F.zip_with(x, "_mean", lambda a, b: a - b)
    return df.crossJoin(F.broadcast(s)).withColumn(out, F.zip_with(off, "_spread", lambda a, b: a / b)).drop("_mean", "_spread")  # one row


def minmax_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])


def minmax_transform(df: DataFrame, fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    span = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    return df.crossJoin(F.broadcast(fit)).withColumns({
        c: (F.col(c) - F.col(f"_lo_{c}")) / F.when(span(c) == 0, 1.0).otherwise(span(c)) for c in columns
    }).select(*df.columns)


def minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return minmax_transform(df, minmax_fit(df, columns), columns)


# ---- imputation and scoring of unseen tests --------------------------------

def conservative_defaults(base: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of features for a test that nothing is like: a new and novel test with the
    median flakiness, and base means for the rest."""
    fixed = {"test_age": 0.0, "test_novelty": 1.0}
    row = base.agg(*[(F.lit(fixed[c]) if c in fixed else F.avg(c)).alias(c) for c in columns if c != "flakiness_rate"],
                   F.count(F.lit(1)).alias("_rows"))
    if "flakiness_rate" in columns:
        row = row.crossJoin(exact_quantiles(base.select("flakiness_rate"), [], "flakiness_rate", {"flakiness_rate": 0.5}))
    return row.select(*columns)


def knn_impute(query: DataFrame, base: DataFrame, columns: Sequence[str], k: int = 10, threshold: float = 0.5,
               weighted: bool = True, defaults: DataFrame | None = None, noise: float = 0.0, seed: int = 42,
               id_col: str = "vec_id", vec: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Features of query rows from the mean of similar base rows, else base means.

    `defaults` is one row with a column per feature, such as `conservative_defaults` gives.
    Noise, off by default, is a share of each feature's spread; noisy features are clipped to
    their valid ranges.
    """
    n = knn(query, base, k, ((vec, "cosine", 1.0),), id_col, block=block).filter(F.col("similarity") >= threshold)
    feats = base.select(F.col(id_col).alias("neighbor"), *columns)
    w = F.col("similarity") if weighted else F.lit(1.0)
    got = n.join(feats, "neighbor").groupBy(F.col("query").alias(id_col)).agg(
        *[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns], F.count(F.lit(1)).alias("neighbors"))
    if defaults is None:
        defaults = base.agg(*[F.avg(c).alias(c) for c in columns])
    d = defaults.select(*[F.col(c).alias(f"_d_{c}") for c in columns])
    out = query.select(id_col).join(got, id_col, "left").crossJoin(F.broadcast(d))
    out = out.select(id_col, *[F.coalesce(F.col(c), F.col(f"_d_{c}")).alias(c) for c in columns],
                     F.coalesce("neighbors", F.lit(0)).alias("neighbors"))
    if noise > 0:
        # two uniforms give a normal draw that is the same on every run
        s = base.agg(*[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
        normal = lambda c: F.sqrt(-2.0 * F.log(1.0 - uniform(F.col(id_col), c, seed, "r"))) * F.cos(
            2.0 * F.pi() * uniform(F.col(id_col), c, seed, "t"))
        out = out.crossJoin(F.broadcast(s)).withColumns({
            c: F.col(c) + F.lit(float(noise)) * F.col(f"_s_{c}") * normal(c) for c in columns
        }).select(id_col, *columns, "neighbors")
        out = clip_features(out, "v2")  # by name, so it holds for both layouts
    return out


# fixed values: valid ranges of the 6- and the 29-column feature layout
_RATES = ["failure_rate", "recent_failure_rate", "flakiness_rate", "test_novelty"]
_RATES_29 = ["execution_frequency", "very_recent_failure_rate", "medium_term_failure_rate", "stability_score"]
_COUNTS_29 = ["execution_count", "failure_count", "pass_count", "consecutive_failures", "consecutive_passes",
              "max_consecutive_failures", "last_failure_age", "last_pass_age", "failure_trend",
              "recent_execution_count", "acceleration", "builds_affected", "cr_count", "commit_count_actual",
              "pass_fail_ratio"]
# end of fixed values


def clip_features(df: DataFrame, layout: str = "v1") -> DataFrame:
    """Rates to [0, 1], counts and ages to at least 0, commit count to at least 1."""
    rates = [*_RATES, *(_RATES_29 if layout == "v2" else [])]
    floors = {"test_age": 0.0, "commit_count": 1.0, **({c: 0.0 for c in _COUNTS_29} if layout == "v2" else {})}
    cols = {c: F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)) for c in rates}
    cols |= {c: F.greatest(F.col(c), F.lit(v)) for c, v in floors.items()}
    return df.withColumns({c: v for c, v in cols.items() if c in df.columns})


def score_orphans(orphans: DataFrame, in_graph: DataFrame, k: int = 20, alpha: float = 0.55,
                  temperature: float = 0.7, min_similarity: float = 0.05, structural_weight: float = 0.35,
                  structural: Sequence[str] = (), id_col: str = "vec_id", fallback: str | None = None,
                  block: int = BLOCK) -> DataFrame:
    """Score of tests outside the graph from their k nearest tests in it.

    `in_graph` has `score`, `orphans` has `base_score`. Similarity is exp(-distance) of the
    embeddings, blended with the cosine of standardised structural features. Neighbour
    scores are averaged with softmax weights, then blended with the base score.
    """
    t = temperature if temperature > 0 else 1.0
    parts: list[Part] = [("embedding", "exp_euclidean", 1.0)]
    if structural and structural_weight > 0:
        w = min(structural_weight, 1.0)
        parts = [("embedding", "exp_euclidean", 1.0 - w), ("_struct", "cosine", w)]
        orphans, in_graph = (_standardised(df, structural, "_struct") for df in (orphans, in_graph))
    n = knn(orphans, in_graph, k, parts, id_col, block=block)
    if min_similarity > 0:
        n = n.filter(F.col("similarity") >= min_similarity)
    # the largest weight of a test is 1, whatever the temperature; a group has at most k rows
    w = F.exp((F.col("similarity") - F.col("_top")) / F.lit(t))
    n = n.withColumn("_top", F.max("similarity").over(Window.partitionBy("query")))
    got = n.join(in_graph.select(F.col(id_col).alias("neighbor"), "score"), "neighbor").groupBy(
        F.col("query").alias(id_col)).agg(
        (F.sum(w * F.col("score")) / F.sum(w)).alias("knn_score"), F.count(F.lit(1)).alias("neighbors"),
        F.max(F.abs("similarity")).alias("_any"))
    j = orphans.join(got, id_col, "left")
    blended = F.lit(alpha) * F.col("knn_score") + F.lit(1.0 - alpha) * F.col("base_score")
    other = F.col(fallback) if fallback else F.col("base_score")
    return j.select(id_col, F.when(F.col("_any") > 0, blended).otherwise(other).alias("score"),
                    F.coalesce("neighbors", F.lit(0)).alias("neighbors"))


# ---- blending -------------------------------------------------------------

def blend(a: Column, b: Column, alpha: float) -> Column:
    return F.lit(float(alpha)) * a + F.lit(1.0 - float(alpha)) * b


def sweep_alpha(df: DataFrame, alphas: Sequence[float], a: str = "score_a", b: str = "score_b",
                min_failing: int = 3) -> DataFrame:
    """The first alpha with the best mean APFD; 0 with fewer than 3 failing builds."""
    from tallyrank.operators.metrics import apfd_per_build
    from tallyrank.operators.ranking import rank_in_build

    grid = F.explode(F.array(*[F.lit(float(x)) for x in alphas]))
    rows = df.select("project", "build_id", "tc_key", "fail", a, b, grid.alias("alpha"))
    rows = rows.select("project", F.concat_ws("|", F.col("alpha").cast("string"), "build_id").alias("build_id"), "tc_key", "fail",
                       "alpha", (F.col("alpha") * F.col(a) + (1.0 - F.col("alpha")) * F.col(b)).alias("score"))
    per = apfd_per_build(rank_in_build(rows), ["alpha"])
    by = per.groupBy("project", "alpha").agg(F.avg("apfd").alias("mean_apfd"), F.count(F.lit(1)).alias("n"))
    best = by.groupBy("project").agg(
        F.max(F.struct(F.round("mean_apfd", 12).alias("s"), (-F.col("alpha")).alias("a"))).alias("best"), F.max("n").alias("n_builds"))
    few = F.col("n_builds") < min_failing
    return best.select("project", "n_builds", F.when(few, 0.0).otherwise(-F.col("best.a")).alias("alpha"),
                       F.when(few, F.lit(None)).otherwise(F.col("best.s")).alias("mean_apfd"))


def hybrid_score(df: DataFrame, p: str = "p_fail", priority: str = "priority_pred", history: str = "history",
                 lam: float = 0.5, boost: float = 0.3) -> DataFrame:
    """Score of in-graph tests: a mix of failure probability and rescaled priority (if the
    priority varies), then a boost by history. A test outside the graph has priority 0.5,
    keeps its probability here, and is scored by `score_orphans` afterwards.
    """
    inside = F.abs(F.col(priority) - 0.5) >= 0.001
    pr = F.when(inside, F.col(priority))
    s = df.agg(F.min(pr).alias("_lo"), F.max(pr).alias("_hi"), F.stddev_pop(pr).alias("_sd"), F.max(history).alias("_hm"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(priority) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col(priority))
    mixed = F.when(inside & (F.col("_sd") > 0.01), blend(F.col(p), scaled, lam)).otherwise(F.col(p))
    w = min(boost * 1.5, 0.8)
    boosted = F.when((F.col("_hm") > 0) & (F.col(history) > 0),
                     F.lit(1.0 - w) * mixed + F.lit(w) * F.col(history) / F.col("_hm")).otherwise(mixed)
    return df.crossJoin(F.broadcast(s)).withColumns({"hybrid_score": boosted, "in_graph": inside.cast("int")}).drop(
        "_lo", "_hi", "_sd", "_hm")


def hybrid_with_orphans(df: DataFrame, vectors: DataFrame, p: str = "p_fail", priority: str = "priority_pred", history: str = "history",
                        lam: float = 0.5, boost: float = 0.3, **options) -> DataFrame:
    """`hybrid_score` with its last stage: rows of tests outside the graph are scored from the nearest
    tests inside it, whose score is the mean of their own rows, and blended with their own score.

    `vectors` has tc_key and embedding; a test without one keeps its probability. Outside rows of one
    test share its neighbours, so the search is over tests and not over rows.
    """
    scored = hybrid_score(df, p, priority, history, lam, boost)
    inside = scored.filter("in_graph = 1").groupBy("tc_key").agg(F.avg("hybrid_score").alias("score")).join(vectors, "tc_key")
    outside = scored.filter("in_graph = 0").groupBy("tc_key").agg(F.avg("hybrid_score").alias("base_score")).join(vectors, "tc_key")
    # both are read several times
    inside, outside = materialize(inside, "inside"), materialize(outside, "outside")
    found = score_orphans(outside, inside, id_col="tc_key", **options).select("tc_key", F.col("score").alias("_orphan"), F.col("neighbors").alias("_near"))
    out = scored.join(found, "tc_key", "left")
    there = (F.col("in_graph") == 0) & F.col("_orphan").isNotNull()
    return out.withColumns({"hybrid_score": F.when(there, F.col("_orphan")).otherwise(F.col("hybrid_score")),
                            "neighbors": F.when(there, F.col("_near")).otherwise(F.lit(0))}).select(*scored.columns, "neighbors")


def smote(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", vec: str = "embedding",
          id_col: str = "vec_id") -> DataFrame:
    """Synthetic rows of the smaller class until both are equal, between a row and one of
    its k nearest rows of that class. Row and neighbour are drawn by hash. A class of one
    row is repeated as it is."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    minority = min(counts, key=lambda c: (counts[c], c))
    missing = max(counts.values()) - counts[minority]
    small = df.filter(F.col(label) == minority)
    n_small = counts[minority]
    near = knn(small, small, k, ((vec, "euclidean", 1.0),), id_col, skip_self=True)
    if n_small == 1:
        near = small.select(F.col(id_col).alias("query"), F.lit(1).alias("rank"), F.col(id_col).alias("neighbor"))
    per_row = near.groupBy("query").agg(F.count(F.lit(1)).alias("_k"))
    # every minority row yields missing / n_small copies, the remainder by hash order
    from tallyrank.operators.scale import number_rows
    order = number_rows(small.select(id_col), [], [hash_int(F.col(id_col), "smote", seed), F.col(id_col)], "_o")
    base, extra = divmod(missing, n_small)
    copies = order.withColumn("_c", F.lit(base) + (F.col("_o") <= extra).cast("int")).filter("_c > 0")
    draws = copies.select(F.col(id_col).alias("query"), F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("copy"))
    draws = draws.join(per_row, "query").withColumns({
        "rank": (F.pmod(hash_int(F.col("query"), F.col("copy"), "n", seed), F.col("_k")) + 1).cast("int"),
        "step": uniform(F.col("query"), F.col("copy"), "s", seed)})
    picked = draws.join(near.select("query", "rank", "neighbor"), ["query", "rank"])
    a = small.select(F.col(id_col).alias("query"), F.col(vec).alias("_a"))
    b = small.select(F.col(id_col).alias("neighbor"), F.col(vec).alias("_b"))
    j = picked.join(a, "query").join(b, "neighbor")
    wide = lambda v: v.cast("double")
    mix = F.zip_with("_a", "_b", lambda x, y: (wide(x) + (wide(y) - wide(x)) * F.col("step")).cast("float"))
    return j.select(F.col("query").alias(id_col), "copy", "neighbor", "step", mix.alias(vec), F.lit(minority).alias(label))
