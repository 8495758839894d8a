"""Prefix trie of conversations as balanced parentheses, one encoding per shard.

A turn is 20 bytes: an md5 of role and text, then its word count. A conversation's path is the
concatenation, so sorting paths as bytes visits the trie depth first. Equal paths are one record
(their ids are hashed in order, 4096 ids to a row). Sorted records are dealt by ranges, and each
task cuts its range into shards of a bounded size.

A shard's trie is a bit string, 1 where a node opens and 0 where it closes, written from the common
prefixes of neighbouring records. Excess (opens minus closes) is kept with minima and maxima of
blocks under a range tree; `findclose` climbs it to delimit every subtree. Leaf pairs are counted
by rank, members and savings by differences of cumulative arrays.

Nodes on the first or last path of a shard (its spines) may go on in a neighbour. They are not
finished there: each leaves the shard as a record holding what its finished subtrees add up to.
These records are shards' input again, round after round with fewer shards, until one holds all.

Defined cases: rows without conv_id belong to no conversation; null role or text is empty; of
turns with equal numbers the one with the smaller digest comes first; repeated rows are turns of
their own. An empty table has no node, not even a root. Other columns are not read. One path is
held by one task: 20 bytes a turn. The SHA-256 of one end's ids is a single stream, so the rows of
4096 ids of one path meet in one task, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.session import materialize

#: Bytes of a turn: 16 of digest, 4 of word count.
TURN = 20
BLOCK = 64
#: Turns (with repeats) that a shard takes before it is closed.
SHARD_TURNS = 200_000
#: Spine records that one last shard takes.
LAST = 50_000
#: Rebuilding: a conversation borrows from the first of its group of this many ids.
GROUP = 20
NO_IDS = hashlib.sha256(b"").hexdigest()

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string, path binary, parent_path binary, spine boolean")


class Record(NamedTuple):
    """A node with what is known of it besides its place: members that end there or lie in finished
    subtrees, their smallest id, finished children, their leaves and savings, the hash of its ends."""

    path: bytes
    members: int
    first: int
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None


class Excess:
    """Excess of a parenthesis string under a tree of block minima (and maxima)."""

    def __init__(self, signs: np.ndarray) -> None:
        self.size = len(signs)
        excess = np.cumsum(signs, dtype=np.int32)
        pad = -self.size % BLOCK
        self.blocks = np.concatenate((excess, np.full(pad, excess[-1], np.int32))).reshape(-1, BLOCK)
        self.flat = self.blocks.reshape(-1)
        self.low, self.high = [self.blocks.min(axis=1)], [self.blocks.max(axis=1)]
        while len(self.low[-1]) > 1:
            for levels, fold, blank in ((self.low, np.minimum, np.iinfo(np.int32).max), (self.high, np.maximum, np.iinfo(np.int32).min)):
                level = levels[-1]
                if len(level) % 2:
                    level = levels[-1] = np.append(level, np.int32(blank))
                levels.append(fold(level[::2], level[1::2]))

    def _inside(self, block: np.ndarray, after: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First place in `block`, past column `after`, with an excess under `below`; -1 if none."""
        out = np.empty(len(block), np.int64)
        for at in range(0, len(block), 1 << 15):
            s = slice(at, at + (1 << 15))
            hit = (self.blocks[block[s]] < below[s, None]) & (np.arange(BLOCK) > after[s, None])
            col = hit.argmax(axis=1)
            out[s] = np.where(hit[np.arange(len(col)), col], block[s] * BLOCK + col, -1)
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The place where each node closes: the first one whose excess is under its own."""
        own = self.flat[opens]
        out = self._inside(opens // BLOCK, opens % BLOCK, own)
        left = np.flatnonzero(out < 0)
        if not len(left):
            return out
        at, want = opens[left] // BLOCK, own[left]
        level, found = np.zeros(len(left), np.int64), np.full(len(left), -1, np.int64)
        for k, low in enumerate(self.low[:-1]):  # up, until a right neighbour goes low enough
            open_ = np.flatnonzero((found < 0) & (at % 2 == 0))
            open_ = open_[low[at[open_] + 1] < want[open_]]
            found[open_], level[open_] = at[open_] + 1, k
            at //= 2
        for k in range(len(self.low) - 2, 0, -1):  # and down to its first low block
            here = np.flatnonzero(level == k)
            child = 2 * found[here]
            found[here] = np.where(self.low[k - 1][child] < want[here], child, child + 1)
            level[here] = k - 1
        out[left] = self._inside(found, np.full(len(left), -1), want)
        return out


class Shard(NamedTuple):
    """Nodes of one shard in depth-first order, the root first."""

    opens: np.ndarray
    closes: np.ndarray
    signs: np.ndarray
    depth: np.ndarray
    parent: np.ndarray
    words: np.ndarray
    maker: np.ndarray
    end: np.ndarray


def encode(paths: list[bytes]) -> Shard:
    """The parenthesis string of sorted paths, with every node's extent, parent and words. `maker`
    is a path that leads to the node, `end` the node where each path ends."""
    size = np.fromiter(map(len, paths), np.int64, len(paths)) // TURN
    flat = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, TURN)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(paths)), size)
    depth = np.arange(len(flat)) - start[of]
    before = np.maximum(of - 1, 0)
    there = (of > 0) & (depth < size[before])
    codes = flat.view(np.uint32).reshape(-1, TURN // 4)
    same = there.copy()
    same[there] = (codes[there] == codes[start[before[there]] + depth[there]]).all(axis=1)
    common = size.copy()
    filled = np.flatnonzero(size)
    if len(filled):
        common[filled] = np.minimum(np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, depth), start[filled]), size[filled])
    new = depth >= common[of]
    runs = np.empty(2 * len(paths) + 2, np.int64)  # of opens and closes in turn: the root, then closes and opens of each record
    runs[0], runs[-1] = 1, size[-1] + 1
    runs[1:-1:2] = np.concatenate(([0], size[:-1])) - common
    runs[2:-1:2] = size - common
    signs = np.repeat(np.resize(np.array([1, -1], np.int8), len(runs)), runs)
    opens = np.flatnonzero(signs > 0)
    node_depth = np.concatenate(([0], depth[new] + 1))
    order = np.argsort(node_depth, kind="stable")
    n = len(node_depth)
    rank = node_depth[order] * n + order
    above = np.searchsorted(rank, (node_depth - 1) * n + np.arange(n), side="right") - 1
    parent = np.where(node_depth > 0, order[np.maximum(above, 0)], -1)
    words = np.concatenate(([0], flat[new][:, 16:].copy().view(">u4").reshape(-1).astype(np.int64)))
    last_new = np.zeros(len(paths), np.int64)
    np.maximum.at(last_new, of[new], np.arange(1, n))
    return Shard(opens, Excess(signs).findclose(opens), signs, node_depth, parent, words,
                 np.concatenate(([0], of[new])), np.maximum.accumulate(last_new))


def _lowest(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The minimum of values[begin:end] for each pair, by minima over powers of two."""
    table, k = [values], 1
    while 2 * k <= len(values):
        table.append(np.minimum(table[-1][:-k], table[-1][k:]))
        k *= 2
    level = np.frexp(end - begin)[1] - 1
    out = np.empty(len(begin), values.dtype)
    for j in np.unique(level):
        at = np.flatnonzero(level == j)
        out[at] = np.minimum(table[j][begin[at]], table[j][end[at] - (1 << int(j))])
    return out


def finish(records: list[Record], last: bool, with_paths: bool) -> pa.RecordBatch:
    """Rows of NODE for the nodes of one shard; unless it is the last one, spines as records."""
    t = encode([r.path for r in records])
    n = len(t.depth)

    def at_nodes(values, dtype=np.int64) -> np.ndarray:
        out = np.zeros(n, dtype)
        np.add.at(out, t.end, np.array(values, dtype))
        return out

    members, children0, leaves0, saved0 = (at_nodes([r[k] for r in records]) for k in (1, 3, 4, 5))
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, t.end, np.array([r.first for r in records], np.int64))
    size = (t.closes - t.opens + 1) // 2
    ids = np.arange(n)
    stop = ids + size

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return total[stop] - total[ids]

    n_convs = below(members)
    smallest = _lowest(first, ids, stop)
    n_children = children0 + np.bincount(t.parent[1:], minlength=n)
    leaf = np.zeros(len(t.signs) + 1, np.int64)  # leaf pairs up to each place
    pair = (t.signs[:-1] > 0) & (t.signs[1:] < 0)
    pair[t.opens[(children0 > 0) & (size == 1)]] = False
    leaf[1:-1] = np.cumsum(pair)
    leaf[-1] = leaf[-2]
    n_leaves = leaf[t.closes] - leaf[t.opens] + below(leaves0)
    saved = below(saved0 + (n_convs - 1) * t.words)
    ends = [None] * n
    for node, r in zip(t.end.tolist(), records):
        ends[node] = r.ends or ends[node]
    path_of = lambda i: records[t.maker[i]].path[:TURN * int(t.depth[i])]
    spine = np.zeros(n, bool)
    if not last:
        spine[:len(records[0].path) // TURN + 1] = True
        spine |= t.closes >= len(t.signs) - len(records[-1].path) // TURN - 1
    inner = ~spine
    waiting = inner & (t.parent >= 0) & spine[np.maximum(t.parent, 0)]
    parent_id = np.where(t.parent >= 0, smallest[np.maximum(t.parent, 0)], 0)

    def gathered(own: np.ndarray, finished: np.ndarray) -> np.ndarray:
        out = own.copy()
        np.add.at(out, t.parent[waiting], finished[waiting])
        return out

    spine_first = first.copy()
    np.minimum.at(spine_first, t.parent[waiting], smallest[waiting])
    spine_columns = [np.where(spine, gathered(own, done), whole) for own, done, whole in (
        (members, n_convs, n_convs), (children0, np.ones(n, np.int64), n_children), (leaves0, n_leaves, n_leaves), (saved0, saved, saved))]
    return pa.RecordBatch.from_arrays([
        pa.array(np.where(spine, spine_first, smallest)),
        pa.array(t.depth),
        pa.array(parent_id, mask=spine | waiting | (t.parent < 0)),
        *[pa.array(c) for c in spine_columns],
        pa.array([e if s else e or NO_IDS for e, s in zip(ends, spine.tolist())], pa.string()),
        pa.array([path_of(i) if s or with_paths else None for i, s in enumerate(spine.tolist())], pa.binary()),
        pa.array([path_of(t.parent[i]) if w else None for i, w in enumerate(waiting.tolist())], pa.binary()),
        pa.array(spine),
    ], names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path",
              "parent_path", "spine"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
    """Records of sorted (path, members, first, ids) rows; the rows of one path are one record."""
    path, members, first, ends = None, 0, 0, None
    for batch in batches:
        for p, n, low, ids in zip(*[batch.column(k).to_pylist() for k in ("path", "members", "first", "ids")]):
            if p != path:
                if path is not None:
                    yield Record(path, members, first, ends=ends.hexdigest())
                path, members, first, ends = p, 0, low, hashlib.sha256()
            else:
                ends.update(b",")
            members, first = members + n, min(first, low)
            ends.update(ids.encode())
    if path is not None:
        yield Record(path, members, first, ends=ends.hexdigest())


def _spines(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
    names = ("path", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    for batch in batches:
        yield from map(Record, *[batch.column(k).to_pylist() for k in names])


def _shards(rows: DataFrame, read, last: bool, with_paths: bool, shard_turns: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for r in read(batches):
            held.append(r)
            turns += 1 + len(r.path) // TURN
            if turns >= shard_turns and not last:
                yield finish(held, last, with_paths)
                held, turns = [], 0
        if held:
            yield finish(held, last, with_paths)

    return rows.mapInArrow(run, NODE)


def trie(paths: DataFrame, shard_turns: int = SHARD_TURNS, most_last: int = LAST) -> DataFrame:
    """Nodes of the trie over `paths` (conv_id distinct, path): one row per node, as in NODE's first
    eight columns, with `conv_id` the smallest member."""
    by_ids = paths.groupBy("path", F.shiftright("conv_id", 12).alias("part")).agg(
        F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("first"),
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    rows = materialize(by_ids, "paths")
    rows = rows.repartitionByRange("path").sortWithinPartitions("path", "part")
    nodes = materialize(_shards(rows, _records, False, False, shard_turns), "shards")
    done, spines = [nodes.filter("not spine")], nodes.filter("spine")
    left, before = spines.count(), None
    while left:
        last = left <= most_last or (before is not None and left >= before)
        rows = spines.repartition(1) if last else spines.repartitionByRange("path")
        nodes = materialize(_shards(rows.sortWithinPartitions("path"), _spines, last, True, shard_turns), "spines")
        done.append(nodes.filter("not spine"))
        spines, before = nodes.filter("spine"), left
        left = spines.count() if not last else 0
    out = [c.strip().split()[0] for c in NODE.split(",")][:8]
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    if len(done) > 1:
        ids = done[1]
        for more in done[2:]:
            ids = ids.unionByName(more)
        ids = ids.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("known"))
        waiting = nodes.filter("parent_path is not null").join(ids, "parent_path", "left")
        nodes = nodes.filter("parent_path is null").select(out).unionByName(
            waiting.withColumn("parent_conv_id", F.col("known")).select(out))
    return nodes.select(out)


def turn_code() -> F.Column:
    """40 hex digits of a turn: md5 of role and text, and the text's words."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lower(F.lpad(F.hex(words), 8, "0")))


def own_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, code): a conversation's turn codes in the order of `turn`, null first."""
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").alias("turn"), turn_code().alias("code")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["code"]), "").alias("code"))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) after the contract's rebuilding: the first turns come from the group's first."""
    own = materialize(own_paths(conversations), "turns")
    head = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.substring("code", 1, 3 * 2 * TURN).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int") * F.lit(2 * TURN)
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(head, "base", "left")
    code = F.concat(F.substr(F.coalesce("head", F.lit("")), F.lit(1), h), F.substr("code", h + 1))
    return joined.select("conv_id", F.unhex(code).alias("path"))


def op13(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
