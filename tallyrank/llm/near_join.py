"""Join of texts by Jaccard similarity of their word shingles, found with a MinHash LSH forest.

Every distinct text gets `trees` labels of `depth` minhash values. A tree is the trie of its
labels in sorted order; two texts meet in a node if their labels share that node's prefix. The
matched prefix is shortened from `depth`, one value at a time, until a pair that is just similar
enough is met in some tree with at least the target recall. The texts of one node are tied to
its smallest, which needs one row per text and tree, not per pair, and tied texts form candidate
groups. Inside a group every pair is verified on exact shingle sets: large groups are cut
into blocks and each pair of blocks is one small task, in which pairs are counted by matrix
products, and only each text's number of links and the smallest text it is connected to leave the
task.

Equal texts are one text throughout; the result repeats it for every document. A text with fewer
words than a shingle has one shingle, all its words; a text without words (null, empty) has no
links, but its copies share a class. A null id sorts first in a class. Repeated rows are copies.
An empty table gives no rows. Other columns are not read.

Cost: verification grows with the square of the number of *different* texts inside one candidate
group, spread over block pairs; copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import components, map_batches, text_key, texts_of, window_hashes, word_hashes
from tallyrank.session import materialize, release

THRESHOLD, SHINGLE = 0.8, 5
TREES, DEPTH, TARGET = 20, 6, 0.9995
BLOCK = 256


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(size, len(words))))


def recall(similarity: float, prefix: int, trees: int) -> float:
    """Chance that two texts share a prefix in at least one tree."""
    return 1 - (1 - similarity ** prefix) ** trees


def shortened(threshold: float, depth: int, trees: int, target: float) -> int:
    """The longest prefix that reaches the target recall at the threshold."""
    prefix = depth
    while prefix > 1 and recall(threshold, prefix, trees) < target:
        prefix -= 1
    return prefix


def _labels(sets: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 4096):
        low = np.minimum(low, (sets[at:at + 4096, None] * factors).min(axis=0))
    return ((low >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2")


def signatures(docs: DataFrame, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> DataFrame:
    """doc_id, key of the text, and its labels (binary, trees x depth x 2 bytes; null without words)."""
    def make():
        factors = np.random.default_rng(seed).integers(0, 1 << 63, trees * depth, np.uint64) * np.uint64(2) + np.uint64(1)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, shingle) for t in texts_of(batch)]
            labels = [_labels(s, factors).tobytes() if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.binary())],
                                              names=["doc_id", "key", "labels"])

        return work

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("key"), "text")
    return map_batches(rows, make, "doc_id bigint, key binary, labels binary")


def _ties(texts: DataFrame, trees: int, depth: int, prefix: int) -> DataFrame:
    """Candidate edges (a, b): every text of a trie node with the node's smallest text."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = texts.filter("labels is not null").select("cid", "labels", tree.alias("tree"))
    label = F.expr(f"substring(labels, tree * {2 * depth} + 1, {2 * prefix})")
    rows = rows.select("cid", F.xxhash64("tree", label).alias("node"))
    least = rows.groupBy("node").agg(F.min("cid").alias("b"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.join(least, "node").select(F.col("cid").alias("a"), "b").filter("a <> b").distinct()


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold (left x right, or left x left)."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = number[code[keep]], owner[keep]
    n, m = len(left), len(sets) - len(left)
    common = np.zeros((n, m or n), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = 4096
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(code, [at, at + step])
        has = np.zeros((len(sets), step), np.float32)
        has[owner[a:b], code[a:b] - at] = 1
        common += has[:n] @ (has[n:].T if m else has.T)
    union = size[:n, None] + (size[n:] if m else size)[None, :] - common
    found = (common >= threshold * union - 1e-6) & (common > 0)
    if not m:
        np.fill_diagonal(found, False)
    return found


def connected(found: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id among all that the found links connect, for rows and for columns."""
    of_row, of_col, none = rows.copy(), cols.copy(), np.iinfo(np.int64).max
    while True:
        new_row = np.minimum(of_row, np.where(found, of_col[None, :], none).min(axis=1))
        new_col = np.minimum(of_col, np.where(found, new_row[:, None], none).min(axis=0))
        if (new_row == of_row).all() and (new_col == of_col).all():
            return new_row, new_col
        of_row, of_col = new_row, new_col


def _verify(rows: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Rows (root, i, j, block, cid, text) of block pairs; gives (cid, links, peer)."""
    def pairs(group: dict[int, tuple[int, str]], i: int, j: int):
        sides = [[(c, shingles(t, shingle)) for c, (b, t) in sorted(group.items()) if b == k] for k in {i, j}]
        left, right = sides[0], sides[1] if len(sides) > 1 else None
        if not left or right == []:
            return []
        found = linked([s for _, s in left], [s for _, s in right] if right else None, threshold)
        rows = np.array([c for c, _ in left])
        cols = np.array([c for c, _ in right]) if right else rows
        of_row, of_col = connected(found, rows, cols)
        out = list(zip(rows.tolist(), found.sum(axis=1).tolist(), of_row.tolist()))
        if right:
            out += zip(cols.tolist(), found.sum(axis=0).tolist(), of_col.tolist())
        return [x for x in out if x[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = None, {}

        def result(rows_out):
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows_out)], names=["cid", "links", "peer"])

        for batch in batches:
            out = []
            for row in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                at = row[:3]
                if at != held:
                    if held:
                        out.extend(pairs(group, held[1], held[2]))
                    held, group = at, {}
                group[row[4]] = (row[3], row[5] or "")
            if out:
                yield result(out)
        if held:
            out = pairs(group, held[1], held[2])
            if out:
                yield result(out)

    ordered = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "cid")
    return ordered.select("root", "i", "j", "block", "cid", "text").mapInArrow(run, "cid bigint, links bigint, peer bigint")


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES,
                 depth: int = DEPTH, target: float = TARGET, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key of the text), and one row per distinct text: key; rep, its smallest id; root, the
    same for all texts that links connect; n_links, the other texts at the threshold."""
    rows = materialize(signatures(docs, shingle, trees, depth), "signatures")
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("labels").alias("labels"))
    texts = materialize(texts.withColumn("cid", F.monotonically_increasing_id()), "texts")
    ties = _ties(texts, trees, depth, shortened(threshold, depth, trees, target))
    tied = components(ties, "tied")
    groups = tied.select(F.col("node").alias("cid"), "root")
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = groups.join(sizes, "root").join(texts.select("cid", "key", "rep"), "cid")
    members = members.withColumn("block", F.pmod(F.hash("cid"), F.col("blocks")))
    source = docs.select(text_key().alias("_key"), F.col("doc_id").cast("bigint").alias("_doc"), "text")
    # a text is taken from the document that names it; rows that repeat that document are equal here
    found = source.join(members, (F.col("_key") == F.col("key")) & F.col("_doc").eqNullSafe(F.col("rep")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = found.select("root", "block", "cid", "text", other.alias("_o")).select(
        "root", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "cid", "text")
    verified = materialize(_verify(spread, threshold, shingle), "verified")
    links = verified.groupBy("cid").agg(F.sum("links").alias("n_links"))
    joined = components(verified.select(F.col("cid").alias("a"), F.col("peer").alias("b")), "linked")
    classes = texts.join(joined, texts["cid"] == joined["node"], "left").join(links, "cid", "left").select(
        "key", "rep", F.coalesce("root", "cid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = materialize(classes, "classes")
    release(rows, texts, tied, verified, joined)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("key")), classes


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES,
                 depth: int = DEPTH, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id; class_id, the smallest id among all texts that links connect;
    text_id, the smallest id with the same text; n_links, the other texts at the threshold."""
    rows, labelled = text_classes(docs, threshold, shingle, trees, depth, target, block)
    names = labelled.groupBy("root").agg(F.min("rep").alias("class_id"))
    labelled = labelled.join(names, "root")
    return rows.join(labelled, "key").select(
        "doc_id", "class_id", F.col("rep").alias("text_id"), "n_links")


def op10(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
