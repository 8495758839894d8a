"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are one edit apart exactly when their common prefix and common suffix together reach the
longer word's length minus one. Words are laid out as padded code-point matrices, once from their
starts and once from their ends; a tile compares a block of rows with another one and reads both
lengths off the first column that differs.

Only blocks that can hold such a pair are compared. For a longer word of L code points the edit
lies in one of three segments of its places, and everything outside that segment is equal; so a
word is dealt, for L its own length and one more, by what lies outside of each segment (six rows a
word). A pair meets in each segment in which its edit could be placed, and is taken in the one
that holds the first difference. Groups of more than `block` words are dealt again by thirds of
their segment, until the segment is one place: such a group has a word per letter at most, so no
group stays large and none is cut.

Defined cases: null and empty texts have no words; a null id is written as nothing in the drawn
hash; repeated rows count each for itself; equal counts go to the word that comes first in
code-point order. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.session import materialize

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is this many times as frequent as its variant.
RATIO = 10
#: One run in so many loses a code point.
DRAWN = 31
#: Rows of a block, and words that a group may have. More than the letters of RUN, so that groups of one place end there.
TILE, BLOCK = 64, 512
#: Cells of one comparison.
CELLS = 1 << 22
RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words a task holds before it sends their counts on.
HELD = 200_000


def drawn_word(doc: str, run: str) -> str:
    """The lower-cased run, or what is left of it where the hash of document and run says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    at = h % len(run)
    return run if h % DRAWN else run[:at] + run[at + 1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text")):
            doc = doc.as_py()
            name = "" if doc is None else str(doc)
            runs: Counter[str] = Counter()
            for run, n in Counter(RUN.findall(text.as_py() or "")).items():
                runs[run.translate(LOWER)] += n
            for run, n in runs.items():
                word = drawn_word(name, run)
                if len(word) >= LEAST_LENGTH:
                    counts[word] += n
            if len(counts) >= HELD:
                yield out()
                counts.clear()
    if counts:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of enough code points and occurrences over whole texts."""
    counts = docs.select("doc_id", "text").mapInArrow(_count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _thirds(rows: DataFrame) -> DataFrame:
    """Every row once for each third of its segment [a, b) (each place, if it has fewer than three)."""
    width = F.col("b") - F.col("a")
    parts = F.least(width, F.lit(3))
    cut = lambda k: (F.col("a") + F.floor(k * width / parts)).cast("int")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumns({"a2": cut(F.col("k")), "b2": cut(F.col("k") + 1)})
    rows = rows.select("word", "n", "longer", F.col("a2").alias("a"), F.col("b2").alias("b"))
    after = F.col("longer") - F.col("b")
    outside = [F.substr("word", F.lit(1), F.col("a")), F.substr("word", F.length("word") - after + 1, after)]
    return rows.withColumn("key", F.xxhash64("longer", "a", "b", *outside))


def dealt(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, longer, a, b, word, n): rows of one key may hold pairs; no key has more than `block`
    rows unless its segment is a single place."""
    rows = words.withColumn("longer", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    rows = materialize(_thirds(rows.withColumns({"a": F.lit(0), "b": F.col("longer")})), "dealt")
    done = []
    while True:
        large = rows.filter("b - a > 1").groupBy("key").count().filter(F.col("count") > block).select("key")
        large = materialize(large, "large")
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = materialize(_thirds(rows.join(large, "key", "left_semi")), "dealt")
    for part in done:
        rows = rows.unionByName(part)
    return rows.select("key", "longer", "a", "b", "word", "n")


class Block:
    """Rows of a tile: padded code points from the start and from the end."""

    def __init__(self, rows: list[tuple]) -> None:
        self.key, self.longer, self.a, self.b, _, self.n = (np.array(c) if k != 4 else None for k, c in enumerate(zip(*rows)))
        self.word = [r[4] for r in rows]
        self.size = np.array([len(w) for w in self.word])
        self.width = int(self.size.max())
        codes = np.frombuffer("".join(self.word).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(np.arange(len(rows)), self.size)
        at = np.arange(len(codes)) - (np.cumsum(self.size) - self.size)[of]
        self.left, self.right = np.zeros((2, len(rows), self.width), np.uint32)
        self.left[of, at] = codes
        self.right[of, self.size[of] - 1 - at] = codes

    def padded(self, name: str, rows: np.ndarray, width: int) -> np.ndarray:
        m = getattr(self, name)[rows]
        return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def tile(x: Block, y: Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y that are one edit apart and have their first difference in their segment."""
    meet = (x.key[:, None] == y.key[None, :]) & (x.longer[:, None] == y.longer[None, :])
    meet &= np.maximum(x.size[:, None], y.size[None, :]) == x.longer[:, None]
    if x is y:
        meet = np.triu(meet, 1)
    i, j = np.nonzero(meet)
    width = max(x.width, y.width)
    near = np.zeros(len(i), bool)
    step = max(1, CELLS // width)
    for at in range(0, len(i), step):
        p, q = i[at:at + step], j[at:at + step]
        prefix, suffix = ((x.padded(side, p, width) == y.padded(side, q, width)) for side in ("left", "right"))
        same = prefix.all(axis=1)
        prefix, suffix = prefix.argmin(axis=1), suffix.argmin(axis=1)
        near[at:at + step] = ~same & (prefix + suffix >= x.longer[p] - 1) & (prefix >= x.a[p]) & (prefix < x.b[p])
    return i[near], j[near]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held, cells = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and (len(held) >= TILE or cells + len(row[4]) > CELLS // 4):
                yield Block(held)
                held, cells = [], 0
            held.append(row)
            cells += len(row[4])
    if held:
        yield Block(held)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows against themselves and the earlier ones in which their first key began."""
    open_: list[Block] = []
    for y in _blocks(batches):
        while open_ and (open_[0].key[-1], open_[0].longer[-1]) != (y.key[0], y.longer[0]):
            open_.pop(0)
        columns: list[list] = [[], [], [], []]
        for x in [*open_, y]:
            for i, j in zip(*tile(x, y)):
                for c, v in zip(columns, (x.word[i], y.word[j], x.n[i], y.n[j])):
                    c.append(v)
        u, v, m, n = columns
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u + v), pa.array(v + u), pa.array(np.array(n + m, np.int64))], names=["word", "near", "near_n"])
        open_.append(y)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every ordered pair of `words` (word, n) that is one edit apart, once."""
    rows = dealt(words, block)
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key").sortWithinPartitions("longer", "key")
    return rows.mapInArrow(_tiles, "word string, near string, near_n long")


def variant_groups(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n). Counts grow by `ratio` with every form, so a chain is
    no longer than their logarithm and pointer doubling ends after a few joins."""
    words = materialize(words.select("word", "n"), "words")
    near = near_words(words, block).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    good = -F.col("best.n") >= ratio * F.col("n")
    out = materialize(words.join(near, "word", "left").select(
        "word", F.when(good, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, -F.col("best.n")).alias("form_n")), "forms")
    roots = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    return variant_groups(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))
