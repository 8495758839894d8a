"""Passages that repeat across or within documents, located with sharded Aho-Corasick automata.

A window is 35 consecutive words; a word is removed if it lies in a window whose words also start
anywhere else. Windows are judged on the input.

1. Candidates. In every window the run of `gram` words with the smallest hash is its anchor. Equal
   windows have equal anchors, so a window whose anchor occurs once in the corpus cannot repeat.
   Anchors (about 2 in 30 positions) are counted.
2. Contexts. Around every recurring anchor the words of all windows that it anchors are cut out:
   one context of fewer than 2 * 35 words. Equal contexts are counted, so a passage with many
   copies becomes one row. An anchor with more than `hot` places hands out its windows one by one
   instead, so no shard gathers the surroundings of a very common phrase.
3. Shards. Contexts meet by anchor. A shard takes anchors until it holds `shard_words` words,
   confirms the windows that occur twice (on their words), compiles them into one automaton with
   pyahocorasick over symbols of words, and streams its contexts through it: every occurrence of every
   confirmed window is located.
4. Places go back to the texts, where their words are cut out.

Equal texts are looked at once, with their number of copies. Null and empty texts have no words and
stay as they are. A text shorter than a window is never changed. A null id is kept. Repeated rows
are copies of each other, so their windows repeat. An empty table gives no rows. Only the id and
text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import count, product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import fresh, list_column, map_batches, text_key, texts_of, window_hashes, word_hashes
from tallyrank.session import materialize, owner_of, release, scratch_of

WINDOW, GRAM = 35, 8
HOT, SHARD_WORDS = 5000, 200_000
#: Words of a symbol of the automaton, less where a window is no multiple of it, and letters of an alphabet.
STEP, BASE = 7, 128
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def anchors_of(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash and place of each anchor, and the first and last window it anchors."""
    if len(words) < window:
        none = np.empty(0, np.int64)
        return none, none, none, none
    grams = window_hashes(word_hashes(words), gram)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    place = np.arange(len(view)) + view.argmin(axis=1)  # never moves back, so windows of an anchor are a run
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    return grams[at].astype(np.int64), at, first, last


def _profile(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, sha, hashes, places = [], [], [], []
            for text in texts_of(batch):
                words = text.encode("utf-8", "surrogatepass").split()
                h, at, _, _ = anchors_of(words, window, gram)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                hashes.append(h)
                places.append(at)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha), list_column(hashes, np.int64),
                 list_column(places, np.int32)], names=["doc_id", "key", "n_words", "sha", "anchors", "places"])

        return work

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("key"), "text")
    return map_batches(rows, make, "doc_id bigint, key binary, n_words bigint, sha string, anchors array<bigint>, places array<int>")


def _short(key: str):
    """64 bits of a key, for steps where a clash only adds places to look at."""
    return F.xxhash64(key)


def _contexts(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Contexts of the recurring anchors of each text: key, lo (its first word), a, h (hashes of
    the anchor and of the context) and the context. A negative place belongs to a hot anchor."""
    def make():
        import xxhash

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(6)]
            for key, m, places, text in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                words = text.encode("utf-8", "surrogatepass").split()
                cold = {p for p in places if p >= 0}
                hot = {-p - 1 for p in places if p < 0}
                for a, at, first, last in zip(*(x.tolist() for x in anchors_of(words, window, gram))):
                    if at in cold:
                        cuts = [(first, last, a)]
                    elif at in hot:
                        cuts = [(s, s, None) for s in range(first, last + 1)]
                    else:
                        continue
                    for lo, hi, own in cuts:
                        context = b" ".join(words[lo:hi + window])
                        h = xxhash.xxh3_64_intdigest(context, 1)
                        own = own if own is not None else np.uint64(xxhash.xxh3_64_intdigest(context, 2)).astype(np.int64).item()
                        for col, v in zip(out, (key, lo, own, h - (1 << 64) if h >> 63 else h, context, m)):
                            col.append(v)
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                              names=["key", "lo", "a", "h", "context", "m"])

        return work

    return map_batches(texts.select("key", "m", "places", "text"), make,
                       "key binary, lo int, a bigint, h bigint, context binary, m bigint", rows=200)


class _Names(dict):
    """The next of `names` for every key that is new."""

    def __init__(self, names: Iterator[str]):
        self.names = names

    def __missing__(self, key) -> str:
        name = self[key] = next(self.names)
        return name


def _symbols() -> Iterator[str]:
    """Symbols of three letters, each from an alphabet of its own: equal letters stand at equal places of
    their symbols, and no state of an automaton has more than BASE followers."""
    return map("".join, product(*[[chr(k * BASE + i) for i in range(BASE)] for k in range(3)]))


def locate(contexts: list[tuple[bytes, int]], window: int) -> list[list[tuple[int, int]]]:
    """For each (context, times) the word ranges covered by windows found at least twice.

    A symbol stands for a run of `step` words, so a window is window / step symbols, and a context is read
    once from each of its first `step` places. That makes fewer states than a symbol for each word, and
    finds the same windows.
    """
    step = max(s for s in range(1, STEP + 1) if window % s == 0)
    size = 3 * (window // step)
    numbers, runs = _Names(map(chr, count())), _Names(_symbols())
    lines = []
    for context, _ in contexts:
        line = "".join(map(numbers.__getitem__, context.split()))
        symbols = list(map(runs.__getitem__, [line[i:i + step] for i in range(len(line) - step + 1)]))
        lines.append(["".join(symbols[r::step]) for r in range(min(step, len(line) - window + 1))])
    del numbers, runs
    times: dict[str, int] = {}
    for line, (_, m) in zip(lines, contexts):
        for own in line:
            for i in range(0, len(own) - size + 1, 3):
                w = own[i:i + size]
                times[w] = times.get(w, 0) + m
    confirmed = [w for w, m in times.items() if m > 1]
    del times
    if not confirmed:
        return [[] for _ in lines]
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in confirmed:
        found.add_word(w)
    found.make_automaton()
    out = []
    for line in lines:
        starts = sorted((end + 1 - size) // 3 * step + r for r, own in enumerate(line) for end, _ in found.iter(own))
        ranges: list[list[int]] = []
        for start in starts:
            if ranges and start <= ranges[-1][1]:
                ranges[-1][1] = start + window
            else:
                ranges.append([start, start + window])
        out.append([(a, b) for a, b in ranges])
    return out


def _located(contexts: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Distinct contexts (a, h, context, m) by anchor; gives (a, h, ranges) of those with a find."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, last = [], 0, None

        def close():
            rows = [(a, h, [x for r in found for x in r]) for (a, h, _, _), found in
                    zip(held, locate([(c, m) for _, _, c, m in held], window)) if found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(
                    zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["a", "h", "ranges"])

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if words >= shard_words and row[0] != last:
                    yield from close()
                    held, words = [], 0
                held.append(row)
                last, words = row[0], words + 2 * window
        if held:
            yield from close()

    ordered = contexts.repartition("a").sortWithinPartitions("a", "h")
    return ordered.select("a", "h", "context", "m").mapInArrow(run, "a bigint, h bigint, ranges array<int>")


def _edit(texts: DataFrame) -> DataFrame:
    """Texts with the words of their ranges cut out."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(4)]
            for key, ranges, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                raw = text.encode("utf-8", "surrogatepass")
                spans = [m.span() for m in _WORD.finditer(raw)]
                turn = np.zeros(len(spans) + 1, np.int64)
                for r in ranges:
                    turn[r["begin"]] += 1
                    turn[r["end"]] -= 1
                gone = np.cumsum(turn[:-1]) > 0
                kept = [raw[a:b] for (a, b), g in zip(spans, gone) if not g]
                # each run of removed words goes with the space behind it
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                parts, at = [], 0
                for s, e in zip(edges[::2], edges[1::2]):
                    parts.append(raw[at:spans[s][0]])
                    at = spans[e][0] if e < len(spans) else len(raw)
                parts.append(raw[at:])
                for col, v in zip(out, (key, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(),
                                        b"".join(parts).decode("utf-8", "surrogatepass"))):
                    col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                out, (pa.binary(), pa.int64(), pa.string(), pa.string()))], names=["key", "n_removed", "kept_sha256", "text"])

        return work

    return map_batches(texts.select("key", "ranges", "text"), make, "key binary, n_removed bigint, kept_sha256 string, text string")


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT,
                 shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, n_words, sha of all words joined) and, by `key`, the texts that change:
    n_removed, kept_sha256, text."""
    profile = materialize(_profile(docs, window, gram), "profile")
    places = profile.select(_short("key").alias("k"), F.explode(F.arrays_zip("anchors", "places")).alias("x"))
    places = places.select("k", F.col("x.anchors").alias("a"), F.col("x.places").alias("at"))
    # written, so that the join below has a plain exchange on either side and a hot anchor can be split
    again = materialize(places.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "recurring")
    marked = F.when(F.col("n") > hot, -F.col("at") - 1).otherwise(F.col("at"))
    suspects = places.join(again, "a").groupBy("k").agg(F.collect_set(marked).alias("places"))
    copies = profile.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    suspects = suspects.join(copies.withColumn("k", _short("key")), "k")
    source = docs.select(text_key().alias("_key"), F.col("doc_id").cast("bigint").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    texts = source.join(suspects, (F.col("_key") == F.col("key")) & F.col("_doc").eqNullSafe(F.col("rep")))
    texts = materialize(texts.select("key", "m", "places", "text"), "suspect_texts")
    contexts = materialize(_contexts(texts, window, gram), "contexts")
    distinct = contexts.groupBy("a", "h", "context").agg(F.sum("m").alias("m"))
    located = _located(distinct, window, shard_words)
    at = F.expr("transform(sequence(0, int(size(ranges) / 2) - 1), i -> struct(lo + ranges[2 * i] as begin, lo + ranges[2 * i + 1] as end))")
    ranges = contexts.select("key", "lo", "a", "h").join(located, ["a", "h"]).select("key", F.explode(at).alias("r"))
    ranges = ranges.groupBy("key").agg(F.collect_set("r").alias("ranges"))
    edits = _edit(texts.dropDuplicates(["key"]).join(ranges, "key"))
    edits = materialize(edits, "edits")
    release(again, texts, contexts)
    return owner_of(profile.select("doc_id", "key", "n_words", "sha"), *scratch_of(profile)), edits


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the repeated passages cut out of their texts; all rows and columns stay."""
    profile, edits = find_repeats(docs, **options)
    release(profile)
    own, key, new = (fresh(docs, c) for c in ("_own_key", "_edit_key", "_edit_text"))
    edits = edits.select(F.col("key").alias(key), F.col("text").alias(new))
    joined = docs.withColumn(own, text_key()).join(edits, F.col(own) == F.col(key), "left")
    return joined.withColumn("text", F.coalesce(new, "text")).select(docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    profile, edits = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = profile.join(edits.drop("text"), "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
                      F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
