"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items and texts are normalised alike: A-Z to lower case, and words are runs of digits, letters
and anything outside ASCII. Every run of `window` item words, or the whole of a shorter item, is
a pattern; each text is scanned once and hits are mapped back to character offsets of the
original. Normalising replaces bytes one for one, so a byte of the normal form is the same byte
of the original.

The automaton is built from patterns of at most `pattern_bytes`; a larger benchmark is cut into
several automata of that size, which scan one after the other with the same result.

Null and empty texts have no words and no hits. Items without words have no pattern; a null item
id is left out of the items but its windows still hit. Repeated rows give repeated results, and
repeated items count once. Only the named text column is read, and results come in one struct, so
no column of the input clashes.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import fresh
from tallyrank.session import materialize

WINDOW = 10
PATTERN_BYTES = 32 << 20
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Byte by byte: word bytes stay (upper case lowered), all else becomes a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _WORD else 32 for c in range(256))
RESULT = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<begin: int, end: int>>>"

_built: dict[str, ahocorasick.Automaton] = {}


def normal_words(text: str | None) -> list[str]:
    """Words, each as its UTF-8 bytes read as Latin-1: one character per byte."""
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).decode("latin-1").split(" ")


def item_windows(items: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (pattern, item): patterns are words joined, led and followed by one space."""
    kind = pa.list_(pa.string())

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            words = [w for w in normal_words(t) if w]
            last = max(0, len(words) - window)
            out.append(sorted({" " + " ".join(words[i:i + window]) + " " for i in range(last + 1)}) if words else [])
        return pa.array(out, kind)

    rows = items.select(F.col(item).cast("string").alias("item"), cut(F.col(text)).alias("w"))
    return rows.select("item", F.explode("w").alias("pattern")).distinct()


def _automaton(key: str, patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    if key not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for p, items in patterns:
            made.add_word(p, (p.count(" ") - 1, tuple(items)))
        if patterns:
            made.make_automaton()
        _built[key] = made
    return _built[key]


def scan(made: ahocorasick.Automaton, text: str | None) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """Words, hit words, items, and hit spans as character offsets of `text`."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = [w for w in raw.translate(NORMAL).decode("latin-1").split(" ") if w]
    if not words or not len(made):
        return len(words), 0, [], []
    hits = list(made.iter(" " + " ".join(words) + " "))
    if not hits:
        return len(words), 0, [], []
    ends = np.cumsum([len(w) + 1 for w in words])  # where the space behind each word stands
    change, items = np.zeros(len(words) + 1, np.int64), set()
    for at, (n, names) in hits:
        last = int(np.searchsorted(ends, at))
        change[last - n + 1] += 1
        change[last + 1] -= 1
        items.update(names)
    hit = np.cumsum(change[:-1]) > 0
    return len(words), int(hit.sum()), sorted(items), _spans(raw, hit)


def _spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], np.frombuffer(raw.translate(NORMAL), np.uint8) != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters before each byte
    turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(chars[starts[a]]), int(chars[stops[b - 1]])) for a, b in zip(turn[::2], turn[1::2])]


def _scanner(patterns: list[tuple[str, list[str]]], spark) -> Column:
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(patterns)

    @F.arrow_udf(RESULT)
    def find(texts: pa.Array) -> pa.Array:
        made = _automaton(key, sent.value)
        rows = (scan(made, t.as_py()) for t in texts)
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                          ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])
        return pa.array([{"n_words": n, "n_hit": h, "items": i, "spans": [{"begin": a, "end": b} for a, b in s]}
                         for n, h, i, s in rows], kind)

    return find


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text",
                       result: str = "contamination", pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """`docs` with one struct column: n_words, n_hit, items (sorted as strings), spans."""
    spark = docs.sparkSession
    patterns = materialize(item_windows(items, window).groupBy("pattern").agg(
        F.array_sort(F.collect_set("item")).alias("items")), "patterns")
    size = patterns.agg(F.sum(F.length("pattern") + 8 * F.size("items"))).first()[0] or 0
    shards = max(1, math.ceil(size / pattern_bytes))
    part = F.pmod(F.xxhash64("pattern"), F.lit(shards))
    load = lambda k: [(p, i) for p, i in patterns.filter(part == k).collect()]  # noqa: E731  at most pattern_bytes or so
    out = docs.withColumn(result, _scanner(load(0), spark)(F.col(text)))
    more = fresh(out, "_more")
    for k in range(1, shards):
        out = materialize(out, "scanned").withColumn(more, _scanner(load(k), spark)(F.col(text)))
        out = out.withColumn(result, F.arrow_udf(_merged, RESULT)(F.col(text), F.col(result), F.col(more))).drop(more)
    return out


def _words_in(text: str, span: dict) -> list[str]:
    return [w for w in normal_words(text[span["begin"]:span["end"]]) if w]


def _merged(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Hits of two automata over the same texts; spans are joined where they overlap, and words
    hit by both count once."""
    rows = []
    for text, x, y in zip(texts.to_pylist(), a.to_pylist(), b.to_pylist()):
        spans = []
        for s in sorted(x["spans"] + y["spans"], key=lambda s: (s["begin"], -s["end"])):
            if spans and s["begin"] <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], s["end"])
            else:
                spans.append(dict(s))
        rows.append({"n_words": x["n_words"], "n_hit": sum(len(_words_in(text, s)) for s in spans),
                     "items": sorted({*x["items"], *y["items"]}), "spans": spans})
    return pa.array(rows, a.type)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"),
        items_digest(c["items"]).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))

