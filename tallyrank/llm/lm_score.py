"""N-gram scores from a weighted backoff automaton.

Words are runs of non-space after A-Z is lower-cased; every text ends with one end token.
Unigrams: add-half counts over all training texts, for every word that occurs anywhere.
Longer contexts: absolute discounting, interpolated with the next shorter context. Every context and
every arc that occurs in training is kept, down to a count of one; nothing is cut off. A context's
discounted mass goes to its failure arc, so every state's probabilities add up to one.

States are the contexts of at most two words. A state's arc consumes a word and leads to the
longest context behind it; where it has no arc for the word, its failure arc adds the backoff
weight and leads to the state with one word less, down to the root, which knows unigrams only. `Arcs`
holds the part of the automaton that a chunk's texts can reach, and `walk` reads every text from left
to right with one state, following arcs and failure arcs and adding up their weights. `Automaton` and
`traverse` are the same automaton held whole and walked word by word, for comparison.

Passes over the corpus: (1) tasks turn their texts into chunks of at most `chunk_tokens` tokens,
written as numbers of a chunk-local word list; (2) every chunk deals the keys of its distinct grams
of one to three words, with their training counts, to buckets by key, and each bucket answers with
the sum over all chunks; one asking chunk of each gram is its owner; grams of up to two words are
dealt first, those of three when what was shuffled for the others is gone; (3) owners count the arcs of
each context, and buckets by context add them up the same way; a context seen once has one arc and is
not asked for; (4) every chunk meets its answers, which are the arcs of its own contexts, and is
scored. No task holds more than a chunk or a bucket; buckets grow in number with the bytes of text, and
a gram has at most one entry per chunk. Neither the driver nor a broadcast holds any part of the model.

A gram's key is a 64-bit hash, of which seven bytes travel and the bucket stands for the rest; two of
10^8 grams share a key with a chance below 1 in 500, and would then share their count.

Null and empty texts are the end token alone. Repeated rows count and score each for itself. With
no training text (an empty table too) all counts are 0 and every token has the same probability.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import crc_mod, texts_of, word_hashes
from tallyrank.session import materialize

END = ""  # no word is empty
DISCOUNT = 0.75
CHUNK_TOKENS = 1_500_000
#: Bytes of text for each bucket of grams.
BUCKET_BYTES = 12_000_000
#: Tokens of a text that one step of the traversal takes at most: longer texts are walked from several places at once.
STRIDE = 512
#: Lower case for A-Z only, on bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

PART = "chunk bigint, docs array<bigint>, train binary, size binary, seq binary, keys binary, train_tokens bigint"
ASK = "bucket int, chunk bigint, words int, keys binary, n binary"
ANSWER = "bucket int, chunk bigint, words bigint, n binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_counts(counts: np.ndarray) -> bytes:
    """Numbers as planes of bytes, as many as the largest needs; high planes are nearly all zero."""
    width = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    return _packed(counts.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T.tobytes())


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), "u1")
    if n:
        planes = np.frombuffer(_unpacked(data), "u1").reshape(-1, n)
        out[:, :len(planes)] = planes.T
    return out.view("<i8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """The upper seven bytes of each key; its bucket tells as much as the eighth, or more."""
    return keys.astype("<u8").view("u1").reshape(-1, 8)[:, 1:].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), "u1")
    out[:, 1:] = np.frombuffer(data, "u1").reshape(-1, 7)
    return out.view("<u8").ravel()


def _fields(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def to_chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Rows of `docs` (doc_id, train, text) as chunks, one row each: ids, training marks and token counts
    of its texts, their tokens as numbers of the chunk's word list, and the hashes of that list;
    numbers go by falling frequency."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        numbers, held, size = defaultdict(count().__next__), [], 0  # a new word gets the next number

        def close():
            seq = np.concatenate([s for _, _, s in held])
            order = np.argsort(-np.bincount(seq, minlength=len(numbers)), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            sizes = np.array([len(s) for _, _, s in held], "<i8")
            train = np.array([t for _, t, _ in held], bool)
            row = [(part << 24) + seen, [d for d, _, _ in held], train.tobytes(), sizes.tobytes(), pack_counts(place[seq]),
                   word_hashes(list(numbers))[order].astype("<u8").tobytes(), int(sizes[train].sum())]
            kinds = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=_fields(PART))

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for doc, train, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts_of(some)):
                    words = words_of(text)
                    words.append(END.encode())
                    if held and size + len(words) > chunk_tokens:
                        yield close()
                        numbers, held, size, seen = defaultdict(count().__next__), [], 0, seen + 1
                    held.append((doc, train, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                    size += len(words)
        if held:
            yield close()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "train", "text").mapInArrow(run, PART)


def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of a gram from that of its context and that of its last word."""
    out = left * np.uint64(0x9E3779B97F4A7C15) + right
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _distinct(context: np.ndarray, word: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and last words of the distinct grams, and each position's gram."""
    codes, of = np.unique(context.astype(np.int64) * w + word, return_inverse=True)
    return (codes // w).astype(np.int32), (codes % w).astype(np.int32), of.astype(np.int32)


class Grams:
    """Distinct grams of a chunk: one word (numbers of its list), two and, if `third`, three words. `two`
    gives each token's gram with the word before it, `three` that with two words before it for tokens in
    `inner`, which are not the first of their text; `context_2` and `context_3` number a gram's context."""

    def __init__(self, row: dict, third: bool = True) -> None:
        self.keys_1 = np.frombuffer(row["keys"], "<u8")
        self.size = np.frombuffer(row["size"], "<i8")
        self.train = np.frombuffer(row["train"], bool)
        self.seq = unpack_counts(row["seq"], int(self.size.sum())).astype(np.int32)
        self.start = np.cumsum(self.size) - self.size
        w = len(self.keys_1)
        end = np.flatnonzero(self.keys_1 == word_hashes([END.encode()])[0])[:1].astype(np.int32)
        # grams do not run from one text into the next, but every text starts behind an end token
        self.before = np.concatenate([end, self.seq[:-1]])
        self.context_2, last, self.two = _distinct(self.before, self.seq, w)
        keys_2 = _key(self.keys_1[self.context_2], self.keys_1[last])
        self.short = np.concatenate([self.keys_1, keys_2])
        self.ends = np.cumsum([w, len(keys_2)])
        if third:
            inner = np.ones(len(self.seq), bool)
            inner[self.start] = False
            self.inner = np.flatnonzero(inner).astype(np.int32)
            self.context_3, last, self.three = _distinct(self.two[self.inner - 1], self.seq[self.inner], w)
            self.long = _key(keys_2[self.context_3], self.keys_1[last])

    def counts(self, third: bool) -> np.ndarray:
        """Training counts in the order of `long`, or of `short`."""
        t = np.repeat(self.train, self.size)
        if third:
            return np.bincount(self.three[t[self.inner]], minlength=len(self.long))
        return np.concatenate([np.bincount(g[t], minlength=n) for g, n in ((self.seq, len(self.keys_1)), (self.two, len(self.context_2)))])

    def drop_keys(self) -> None:
        """Once the answers are read only numbers count."""
        self.short = self.long = None

    def asked(self, total: np.ndarray) -> np.ndarray:
        """Contexts, as places in `short`, whose number of arcs is not known from their count alone."""
        return np.flatnonzero(total[:self.ends[1]] > 1)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket, and where each bucket starts in it."""
    bucket = (keys % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    at = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    return np.argsort(bucket, kind="stable").astype(np.int32), at


def _ask(chunk: int, keys: np.ndarray, n: np.ndarray, words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: keys and counts; the first `words` of the keys are words."""
    order, at = _dealt(keys, buckets)
    some = np.flatnonzero(np.diff(at)).tolist()
    for k in range(0, len(some), 16):
        mine = [order[at[b]:at[b + 1]] for b in some[k:k + 16]]
        yield pa.RecordBatch.from_arrays([
            pa.array(some[k:k + 16], pa.int32()), pa.array([chunk] * len(mine), pa.int64()),
            pa.array([int((o < words).sum()) for o in mine], pa.int32()),
            pa.array([pack_keys(keys[o]) for o in mine], pa.binary()),
            pa.array([pack_counts(n[o]) for o in mine], pa.binary())], names=_fields(ASK))


def _answer(rows: pa.Table) -> pa.Table:
    """Sums over the chunks that ask a bucket, doubled, plus 1 for the owner of a key; and the distinct words seen."""
    asked = sorted(zip(*[rows.column(c).to_pylist() for c in _fields(ASK)]))
    keys = [unpack_keys(k) for _, _, _, k, _ in asked]
    size = [len(k) for k in keys]
    n = np.concatenate([unpack_counts(r[4], m) for r, m in zip(asked, size)])
    _, first, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(of, n).astype(np.int64)[of]
    out = total * 2
    out[first] += 1
    end = np.cumsum(size)
    out = [out[e - m:e] for e, m in zip(end, size)]
    words = [int(((o[:r[2]] & 1) * (o[:r[2]] > 1)).sum()) for o, r in zip(out, asked)]
    return pa.table([pa.array([r[0] for r in asked], pa.int32()), pa.array([r[1] for r in asked], pa.int64()),
                     pa.array(words, pa.int64()), pa.array([pack_counts(o) for o in out], pa.binary())], names=_fields(ANSWER))


def _read(keys: np.ndarray, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
    """Answers in the order of the keys asked for."""
    order, at = _dealt(keys, buckets)
    out = np.zeros(len(keys), np.int64)
    for b, data in answers.items():
        some = order[at[b]:at[b + 1]]
        out[some] = unpack_counts(data, len(some))
    return out


def _answers(rows: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: n for k, b, n in zip(*[rows.column(c).to_pylist() for c in ("kind", "bucket", "n")]) if k == kind}


class Automaton:
    """Contexts of core words as states with arcs, and failure arcs to shorter contexts.

    `grams` maps (u, w) and (u, v, w), tuples of words, to counts; `unigrams` gives the counts of
    core words, `total` and `distinct` those of all tokens. A word's unigram probability is
    (c + 0.5) / (total + 0.5 * (distinct + 1)).
    """

    def __init__(self, unigrams: dict[bytes, int], grams: dict[tuple, int], total: int, distinct: int,
                 discount: float = DISCOUNT) -> None:
        self.norm = total + 0.5 * (distinct + 1)
        contexts: dict[tuple, list] = {}
        for g, c in grams.items():
            contexts.setdefault(g[:-1], []).append((g[-1], c))
        seen = {(w,): c for w, c in unigrams.items()} | {g: c for g, c in grams.items() if len(g) == 2}
        contexts = {h: arcs for h, arcs in contexts.items() if seen.get(h)}
        order = sorted(contexts, key=lambda h: (len(h), h))
        self.state = {(): 0} | {h: i + 1 for i, h in enumerate(order)}
        self.fail, self.back = [0], [0.0]
        self.arcs: dict[int, dict[bytes, tuple[int, float]]] = {}
        for h in order:
            n = seen[h]
            left = 1.0 - sum((c - discount) / n for _, c in contexts[h])
            lower = self.state.get(h[1:], 0)
            self.fail.append(lower)
            self.back.append(math.log10(left))
            mine = {}
            for w, c in contexts[h]:
                p = (c - discount) / n + left * self._prob(lower, w, unigrams)
                mine[w] = (self.target(h + (w,)), math.log10(p))
            self.arcs[self.state[h]] = mine
        self.start = self.target((END.encode(),))

    def target(self, gram: tuple) -> int:
        """The longest kept context that ends `gram`."""
        for k in range(max(0, len(gram) - 2), len(gram)):
            if gram[k:] in self.state:
                return self.state[gram[k:]]
        return 0

    def _prob(self, state: int, w: bytes, unigrams: dict[bytes, int]) -> float:
        log = 0.0
        while state:
            arc = self.arcs[state].get(w)
            if arc:
                return 10 ** (log + arc[1])
            log, state = log + self.back[state], self.fail[state]
        return 10 ** log * (unigrams.get(w, 0) + 0.5) / self.norm


def traverse(seq: list[int], start: int, arcs: dict[int, tuple[int, float]], width: int, fail: list[int],
             back: list[float], root: list[float], reach: list[int]) -> float:
    """Log10 probability of a sequence of word numbers; arcs are keyed by state * width + word."""
    score, s = 0.0, start
    for w in seq:
        while s:
            arc = arcs.get(s * width + w)
            if arc is not None:
                s = arc[0]
                score += arc[1]
                break
            score += back[s]
            s = fail[s]
        else:
            score += root[w]
            s = reach[w]
    return score


class Arcs:
    """The part of the automaton that a chunk's texts can reach, in arrays. State 0 is the root; state
    1 + w has seen word w, state 1 + words + g the two words of gram g. Arcs are numbered like the grams
    they consume: `arc_2` and `arc_3` are their weights (log10), `to_2` and `to_3` the states behind
    them, and an arc is there if its gram has a training count. `back` and `fail` are the weights and
    ends of failure arcs, `root` and `reach` the arcs of the root."""

    def __init__(self, g: Grams, total: np.ndarray, arcs: np.ndarray, norm: float, discount: float) -> None:
        one, two, three = np.split(total, g.ends)
        words = len(one)
        last_2, suffix = np.empty(len(two), np.int32), np.empty(len(three), np.int32)
        last_2[g.two] = g.seq
        suffix[g.three] = g.two[g.inner]
        state_1 = np.where(one > 0, 1 + np.arange(words), 0).astype(np.int32)
        state_2 = np.where(two > 0, 1 + words + np.arange(len(two)), state_1[last_2]).astype(np.int32)
        # weights of the failure arcs of contexts, 1 where there is no such state
        back = np.where(total[:g.ends[1]] > 0, discount * arcs / np.maximum(total[:g.ends[1]], 1), 1.0)
        back_1, back_2 = np.split(back, g.ends[:1])
        of = lambda c, n: np.maximum(c - discount, 0.0) * (c > 0) / np.maximum(n, 1)
        unigram = (one + 0.5) / norm
        p_2 = of(two, one[g.context_2]) + back_1[g.context_2] * unigram[last_2]
        p_3 = of(three, two[g.context_3]) + back_2[g.context_3] * p_2[suffix]
        with np.errstate(divide="ignore"):  # a context in which nothing was seen gives all its mass on; its weight is never 0
            self.back = np.log10(np.concatenate(([1.0], back)))
        self.fail = np.concatenate((np.zeros(1 + words, np.int32), state_1[last_2]))
        self.root, self.reach, self.words = np.log10(unigram), state_1, words
        self.arc_2, self.to_2, self.has_2 = np.log10(p_2), state_2, two > 0
        self.arc_3, self.to_3, self.has_3 = np.log10(p_3), state_2[suffix], three > 0
        self.seen = one


def walk(a: Arcs, g: Grams, stride: int = STRIDE) -> np.ndarray:
    """Log10 probability of every token of a chunk: each text is read from left to right by one state
    that follows arcs and failure arcs, all texts side by side. Two words always lead to one state,
    whatever came before, so a long text is also entered every `stride` tokens, two words early."""
    third = np.full(len(g.seq), -1, np.int32)
    third[g.inner] = g.three
    parts = np.maximum(1, -(-g.size // stride))
    text = np.repeat(np.arange(len(g.size)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = g.start[text] + nth * stride
    end = np.minimum(begin + stride, (g.start + g.size)[text])
    early = np.where(nth > 0, 2, 0)
    order = np.argsort(-(end - begin + early), kind="stable")
    begin, end, at = begin[order], end[order], (begin - early)[order]
    # behind an end token, or at the root where two words come first
    start = a.reach[g.before[0]] if len(g.before) else 0
    state = np.where(nth[order] > 0, 0, start)
    out = np.zeros(len(g.seq))
    active = len(at)
    while active:
        while active and at[active - 1] >= end[active - 1]:
            active -= 1
        pos, s = at[:active], state[:active]
        word, second = g.seq[pos], g.two[pos]
        score = np.zeros(active)
        deep = s > a.words
        hit_3 = deep & (third[pos] >= 0) & a.has_3[third[pos]] if len(a.has_3) else np.zeros(active, bool)
        score[hit_3] = a.arc_3[third[pos[hit_3]]]
        off = deep & ~hit_3
        score[off] += a.back[s[off]]
        s = np.where(off, a.fail[s], s)
        hit_2 = ~hit_3 & (s > 0) & a.has_2[second]
        score[hit_2] += a.arc_2[second[hit_2]]
        low = ~hit_3 & ~hit_2
        score[low] += a.back[s[low]] + a.root[word[low]]  # the root's own failure weight is 0
        state[:active] = np.where(hit_2, a.to_2[second], np.where(low, a.reach[word], 0))
        state[:active][hit_3] = a.to_3[third[pos[hit_3]]]
        own = pos >= begin[:active]
        out[pos[own]] = score[own]
        at[:active] += 1
    return out


def score_documents(docs: DataFrame, train: Column, discount: float = DISCOUNT, chunk_tokens: int = CHUNK_TOKENS,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", F.coalesce(train, F.lit(True)).alias("train"), "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // bucket_bytes))
    chunks = materialize(to_chunks(docs, chunk_tokens), "chunks")

    def ask_counts(third: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    g = Grams(row, third)
                    keys, counts, words = (g.long, g.counts(True), 0) if third else (g.short, g.counts(False), len(g.keys_1))
                    del g
                    yield from _ask(row["chunk"], keys, counts, words, buckets)

        return run

    def known(g: Grams, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _read(g.short, buckets, _answers(answers, 1)), _read(g.long, buckets, _answers(answers, 2))

    def ask_arcs(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        g = Grams(row)
        short, long = known(g, answers)
        owned = lambda got: (got & 1 > 0) & (got > 1)
        arcs = np.concatenate([np.bincount(g.context_2[owned(short[g.ends[0]:])], minlength=len(g.keys_1)),
                               np.bincount(g.context_3[owned(long)], minlength=len(g.context_2))])
        some, keys = g.asked(short >> 1), g.short
        kinds = pa.schema(list(zip(_fields(ASK), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))))
        del g, short, long
        return pa.Table.from_batches(_ask(row["chunk"], keys[some], arcs[some], 0, buckets), kinds)

    counts = []
    for third in (False, True):  # one after the other, so that less is under way at once
        asked = chunks.select("chunk", "seq", "keys", "size", "train").mapInArrow(ask_counts(third), ASK)
        counts.append(materialize(asked.groupBy("bucket").applyInArrow(_answer, ANSWER), "gram_counts"))
    total = int(chunks.agg(F.sum("train_tokens")).first()[0] or 0)
    distinct = int(counts[0].agg(F.sum("words")).first()[0] or 0)
    norm = total + 0.5 * (distinct + 1)
    of_chunk = lambda rows, kind: rows.select("chunk", F.lit(kind).alias("kind"), "bucket", "n")
    counted = of_chunk(counts[0], 1).unionByName(of_chunk(counts[1], 2))
    asked = chunks.select("chunk", "seq", "keys", "size", "train").groupBy("chunk").cogroup(
        counted.groupBy("chunk")).applyInArrow(ask_arcs, ASK)
    arcs = materialize(asked.groupBy("bucket").applyInArrow(_answer, ANSWER), "context_arcs")

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        g = Grams(row)
        n = np.concatenate(known(g, answers)) >> 1
        arcs, some = np.ones(g.ends[1], np.int64), g.asked(n)
        arcs[some] = _read(g.short[some], buckets, _answers(answers, 3)) >> 1
        g.drop_keys()
        a = Arcs(g, n, arcs, norm, discount)
        c, root, p = a.seen[g.seq], a.root[g.seq], walk(a, g)
        per_text = lambda x: pa.array(np.add.reduceat(x, g.start))
        return pa.table([pa.array(row["docs"], pa.int64()), pa.array(~g.train), pa.array(g.size),
                         per_text((c > 0).astype(np.int64)), per_text(root), per_text(p)], names=_fields(SCORED))

    answers = counted.unionByName(of_chunk(arcs, 3))
    scored = chunks.drop("train_tokens").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORED)
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, crc_mod("doc_id", 5) != 1).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
