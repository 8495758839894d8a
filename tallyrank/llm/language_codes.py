"""Language identification by error-correcting output codes.

Every language gets a codeword of plus and minus ones: all the ways to halve the languages while
there are at most seven (each a bit), seeded random words with the largest least distance beyond
that. One linear classifier a bit reads the shares of hashed letter n-grams (one to three letters,
words bounded by a mark) and is fitted in numpy on a bounded sample of labelled rows (`most`, in
equal numbers of each language, each with its whole text and a fragment of it). A fifth of the
sample is held back to choose the epoch and to learn how far each bit can be trusted for each
language; decoding adds up every bit's logistic loss against a codeword, weighted by that trust,
and takes the nearest codeword. `score` is the share of the nearest one among all (losses turned
into shares at a temperature fitted on the held-back rows), `ambiguous` marks texts whose second
codeword is nearly as near.

Texts without a letter, empty or null, are `und` with score 1. Where no language can be learned,
all are `und` with score 0; with one language, all others are that one. Null languages teach
nothing; repeated rows of the sample count once, in scoring each counts for itself. An empty table
gives no rows. Whole texts are read, in slices of bounded size. Other columns are not read.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import crc_mod, fresh, text_key

#: Hash rows that all n-grams share.
ROWS = 1 << 15
#: Labelled texts that the classifiers are fitted on, at most.
MOST = 1200
#: Letters of the fragment that every sampled text adds.
FRAGMENT = 40
#: Code points read at once.
SLICE = 1 << 18
#: Nearest codewords closer than this in share are ambiguous.
CLOSE = 0.2
FEATURES = "lang string, rows array<int>, shares array<float>"
#: Odd multipliers of the hash.
MIX = tuple(np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1, one a row."""
    if k <= 7:
        halves = [h for h in itertools.product((1, -1), repeat=k - 1) if -1 in h]
        return np.array([(1,) + h for h in halves], np.int8).T.reshape(k, -1)
    bits, best = int(np.ceil(10 * np.log2(k))), (-1, None)
    for seed in range(32):
        code = np.random.default_rng(seed).choice(np.array([1, -1], np.int8), (k, bits))
        apart = (bits - code.astype(np.int32) @ code.T) // 2
        np.fill_diagonal(apart, bits)
        split = np.abs(code.sum(axis=0, dtype=np.int64)).max() < k
        if split and apart.min() > best[0]:
            best = (int(apart.min()), code)
    return best[1] if best[1] is not None else code


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def marked(text: str) -> np.ndarray:
    """Lower-cased letters as code points, every other stretch as one 0, and a 0 at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, 0).astype(np.uint32)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash rows of the n-grams of `marked` letters, and the place where each begins. A mark alone is
    none, and none reaches over two marks: there one text ends and the next begins."""
    shift = np.uint32(32 - (ROWS.bit_length() - 1))
    out, place = [], []
    mixed = np.zeros(len(codes), np.uint32)
    joined = (codes[1:] | codes[:-1]) != 0
    for k in range(1, 4):
        n = len(codes) - k + 1
        if n <= 0:
            break
        mixed = (mixed[:n] ^ codes[k - 1:]) * MIX[k - 1]
        mixed ^= mixed >> np.uint32(15)
        at = np.flatnonzero(codes if k == 1 else joined if k == 2 else joined[1:] & joined[:-1])
        out.append((mixed[at] * MIX[0]) >> shift)
        place.append(at)
    return (np.concatenate(out), np.concatenate(place)) if out else (np.empty(0, np.uint32), np.empty(0, np.int64))


def slices(text: str) -> Iterator[str]:
    """A text in parts that end where a word does, if a space comes early enough."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.rfind(" ", at + SLICE // 2, at + SLICE)
        cut = at + SLICE if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash rows of a text's n-grams and the share of each."""
    total = np.zeros(ROWS)
    for part in slices(text):
        total += np.bincount(ngrams(marked(part))[0], minlength=ROWS)
    used = np.flatnonzero(total)
    return used.astype(np.int32), (total[used] / max(1.0, total.sum())).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            text = text.as_py()
            middle = text[len(text) // 3:][:FRAGMENT]
            found = [shares(t) for t in {text, middle}]
            found = [f for f in found if len(f[0])]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(found)), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                     pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["lang", "rows", "shares"])


def language_sample(docs: DataFrame, train: Column, most: int = MOST) -> DataFrame:
    """(lang, rows, shares) of at most `most` distinct training texts, in about equal numbers of each
    language, drawn by a hash of the row. Only features, at most ROWS numbers a text, reach the driver."""
    rows = docs.filter(train & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    # a number per language; the model's codewords are as many
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.select("lang", "text").mapInArrow(_features, FEATURES)
    part = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, n * len(sizes) / most)])
    draw = F.pmod(F.xxhash64("doc_id", "lang", text_key()), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # drawn before anything moves: only the sample is shuffled
    rows = rows.withColumn("draw", draw * F.element_at(part, F.col("lang"))).filter("draw < 1.5")
    rows = rows.groupBy("doc_id", "lang", "text").agg(F.min("draw").alias("draw"))
    rows = rows.orderBy("draw", "doc_id", "lang", "text").limit(most)
    return rows.select("lang", "text").mapInArrow(_features, FEATURES)


class Codes:
    """Classifiers of all bits (`weights`, rows by bits; `offset`), codewords, trust and temperature."""

    def __init__(self, langs: list[str], y: np.ndarray, rows: list[np.ndarray], part: list[np.ndarray],
                 epochs: int = 40, seed: int = 3, rate: float = 1.0, decay: float = 1e-7) -> None:
        self.langs, self.code = langs, codewords(len(langs))
        bits = self.code.shape[1]
        flat, share = np.concatenate(rows), np.concatenate(part)[:, None]
        first = np.cumsum([0] + [len(r) for r in rows])[:-1]
        by_row = np.argsort(flat, kind="stable")
        used, used_at = np.unique(flat[by_row], return_index=True)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        want = self.code[y].astype(np.float32)
        rng = np.random.default_rng(seed)
        back = rng.random(len(rows)) < 0.2
        weight = (1.0 / np.bincount(y, minlength=len(langs)))[y]
        weight = (np.where(back, 0, weight) / max(weight[~back].sum(), 1e-9)).astype(np.float32)[:, None]
        w, offset = np.zeros((ROWS, bits), np.float32), np.zeros(bits, np.float32)
        state, state_o, best = np.full((ROWS, bits), 1e-12, np.float32), np.full(bits, 1e-8, np.float32), (np.inf, w, offset)
        for epoch in range(epochs):
            margin = np.add.reduceat(w[flat] * share, first, axis=0) + offset
            if epoch % 10 == 9 and back.any():
                loss = float(np.logaddexp(0, -want[back] * margin[back]).mean())
                if loss < best[0]:
                    best = (loss, w.copy(), offset.copy())
            e = -want / (1 + np.exp(np.clip(want * margin, -30, 30))) * weight
            g = np.add.reduceat((e[of] * share)[by_row], used_at, axis=0) + decay * w[used]
            state[used] += g * g
            state_o += e.sum(axis=0) ** 2
            w[used] -= rate * 40 * g / np.sqrt(state[used])
            offset -= 0.1 * rate * e.sum(axis=0) / np.sqrt(state_o)
        if best[0] < np.inf:
            _, w, offset = best
        self.weights, self.offset = w, offset
        check = back if back.any() else ~back
        margin = (np.add.reduceat(w[flat] * share, first, axis=0) + offset)[check]
        right = want[check] * margin > 0
        self.trust = np.array([(right[y[check] == k].sum(axis=0) + 1) / ((y[check] == k).sum() + 2) for k in range(len(langs))])
        self.trust /= self.trust.sum(axis=1, keepdims=True)
        losses = self.losses(margin)
        fits = [(float(-np.log(self.closeness(losses, t)[np.arange(len(losses)), y[check]].clip(1e-9)).mean()), t) for t in (1, 2, 4, 8, 16, 32, 64)]
        self.heat = min(fits)[1]

    def losses(self, margin: np.ndarray) -> np.ndarray:
        """The weighted logistic loss of every row's margins against every codeword."""
        return np.stack([(np.logaddexp(0, -margin * c) * t).sum(axis=1) for c, t in zip(self.code, self.trust)], axis=1)

    @staticmethod
    def closeness(losses: np.ndarray, heat: float) -> np.ndarray:
        e = np.exp(-heat * (losses - losses.min(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margins of all bits, and whether a text has a letter. Texts are read together, in slices."""
        total, count = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def read() -> None:
            nonlocal held, owner, size
            if not held:
                return
            starts = np.cumsum([0] + [len(h) for h in held])
            rows, place = ngrams(np.concatenate(held))
            part = np.searchsorted(starts, place, side="right") - 1
            order = np.array(owner)
            # n-grams of one length lie in order of place, so equal owners lie together in each third
            edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            np.add.at(total, order[part[edge]], np.add.reduceat(self.weights[rows], edge, axis=0))
            np.add.at(count, order[part[edge]], np.diff(np.append(edge, len(rows))))
            held, owner, size = [], [], 0

        letter = np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            for part in slices(text):
                codes = marked(part)
                letter[k] |= bool(codes.any())
                held.append(codes)
                owner.append(k)
                size += len(codes)
                if size >= SLICE:
                    read()
        read()
        return total / np.maximum(count, 1)[:, None] + self.offset, letter

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        margin, letter = self.margins(texts)
        near = self.closeness(self.losses(margin), self.heat)
        best = near.argmax(axis=1)
        top = np.sort(near, axis=1)
        close = top[:, -1] - top[:, -2] < CLOSE
        langs = [self.langs[b] if found else "und" for b, found in zip(best.tolist(), letter.tolist())]
        return langs, np.where(letter, top[:, -1], 1.0), close & letter


class Single:
    """One language, or none."""

    def __init__(self, lang: str | None) -> None:
        self.lang = lang

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        found = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        langs = [self.lang if self.lang is not None and f else "und" for f in found]
        return langs, np.where(found & (self.lang is None), 0.0, 1.0), np.zeros(len(texts), bool)


def fit_languages(docs: DataFrame, train: Column, most: int = MOST) -> Codes | Single:
    sample = language_sample(docs, train, most).toArrow()
    langs = sorted(set(sample.column("lang").to_pylist()))
    if len(langs) < 2:
        return Single(langs[0] if langs else None)
    number = {name: k for k, name in enumerate(langs)}
    y = np.array([number[x] for x in sample.column("lang").to_pylist()])
    rows = [r.values.to_numpy() for r in sample.column("rows")]
    part = [r.values.to_numpy() for r in sample.column("shares")]
    order = sorted(range(len(y)), key=lambda k: (y[k], len(rows[k]), rows[k].tobytes(), part[k].tobytes()))
    return Codes(langs, y[order], [rows[k] for k in order], [part[k] for k in order])


_models: dict[str, Codes | Single] = {}


def predict_languages(docs: DataFrame, model: Codes | Single, result: str = "language") -> DataFrame:
    """`docs` with a struct (lang_pred, score, ambiguous) for `text`, under a name that is free."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def score(texts: pa.Array) -> pa.Array:
        if key not in _models:
            _models.clear()
            _models[key] = shared.value
        langs, near, close = _models[key].predict([t or "" for t in texts.to_pylist()])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(near, pa.float64()), pa.array(close, pa.bool_())],
                                          names=["lang_pred", "score", "ambiguous"])

    predict = F.arrow_udf(score, "lang_pred string, score double, ambiguous boolean")
    return docs.withColumn(fresh(docs, result), predict(F.col("text")))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = crc_mod("doc_id", 4)
    model = fit_languages(docs, fold != 2)
    found = predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")
