import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import lm_score, outliers, quality_model, sharding, toxicity
from tallyrank.llm.common import crc_mod

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(t):
    w = WORD.findall(t or "")
    wins = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = {i + k for i in range(len(w) - 4) if wins[tuple(w[i:i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(rep)


def test_statistics(docs):
    texts = [r["text"] for r in docs.collect()] + ["a\nb\na\n\n \na", "a b c d e a b c d e", "# é*\x0b|\x1c<"]
    for t in texts:
        assert outliers.statistics(t)[:5] == brute_stats(t)


def test_outliers(clashing, empty):
    rows = {(r["doc_id"], r["n_words"]): r for r in outliers.judge(clashing, least=20).collect()}
    assert sum(1 for _ in rows) >= clashing.select("doc_id").distinct().count()
    for r in rows.values():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert outliers.judge(empty).collect() == []


def test_mcd_ignores_a_tenth_of_outliers(spark):
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (900, 6)), rng.normal(9, 1, (100, 6))
    rows = spark.createDataFrame([("c", *map(float, x)) for x in np.vstack([good, bad])], "cell string, " + ", ".join(f"x{i} double" for i in range(6)))
    e = outliers.mcd(rows, floor=0.01).first()
    assert np.abs(e["center"]).max() < 0.3
    inv = np.array(e["inverse"]).reshape(6, 6)
    d = np.einsum("ij,jk,ik->i", np.vstack([good, bad]) - e["center"], inv, np.vstack([good, bad]) - e["center"]) / e["scale"]
    assert (d[900:] > 30).all() and np.mean(d[:900] > 30) < 0.01


def test_outliers_follow_quality_labels(spark):
    out = outliers.op1(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)] and n.get((0, True), 0) <= 0.1 * n[(0, False)]


def test_kd_shards(clashing, empty):
    rows = sharding.kd_shards(clashing, 7).collect()
    want = sorted((len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in clashing.collect())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    biggest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * biggest
    assert sharding.kd_shards(empty).collect() == []


def test_kd_splits_a_hot_source(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"),
                                    F.lit("hot").alias("source"), F.lit(9).cast("bigint").alias("n_chars"))
    n = [r["count"] for r in sharding.kd_shards(docs, 8).groupBy("shard").count().collect()]
    assert len(n) == 8 and max(n) - min(n) <= 2


def lm_words(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [""]


@pytest.mark.parametrize("chunk", [300, 2_000_000])
def test_base_scores(clashing, chunk):
    train = crc_mod("doc_id", 5) != 1
    rows = lm_score.score_documents(clashing, train, chunk_tokens=chunk).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    texts = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    c = Counter(w for d, t in texts if not held(d) for w in lm_words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((d is None, d or 0, held(d), len(lm_words(t)), sum(w in c for w in lm_words(t)),
                   round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in lm_words(t)), 5)) for d, t in texts)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in rows)
    assert got == want and {r["train_tokens"] for r in rows} == {n}


def test_automaton_is_a_distribution_and_equals_direct_backoff():
    corpus = [b"a b a b c a b d".split() + [b""], b"b c a c a b".split() + [b""]]
    uni = Counter(w for t in corpus for w in t)
    grams = Counter()
    for t in corpus:
        t = [b"", *t]
        grams.update(zip(t, t[1:]))
        grams.update(zip(t, t[1:], t[2:]))
    grams = {g: c for g, c in grams.items() if c > 1}
    n, v = sum(uni.values()), len(uni)
    m = lm_score.Automaton(dict(uni), grams, n, v)
    seen = {**{(w,): c for w, c in uni.items()}, **grams}

    def p(h, w):
        if not h:
            return (uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))
        arcs = {g[-1]: c for g, c in grams.items() if g[:-1] == h}
        if not arcs:
            return p(h[1:], w)
        left = 1 - sum(c - 0.75 for c in arcs.values()) / seen[h]
        return (max(arcs[w] - 0.75, 0) / seen[h] if w in arcs else 0) + left * p(h[1:], w)

    words = sorted(uni)
    lid = {w: i for i, w in enumerate(words)}
    width = len(words)
    arcs = {s * width + lid[w]: a for s, mine in m.arcs.items() for w, a in mine.items()}
    root = [math.log10(p((), w)) for w in words]
    reach = [m.state.get((w,), 0) for w in words]
    text = b"a b a b c a c a b d".split() + [b""]
    got = lm_score.traverse([lid[w] for w in text], m.start, arcs, width, m.fail, m.back, root, reach)
    h, want = [b""], 0.0
    for w in text:
        want += math.log10(p(tuple(h[-2:]), w))
        h.append(w)
    assert abs(got - want) < 1e-9
    for h in m.state:
        assert sum(p(h, w) for w in words) + p(h, b"unseen") == pytest.approx(1.0)


@pytest.mark.parametrize("chunk, size", [(300, 5_000), (2_000_000, 8_000_000)])
def test_every_gram_seen_in_training_is_kept(clashing, chunk, size):
    train = crc_mod("doc_id", 5) != 1
    rows = lm_score.score_documents(clashing, train, chunk_tokens=chunk, bucket_bytes=size).collect()
    texts = [(r["doc_id"], [b"", *lm_score.words_of(r["text"] or ""), b""]) for r in clashing.collect()]
    uni, grams = Counter(), Counter()
    for d, t in texts:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            uni.update(t[1:])
            grams.update(zip(t, t[1:]))
            grams.update(zip(t, t[1:], t[2:]))
    m = lm_score.Automaton(dict(uni), grams, sum(uni.values()), len(uni))
    lid = {w: i for i, w in enumerate(sorted({w for _, t in texts for w in t}))}
    arcs = {s * len(lid) + lid[w]: a for s, mine in m.arcs.items() for w, a in mine.items()}
    root = [math.log10((uni[w] + 0.5) / m.norm) for w in lid]
    reach = [m.state.get((w,), 0) for w in lid]
    want = [(str(d), lm_score.traverse([lid[w] for w in t[1:]], m.start, arcs, len(lid), m.fail, m.back, root, reach)) for d, t in texts]
    got = [(str(r["doc_id"]), r["score"]) for r in rows]
    for (d, x), (e, y) in zip(sorted(want), sorted(got), strict=True):
        assert d == e and y == pytest.approx(x, rel=1e-9)


def test_model_beats_unigrams_on_held_out(spark):
    r = lm_score.op9(spark, SF).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_lm_empty(empty):
    assert lm_score.score_documents(empty, crc_mod("doc_id", 5) != 1).collect() == []


def accuracy(out, labels, label):
    rows = out.join(labels, "doc_id").filter("held_out").select(label, "predicted").collect()
    hit = Counter((r[0], r[1]) for r in rows)
    return (hit[(0, 0)] / max(1, hit[(0, 0)] + hit[(0, 1)]), hit[(1, 1)] / max(1, hit[(1, 1)] + hit[(1, 0)]))


def test_quality_on_held_out(spark):
    low, high = accuracy(quality_model.op7(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    assert low > 0.8 and high > 0.95


def test_toxicity_on_held_out(spark):
    low, high = accuracy(toxicity.op8(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "toxic")
    assert low > 0.97 and high > 0.6


def test_subwords_find_unseen_misspellings():
    rng = np.random.default_rng(1)
    plain = ["lorem", "ipsum", "dolor", "amet", "elit", "tempor", "magna", "aliqua"]
    make = lambda bad: " ".join([*rng.choice(plain, 30), *([bad] if bad else []), *rng.choice(plain, 30)])
    texts = [make(None) for _ in range(150)] + [make("horrible"), make("horribly"), make("horribles")] * 20
    f = toxicity.SubwordSoftmax(texts, np.array([0.0] * 150 + [1.0] * 60)).scorer()
    assert f(make("xhorriblex")) > 0.5 > f(make(None)) and 0 <= f(None) == f("") < 0.5


@pytest.mark.parametrize("fit", [lambda d, y: toxicity.fit_toxicity(d, y, F.lit(True), "toxic"),
                                 lambda d, y: quality_model.fit_quality(d, y, F.lit(True), "toxic")])
def test_classifiers_with_odd_tables(spark, clashing, empty, fit):
    labels = spark.createDataFrame([(3, None), (None, 1), (4, 1), (4, 1), (5, 7)], "doc_id bigint, toxic int")
    out = clashing.select("doc_id", fit(clashing, labels).alias("s")).collect()
    assert len(out) == clashing.count() and {r["s"] for r in out} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    out = clashing.select("doc_id", fit(clashing, both).alias("s")).collect()
    assert all(r["s"] is not None and 0 <= r["s"] <= 1 for r in out)
    assert empty.select(fit(empty, both).alias("s")).collect() == []


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + rng.normal(0, 1, 600) > 0).astype(float)
    net = quality_model.Network(x, y, epochs=30)
    assert net.temperature > 0 and ((net.scores(x) > 0.5) == y).mean() > 0.7
