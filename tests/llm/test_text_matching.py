import hashlib
import random
import re
from collections import Counter

import ahocorasick
import pytest

from pyspark.sql import functions as F

from tallyrank.llm import decontaminate, near_join, repeated_passages

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(text, items):
    words = ITEM_WORD.findall(lower(text))
    hit, ids = set(), set()
    for item, t in items:
        w = ITEM_WORD.findall(lower(t))
        n = min(10, len(w))
        for win in {tuple(w[i:i + n]) for i in range(max(0, len(w) - n + 1))} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) == win:
                    hit.update(range(i, i + n))
                    ids.add(item)
    return len(words), len(hit), sorted(str(i) for i in ids if i is not None)


ITEMS = [(1, "One two, THREE four five six seven eight nine ten eleven twelve?"), (2, "tiny item"), (3, None), (4, "..."),
         (5, "Größe ist eins"), (5, "Größe ist eins"), (None, "nameless item")]
TEXTS = [(1, "x One-two three FOUR five six seven eight nine ten eleven y tiny  item."), (2, None), (3, ""), (4, "größe ist eins GRÖSSE ist eins"),
         (5, "tiny item tiny item nameless item"), (6, "nothing to see"), (7, "Größe, ist (eins)! é tiny\nitem" * 3)]


@pytest.mark.parametrize("bound", [1 << 25, 60])
def test_contamination(spark, bound):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    rows = decontaminate.find_contamination(docs, items, pattern_bytes=bound).collect()
    for r in rows:
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], c["items"]) == brute_hits(r["text"], ITEMS), r["text"]
        inside = sum(len(ITEM_WORD.findall(lower(r["text"][s["begin"]:s["end"]]))) for s in c["spans"])
        assert inside == c["n_hit"]


def test_contamination_without_items_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_contamination(docs, none).filter("contamination.n_hit > 0").count() == 0
    assert decontaminate.find_contamination(empty, spark.createDataFrame(ITEMS, "item_id bigint, text string")).count() == 0


def brute_kept(texts, window):
    lists = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window,gram,hot", [(35, 8, 5000), (35, 8, 2), (6, 3, 3)])
def test_repeated_passages(clashing, window, gram, hot):
    profile, edits = repeated_passages.find_repeats(clashing, window=window, gram=gram, hot=hot, shard_words=2000)
    out = profile.join(edits.drop("text"), "key", "left").selectExpr(
        "n_words", "coalesce(n_removed, 0) r", "coalesce(kept_sha256, sha) s").collect()
    texts = [r["text"] for r in clashing.select("text").collect()]
    assert sorted(map(tuple, out)) == sorted(brute_kept(texts, window))


def test_cut_texts_keep_the_rest(clashing):
    out = repeated_passages.remove_repeats(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    before = {r["doc_id"]: r["text"] for r in clashing.collect()}
    changed = 0
    for r in out.collect():
        want = brute_like = before[r["doc_id"]]
        if r["text"] != want:
            changed += 1
            assert len(r["text"]) < len(brute_like)
        if r["doc_id"] == 9004:
            assert r["text"] == "own start of this text and an end"
        if r["doc_id"] in (9001, 9002, 9003, 9010):
            assert r["text"] == want
    assert changed > 3


@pytest.mark.parametrize("window", [1, 4, 6, 11, 35])
def test_located_windows_with_few_states(monkeypatch, window):
    made, real = [], ahocorasick.Automaton
    monkeypatch.setattr(repeated_passages.ahocorasick, "Automaton", lambda *kind: made.append(real(*kind)) or made[-1])
    draw = random.Random(window)
    passage = [f"p{i}" for i in range(60)]
    lines = [[draw.choice("ab") for _ in range(draw.randrange(3 * window))] for _ in range(20)]
    lines += [passage[k:k + window + 20] for k in range(0, 12, 3)] + [["once"] * (window - 1), []]
    contexts = [(" ".join(w).encode(), 1 + k % 3 // 2) for k, w in enumerate(lines)]
    times = Counter()
    for w, (_, m) in zip(lines, contexts):
        for i in range(len(w) - window + 1):
            times[tuple(w[i:i + window])] += m
    for w, ranges in zip(lines, repeated_passages.locate(contexts, window)):
        want = {j for i in range(len(w) - window + 1) if times[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        assert [x for a, b in ranges for x in range(a, b)] == sorted(want)
    if window == 35:  # a state for each word would be more than twice as many
        found, = made
        assert found.get_stats()["nodes_count"] <= 15 * len(found) + 1


def test_repeats_empty(empty):
    assert repeated_passages.remove_repeats(empty).collect() == []


def shingle_set(t):
    w = WORD.findall(t or "")
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_classes(rows):
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    sets = {t: shingle_set(t) for t in texts}
    links = {t: [u for u in texts if u != t and sets[t] and sets[u]
                 and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u]) - 1e-9] for t in texts}
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    out = []
    for t, ids in texts.items():
        seen, stack = {t}, [t]
        while stack:
            for u in links[stack.pop()]:
                if u not in seen:
                    seen.add(u)
                    stack.append(u)
        out += [(d, low(i for u in seen for i in texts[u]), low(ids), len(links[t])) for d in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2, 256])
def test_near_classes(spark, clashing, block):
    base = [r["text"] for r in clashing.filter("doc_id between 3 and 9").collect()]
    more = []
    for k, t in enumerate(base):
        w = t.split()
        for j in range(6):
            v = list(w)
            v[(7 * j) % len(v)] = f"new{j}"
            more.append((8000 + 10 * k + j, " ".join(v)))
    more = spark.createDataFrame(more, "doc_id bigint, text string")
    docs = clashing.unionByName(more, allowMissingColumns=True)
    got = sorted(map(tuple, near_join.near_classes(docs, block=block).collect()), key=str)
    assert got == brute_classes([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_near_empty(empty):
    assert near_join.near_classes(empty).collect() == []


def test_prefix_is_shortened_to_the_target():
    p = near_join.shortened(0.8, 10, 20, 0.9995)
    assert near_join.recall(0.8, p, 20) >= 0.9995 > near_join.recall(0.8, p + 1, 20)


def test_components(spark):
    from tallyrank.llm.common import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (5, 5)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[i] == 100 for i in range(100, 130)) and out[201] == out[200] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_items_digest(spark):
    row = spark.range(1).select(decontaminate.items_digest(F.array(F.lit("10"), F.lit("9"))).alias("a"),
                                decontaminate.items_digest(F.array().cast("array<string>")).alias("b")).first()
    assert row["a"] == hashlib.sha256(b"10,9").hexdigest() and row["b"] == hashlib.sha256(b"").hexdigest()
