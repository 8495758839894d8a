import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyrank.llm import language_codes, prefix_trie, spelling
from tallyrank.llm.common import crc_mod

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


# ---- language codes

def test_codewords_are_distinct_and_split():
    for k in (2, 3, 4, 7, 8, 20):
        code = language_codes.codewords(k)
        assert len(code) == k and len({tuple(c) for c in code.tolist()}) == k
        assert (np.abs(code.sum(axis=0, dtype=int)) < k).all()
    assert language_codes.codewords(4).shape[1] == 7


def plain_shares(text):
    """n-grams written out: words between marks."""
    s = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
    s = re.sub("\0+", "\0", s)
    return Counter(s[i:i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if s[i:i + k] != "\0")


@pytest.mark.parametrize("text", ["Größe, ist (eins)! é tiny\nitem", "a", "x1y2", "\U00010400b c"])
def test_ngrams_are_those_written_out(text):
    codes = language_codes.marked(text)
    rows, place = language_codes.ngrams(codes)
    assert len(rows) == sum(plain_shares(text).values())
    assert len(set(rows.tolist())) == len(plain_shares(text))  # no collision among so few


def test_margins_do_not_depend_on_slices(monkeypatch):
    model = language_codes.Codes.__new__(language_codes.Codes)
    model.code = language_codes.codewords(3)
    model.weights = np.random.default_rng(1).normal(size=(language_codes.ROWS, model.code.shape[1])).astype(np.float32)
    model.offset = np.zeros(model.code.shape[1], np.float32)
    texts = ["ein Haus im Wald", "", "12 34", "le chat est là " * 40, "x"]
    whole, letter = model.margins(texts)
    monkeypatch.setattr(language_codes, "SLICE", 30)
    cut, _ = model.margins(texts)
    monkeypatch.undo()
    assert np.allclose(whole, cut, atol=2e-2) and letter.tolist() == [True, False, False, True, True]
    for text, margin in zip(texts, whole):
        rows, share = language_codes.shares(text)
        assert np.allclose((model.weights[rows] * share[:, None]).sum(axis=0), margin, atol=1e-4)


def test_languages_on_held_out_rows(spark, docs):
    found = language_codes.op11(spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    held = found.join(lang, "doc_id").filter("held_out").toPandas()
    assert (held.lang_pred == held.truth).mean() > 0.97
    assert held.score.between(0, 1).all()
    assert found.count() == 1000


def test_languages_of_odd_tables(spark, docs, empty, clashing):
    model = language_codes.fit_languages(docs, crc_mod("doc_id", 4) != 2, most=200)
    rows = language_codes.predict_languages(clashing, model)
    assert rows.columns == [*clashing.columns, "language"]
    got = rows.collect()
    assert len(got) == docs.count()
    for r in got:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["language"]["lang_pred"] == "und") == (not letters)
        assert 0 <= r["language"]["score"] <= 1
    assert language_codes.predict_languages(empty, model).count() == 0
    none = language_codes.fit_languages(empty, F.lit(True))
    assert {tuple(r["language"]) for r in language_codes.predict_languages(docs, none).collect()} == {("und", 0.0, False), ("und", 1.0, False)}
    one = language_codes.fit_languages(docs.filter("lang = 'de'"), F.lit(True))
    assert {r["language"]["lang_pred"] for r in language_codes.predict_languages(docs, one).collect()} == {"und", "de"}


def test_sample_is_bounded_and_takes_repeats_once(spark):
    rows = [(1, "immer das gleiche", "de")] * 500 + [(k, f"text number {k}", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = Counter(r["lang"] for r in language_codes.language_sample(docs, F.lit(True), most=40).collect())
    assert got["de"] <= 2 and got["en"] <= 80


# ---- spelling variants

def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def edited(rng, word):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    c = rng.choice("abé÷")
    return word[:at] + (c if kind != 1 else "") + word[at + (kind != 0):]


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(7)
    base = ["".join(rng.choice("abc") for _ in range(n)) for n in (7, 7, 8, 9, 12, 20, 45)] + ["aaaaaaa", "aaaaaaaaaaa", "ÀÖäöüß÷×"]
    words = base * 30 + ["x" * 3000] * 2 + ["x" * 3001] * 40
    for _ in range(300):
        words += [edited(rng, rng.choice(base))] * rng.choice((1, 2, 3))
    words += ["prefixe" + a + b + "suffixes" for a in LETTERS[:12] for b in LETTERS[:12]] * 2
    rng.shuffle(words)
    rows = [(k, "; ".join(w.title() if k % 3 else w for w in words[k::25])) for k in range(25)]
    return rows + [(None, "nameless nameless nameless"), (900, None), (901, ""), (902, "short one"), (902, "short one")]


@pytest.mark.parametrize("block", [512, 95])
def test_variants_are_those_of_brute_force(spark, spelled, block):
    docs = spark.createDataFrame(spelled, "doc_id bigint, text string")
    got = {tuple(r) for r in spelling.variant_groups(spelling.vocabulary(docs), block=block).collect()}
    want = brute_groups(brute_words(spelled))
    assert got == want and any(r[1] for r in want) and max(r[4] for r in want) > 20


def test_groups_above_the_block_are_dealt_by_thirds(spark, spelled):
    words = spelling.vocabulary(spark.createDataFrame(spelled, "doc_id bigint, text string"))
    dealt = spelling.dealt(words, block=95)
    assert dealt.groupBy("key").count().agg(F.max("count")).first()[0] <= 95
    assert dealt.filter("b - a < longer div 3").count() > 0


def test_pairs_come_once(spark, spelled):
    words = spelling.vocabulary(spark.createDataFrame(spelled, "doc_id bigint, text string"))
    pairs = spelling.near_words(words, block=95)
    assert pairs.count() == pairs.distinct().count()


def test_spelling_of_odd_tables(spark, empty, clashing):
    assert spelling.variant_groups(spelling.vocabulary(empty)).count() == 0
    got = spelling.variant_groups(spelling.vocabulary(clashing))
    want = brute_groups(brute_words([tuple(r) for r in clashing.select("doc_id", "text").collect()]))
    assert {tuple(r) for r in got.collect()} == want


# ---- prefix tries

def brute_nodes(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, d == len(path)))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children, out = Counter(p[:-1] for p in members if p), []
    leaves, saved = Counter(), Counter()
    for p, found in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(found) - 1) * words(p[-1][1]) if p else 0
    for p, found in members.items():
        ends = ",".join(map(str, sorted(c for c, end in found if end)))
        out.append((min(c for c, _ in found), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(found), children[p], leaves[p],
                    saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = []
    for c in range(120):
        for turn in range(rng.choice((1, 2, 3, 5))):
            rows.append((c, turn, rng.choice(("user", "bot")), f"{rng.choice('ab')} said"))
    rows += [(1000 + c, k, "user", "the same") for c in range(60) for k in range(4)]  # one common conversation
    rows += [(2000, k, "user", str(k)) for k in range(300)] + [(2020, k, "user", str(k)) for k in range(290)]  # long ones
    rows += [(3001, None, None, None), (3001, 0, "user", None), (3001, 0, "user", None), (None, 1, "user", "of none"),
             (3021, 0, "a", "ab"), (3041, 0, "aa", "b"), (3061, 1, "user", "x " * 5000), (5001, 0, "user", "turnless, if h is not 0")]
    return rows + [(c, 0, "user", "alone") for c in range(7003, 7083, 20)]


@pytest.mark.parametrize("turns, last", [(prefix_trie.SHARD_TURNS, prefix_trie.LAST), (50, 100_000), (400, 60), (1, 10)])
def test_nodes_are_those_of_brute_force(spark, talks, turns, last):
    table = spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string")
    got = prefix_trie.trie(prefix_trie.rebuilt_paths(table).repartition(2), turns, last).collect()
    assert sorted(map(tuple, got), key=str) == brute_nodes(talks)


def test_ids_of_one_end_are_hashed_over_parts(spark):
    rows = [(c * 1500 - 7500, 0, "user", "hello you") for c in range(40)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = prefix_trie.trie(prefix_trie.rebuilt_paths(table)).collect()
    assert sorted(map(tuple, got), key=str) == brute_nodes(rows)


def test_find_close_over_many_blocks():
    rng = np.random.default_rng(2)
    for n in (1, 40, 700, 5000):
        signs, depth, opens = [1], 1, n
        while opens or depth:
            if opens and (depth == 1 or rng.random() < 0.55):
                signs.append(1)
                depth, opens = depth + 1, opens - 1
            else:
                signs.append(-1)
                depth -= 1
        stack, want = [], {}
        for i, s in enumerate(signs):
            if s > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.array(sorted(want))
        tree = prefix_trie.Excess(np.array(signs, np.int8))
        assert tree.findclose(at).tolist() == [want[i] for i in at.tolist()]
        assert tree.low[-1][0] == 0 and tree.high[-1][0] == max(np.cumsum(signs))


def test_trie_of_odd_tables(spark, talks):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.trie(prefix_trie.rebuilt_paths(spark.createDataFrame([], schema))).count() == 0
    wide = spark.createDataFrame(talks, schema).select("*", *[F.lit("taken").alias(n) for n in ("t", "code", "path", "base", "head", "part")])
    assert prefix_trie.trie(prefix_trie.rebuilt_paths(wide)).count() == len(brute_nodes(talks))
