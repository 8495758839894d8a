import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrank.llm import packing, records, tokens
from tallyrank.llm.tokens import encoder, tokenizer_path
from tallyrank.session import scratch_path


def plain_ids(text):
    return encoder(tokenizer_path()).model.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'st \n\t.,!|<>½²é\x1c\x85\xa0 日"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoding_by_parts_equals_encoding_whole(text):
    enc = encoder(tokenizer_path())
    assert enc.ids(text, None).tolist() == enc.model.encode(text, add_special_tokens=False).ids


def test_special_token_text():
    enc = encoder(tokenizer_path())
    for text in ("a <|endoftext|> b", "x<|endoftext|>y", " <|endoftext|>\n"):
        assert enc.ids(text, None).tolist() == enc.model.encode(text, add_special_tokens=False).ids


def test_full_table_keeps_frequent_parts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    enc, merged = tokens.Encoder(tokenizer_path()), []
    merges = enc.merges
    enc.merges = SimpleNamespace(tokenize=lambda piece: merged.append(piece) or merges.tokenize(piece))
    rare = [f" {a}{b}{c}" for a in "abcdef" for b in "ghijkl" for c in "mnopqr"]
    for at in range(0, len(rare), 6):
        text = " often seen, words" + "".join(rare[at:at + 6])
        assert enc.ids(text, None).tolist() == enc.model.encode(text, add_special_tokens=False).ids
    assert merged.count("\u0120often") == merged.count("\u0120seen") == 1
    assert len(enc.known) + len(enc.older) < 120


def check_packed(rows, texts, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert sum(r["length"] for r in rows) == sum(len(plain_ids(t)) for _, t in texts)
    for doc, text in dict(texts).items():
        ids, n = plain_ids(text), sum(d == doc for d, _ in texts)
        mine = sorted(by_doc[doc], key=lambda r: (r["piece"], r["sequence_id"], r["offset"]))
        assert len(mine) == n * -(-len(ids) // capacity)
        for r in mine:
            assert r["ids_crc32"] == crc(ids[r["start"]:r["start"] + r["length"]])
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing(clashing):
    texts = [(r["doc_id"], r["text"]) for r in clashing.select("doc_id", "text").collect()]
    rows = packing.pack(packing.pieces(clashing, 256), 256, local_items=32, fan_in=2, slack=4).collect()
    n = check_packed(rows, texts, 256)
    total = sum(r["length"] for r in rows)
    assert n <= 1.05 * total / 256 + 2


def test_packing_carries_are_bounded_without_loss(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = packing.pack(packing.pieces(docs, 64), 64, local_items=16, fan_in=2, slack=0, carry=1).collect()
    check_packed(rows, texts, 64)


def test_sequences_hold_the_ids(docs):
    some = docs.filter("doc_id < 30")
    placed = packing.pack(packing.pieces(some, 128, keep_ids=True), 128)
    rows = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        data = rows[r["sequence_id"]]["ids"][4 * r["offset"]:4 * (r["offset"] + r["length"])]
        assert bytes(data) == bytes(r["ids"])


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(fills.tolist()) == [10, 10] and bins[0] == bins[2] and offsets[2] == 6


def test_packing_empty(empty):
    assert packing.pack(packing.pieces(empty)).collect() == []


@pytest.fixture(scope="module")
def written(spark, clashing):
    folder = scratch_path(spark, "records-test")
    return folder, records.write_records(clashing, folder, file_bytes=20_000)


def test_records_round_trip(written, docs):
    folder, index = written
    read = sorted(records.read_files(index, folder).collect(), key=lambda r: (r["part"], r["file_no"], r["record"]))
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(plain_ids(r["text"])), crc(plain_ids(r["text"]))) for r in docs.collect())
    got = [(r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in read]
    assert sorted(got) == want and [g[:2] for g in got] == [w[:2] for w in want]
    assert len({(r["part"], r["file_no"]) for r in read}) > 3


def test_records_by_offset(written, docs):
    folder, index = written
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    shuffled = index.orderBy(F.xxhash64("doc_id")).limit(40)
    rows = records.read_at(shuffled, folder).collect()
    assert len(rows) == 40 and all(r["ids"] == plain_ids(texts[r["doc_id"]]) for r in rows)


def test_damage_is_seen():
    import io

    data = bytearray(records.frame(records.payload_of(7, b"\x01\x00\x02\x00", 2)))
    doc, ids = records.parse(records.read_frame(io.BytesIO(bytes(data))))
    assert doc == 7 and ids.tolist() == [1, 2]
    for at in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(bad)))


def test_records_empty(spark, empty):
    folder = scratch_path(spark, "records-empty")
    index = records.write_records(empty, folder)
    assert index.count() == 0 and records.read_files(index, folder).count() == 0


def test_starts_add_up(spark):
    rows = sorted(records.op3(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r["doc_id"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


def test_what_stays_behind_could_not_be_used():
    """Trees of best-fit rounds end with as many bins, whether all open bins travel or only those that can matter."""
    rng = np.random.default_rng(4)
    for capacity, fan_in, high in ((64, 2, 64), (64, 3, 40), (100, 2, 90)):
        groups = [rng.integers(1, high, rng.integers(1, 60)) for _ in range(fan_in ** 3)]
        ends = []
        for every in (False, True):
            level, final = [g.astype(np.int64) for g in groups], 0
            rounds = 3
            while True:
                fills = [packing.best_fit(g, capacity)[2] for g in level]
                if len(level) == 1:
                    final += len(fills[0])
                    break
                on = [packing.handed_on(f, capacity, 0, 10**9 if every else fan_in * rounds) for f in fills]
                assert every or max(o.sum() for o in on) <= capacity * fan_in * rounds
                final += sum(int((~o).sum()) for o in on)
                moving = [f[o] for f, o in zip(fills, on)]
                level = [np.concatenate(moving[i:i + fan_in]) for i in range(0, len(moving), fan_in)]
                rounds -= 1
            ends.append(final)
        assert ends[0] == ends[1]
