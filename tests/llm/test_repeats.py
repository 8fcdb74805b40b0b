"""Repeated passages against a brute force over every window."""

import hashlib
import random

import pytest

from myospark.llm import queries, repeats

SCHEMA = "doc_id long, text string, doc int, uid string, at double, gram long, kept binary"


def brute(rows):
    """Every 100-byte window in order of ids; rows of one id and text are one document, and one id's texts do not cut each other."""
    last = (1 << 63) - 1
    texts = sorted({(last if d is None else d, (t or "").encode()) for d, t in rows})
    first, out = {}, {}
    for doc, raw in texts:
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w not in first or first[w] == doc:
                first.setdefault(w, doc)
    for doc, raw in texts:
        cover, own = bytearray(len(raw)), set()
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if first[w] < doc or w in own:
                cover[p : p + 100] = b"\x01" * 100
            own.add(w)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out[doc, raw] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return sorted((last if d is None else d, *out[last if d is None else d, (t or "").encode()]) for d, t in rows)


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, 1, "x", 0.5, 3, None) for d, t in rows], SCHEMA).repartition(parts)
    return sorted(((1 << 63) - 1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.drop_repeats(df).collect())


def corpus(seed, n):
    """Texts that share passages of 60 to 400 characters, near copies, and periodic ones."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdeéß ") for _ in range(pick.randint(1, 9)))
    prose = lambda size: " ".join(word() for _ in range(size))
    shared = [prose(pick.randint(12, 80)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [prose(pick.randint(0, 40)) if pick.random() < 0.5 else pick.choice(shared) for _ in range(pick.randint(1, 6))]
        text = pick.choice(["", " ", "\n"]).join(parts)
        if rows and pick.random() < 0.3:
            text = list(pick.choice(rows)[1])
            for _ in range(pick.randint(0, 3)):
                if text:
                    text[pick.randrange(len(text))] = pick.choice("xyz")
            text = "".join(text)
        rows.append((i, text))
    return rows


EDGES = [(500, None), (501, ""), (502, "a" * 99), (503, "a" * 100), (504, "a" * 350), (505, "ab" * 120), (None, "q" * 101), (None, "q" * 101), (None, "qr" * 99), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_window(spark, seed):
    rows = corpus(seed, 120) + EDGES
    rows += rows[:10] + [(3, rows[40][1]), (3, "z" * 130 + rows[3][1])]  # repeated rows, and other texts under a known id
    pairs = found(spark, rows), brute(rows)
    assert pairs[0] == pairs[1]
    assert sum(r[2] > 0 for r in pairs[0]) > 30


def test_hot_grams_take_the_same_decisions(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_RUNS", 8)
    monkeypatch.setattr(repeats, "LISTED", 400)
    rows = corpus(4, 150) + EDGES
    docs = spark.createDataFrame([(d or 0, i, t or "") for i, (d, t) in enumerate(rows)], "doc long, uid long, text string")
    assert len(repeats.hot_grams(docs)) > 0
    assert found(spark, rows) == brute(rows)


def test_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_TEXTS", 0)
    rows = corpus(5, 60)
    assert found(spark, rows) == brute(rows)


def test_stretches_and_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 64)
    monkeypatch.setattr(repeats, "AT_ONCE", 7)
    monkeypatch.setattr(repeats, "WINDOWED_AT_ONCE", 3)
    rows = corpus(6, 60) + EDGES
    assert found(spark, rows) == brute(rows)


def test_long_text(spark):
    pick = random.Random(9)
    long = "".join(pick.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, long[:600_000] + long[100_000:101_000]), (2, long[299_000:300_500] + "tail"), (3, "v" * 300_000)]
    got = {r[0]: r[1:4] for r in found(spark, rows)}
    assert got[1] == (601_000, 1000, 1) and got[2] == (1504, 1500, 1) and got[3] == (300_000, 299_999, 1)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ours = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op13_suffix_dedup(spark, sf).collect())
    assert ours == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
