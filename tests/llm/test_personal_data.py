"""Co-occurrence figures against brute force, rows that repeat an id, and time in long texts."""

import math
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from myospark.llm import common
from myospark.llm import personal_data as module
from myospark.llm.personal_data import EVIDENCE, WINDOW, base_spans, disclosing_terms, personal_data, sanitise, weighed

WORD = re.compile(r"[^\W_]{4,}")
MAIL = re.compile(r"[a-z0-9.]+@[a-z0-9]+\.example")


def brute_figures(texts):
    """(entity, term) -> (contexts, texts beside, texts with the term, texts with the entity), for lower-case texts with addresses only."""
    contexts, beside, holds, has = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for text in set(texts):
        for w in WORD.findall(text):
            holds[w].add(text)
        for m in MAIL.finditer(text):
            entities = (m[0], m[0].split("@")[1])
            before, after = text[max(0, m.start() - WINDOW - 1) : m.start()], text[m.end() : m.end() + WINDOW + 1]
            before = re.sub(r"^[^\W_]+", "", before) if len(before) > WINDOW else before
            after = re.sub(r"[^\W_]+$", "", after) if len(after) > WINDOW else after
            for e in entities:
                has[e].add(text)
                for w in WORD.findall(f"{before} {after}"):
                    contexts[e, w].add((before, after))
                    beside[e, w].add(text)
    return {k: (len(c), len(beside[k]), len(holds[k[1]]), len(has[k[0]])) for k, c in contexts.items() if len(c) >= 2}


def test_figures_against_brute_force(make):
    rng = random.Random(3)
    names = ["zorblatt", "quimby", "fnordley"]
    texts = []
    for i in range(120):
        words = [f"filler{rng.randrange(60)}" for _ in range(rng.randrange(5, 40))]
        if i % 3 == 0:
            k = rng.randrange(3)
            words.insert(rng.randrange(len(words)), f"{names[k]} u{rng.choice([k, i])}@host{k}.example")
        elif i % 7 == 0:
            words.append(rng.choice(names))
        texts.append(" ".join(words))
    texts += texts[:20]
    docs = make(texts).select("doc_id", "text")
    found = base_spans(docs, "text").where("size(spans) > 0")
    got = weighed(docs, found, 0.0)[0].collect()
    want = brute_figures(texts)
    ours = sorted((r["term"], r["n_context"], r["n_pair"], r["n_term"], r["n_entity"]) for r in got)
    assert ours == sorted((k[1], *v) for k, v in want.items())
    n = len(set(texts))
    telling = {k[1] for k, (c, pair, term, entity) in want.items() if pair / term >= 0.5 and math.log2(pair / term * n / entity) >= 3 and (c >= 3 or pair * math.log2(pair / term * n / entity) >= EVIDENCE)}
    told = disclosing_terms(docs, found)[0].collect()
    assert {r["term"] for r in told} == telling and telling & set(names)


def test_rows_with_one_id_keep_their_own_spans(make):
    noise = [f"plain{i} words{i} stand{i} alone{i}" for i in range(60)]
    letters = [f"{w} zorblatt wrote from boss@corp.example {w} again" for w in ("monday", "tuesday", "friday", "sunday")]
    ids = [99, 99, 99, None, None, *range(60)]
    rows = personal_data(make([*letters, "hello you", *noise], ids=ids)).collect()
    assert len(rows) == 65
    ours = [r for r in rows if r["doc_id"] in (99, None)]
    assert sorted(r["n_term"] for r in ours) == [0, 4, 4, 4, 4]  # the name, and what all letters say beside it
    assert sorted(r["n_email"] for r in ours) == [0, 1, 1, 1, 1]
    clean = sanitise(make([*letters, letters[0], "hello you", *noise], ids=[99, 99, 99, None, 99, None, *range(60)])).collect()
    assert len(clean) == 66 and sum("[EMAIL]" in r["text"] for r in clean) == 5
    assert not any("zorblatt" in r["text"] or "boss" in r["text"] for r in clean)


def test_many_matches_take_linear_time(make):
    parts = [f"wörd{i} u{i}@corp{i % 7}.example" for i in range(20_000)]
    text = " ".join(parts)
    docs = make([text, "x"]).select("doc_id", "text")
    base_spans(docs, "text").collect()  # compiled once
    began = time.time()
    spans = base_spans(docs, "text").where("doc_id = 0").select("spans").first()[0]
    assert time.time() - began < 10
    assert len(spans) == 20_000 and all(text[s["start"] : s["stop"]] == s["value"] for s in spans)
    clean = sanitise(docs.where("doc_id = 0")).first()["text"]
    assert clean == " ".join(f"wörd{i} [EMAIL]" for i in range(20_000))


def test_overlapping_spans_leave_nothing_behind(make):
    docs = make(["4111 1111 1111 1111 x a@b.example", "10.0.0.1@x.example +378282246310005", None, "", "é" * 700 + " a@b.example " + "ü" * 700])
    clean = {r["doc_id"]: r["text"] for r in sanitise(docs).collect()}
    assert clean[0] == "[CARD] x [EMAIL]" and not re.search("[0-9]", clean[1]) and clean[2] == clean[3] == ""
    assert clean[4] == "é" * 700 + " [EMAIL] " + "ü" * 700
    assert sanitise(docs.limit(0)).count() == 0


def letters_and_noise():
    """Three hosts with names of their own; one word stands beside every address of one host, and in no other text."""
    rng = random.Random(9)
    names = ["zorblatt", "quimby", "fnordley"]
    texts = []
    for i in range(240):
        words = [f"filler{rng.randrange(200)}" for _ in range(rng.randrange(5, 40))]
        if i % 6 == 0:
            k = rng.choice([0, 0, 1, 2])
            words.insert(rng.randrange(len(words)), f"{names[k]} u{rng.choice([k, i])}@host{k}.example {'signature' if k == 0 else ''}")
        elif i % 50 == 7:
            words.append(f"{rng.choice(names)}, x@")
        texts.append(" ".join(words))
    return texts + texts[:20]


def brute_spans(texts):
    """Base spans, and every place of a disclosing term that no base span overlaps, for texts with addresses only."""
    n = len(set(texts))
    telling = set()
    for (_, term), (contexts, pair, held, entity) in brute_figures(texts).items():
        bits = math.log2(min(1, pair / held) * n / entity)
        if pair / held >= 0.5 and bits >= 3 and (contexts >= 3 or pair * bits >= EVIDENCE):
            telling.add(term)
    out = []
    for text in texts:
        base = [(m.start(), m.end()) for m in MAIL.finditer(text)]
        terms = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m[0] in telling]
        spans = [(a, "email", b) for a, b in base] + [(a, "term", b) for a, b in terms if all(b <= x or y <= a for x, y in base)]
        out.append(",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans)))
    return out, telling


def test_final_spans_against_brute_force(make):
    texts = letters_and_noise()
    want, telling = brute_spans(texts)
    assert {"zorblatt", "signature"} <= telling and sum("term" in w for w in want) > 20
    rows = {r["doc_id"]: r["spans"] for r in personal_data(make(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == want


def test_hot_terms_and_hosts_are_split(make, monkeypatch):
    """Every key is hot from the first rows on, and no list of terms is small enough to broadcast: the result stays."""
    texts = letters_and_noise()
    asked = []
    keys = common.hot_keys
    monkeypatch.setattr(module, "HOT_ROWS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(module, "hot_keys", lambda *a: asked.append(keys(*a)) or asked[-1])
    rows = {r["doc_id"]: r["spans"] for r in personal_data(make(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_spans(texts)[0]
    assert len(asked) == 2 and all(a is not None for a in asked)


def test_bounds_rule_out_without_reading_the_rest(make, monkeypatch):
    """Words that stand in many texts with entities disclose nothing; only those texts are searched for words."""
    texts = [f"hello filler{i} from user{i}@host{i}.example and goodbye" for i in range(30)] + [f"plain{i} words" for i in range(10)]
    seen = []
    words = module._words
    monkeypatch.setattr(module, "_words", lambda df: seen.append(df.count()) or words(df))
    assert all(r["n_term"] == 0 for r in personal_data(make(texts)).collect())
    assert set(seen) <= {30}


@pytest.mark.parametrize("texts", [[], [None, ""], ["a@b.example"]])
def test_no_candidates(make, texts):
    assert [r["n_term"] for r in personal_data(make(texts)).collect()] == [0] * len(texts)
