"""Trained scorers against plain Python on their weights, held-out figures, and memory of the kernels in a long text."""

import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from myospark.llm import language_id, quality, queries, toxicity
from myospark.llm import textkernels as tk
from myospark.llm.linear import SYMBOL

MASK = (1 << 64) - 1
sigmoid = lambda x: 1 / (1 + math.exp(-max(-40, min(40, x))))


def squash(counts):
    v = {k: 1 + math.log(c) for k, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()}


def language_features(text, dims):
    s = [int(SYMBOL[b]) for b in (text or "").encode()]
    return squash(Counter((((a << 12 | b << 6 | c) * 0x9E3779B1) >> 8) % dims for a, b, c in zip(s, s[1:], s[2:], strict=False)))


def plain_language(model, text):
    """(language, score, known share) by the rules of the two levels, one text and one machine at a time."""
    x = language_features(text, model.dims)
    known = sum(v * v for k, v in x.items() if model.seen[k]) if x else 1.0
    if not any(ch.isalpha() for ch in text or ""):
        return "und", 0.0, known
    p = {(level, a, b): sigmoid((sum(v * float(w[k]) for k, v in x.items()) + c) * slope) for level, a, b, w, c, slope in model.machines}
    names = sorted(model.families)
    if len(names) == 1:
        family, score = names[0], 1.0
    elif len(names) == 2:
        first = p["family", names[0], None]
        family, score = (names[0], first) if first >= 1 - first else (names[1], 1 - first)
    else:
        family = max(names, key=lambda n: p["family", n, None])
        score = p["family", family, None]
    inside = model.families[family]
    if len(inside) == 1:
        return inside[0], score, known
    pair = lambda a, b: p[family, a, b] if (family, a, b) in p else 1 - p[family, b, a]
    best = max(inside, key=lambda a: sum(pair(a, b) for b in inside if b != a))
    return best, score * min(pair(best, b) for b in inside if b != best), known


def test_language_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs)
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    kept = {r["doc_id"] for r in language_id.keep_identified(docs, model).collect()}
    for r in rows:
        lang, score, known = plain_language(model, r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-5)
        assert (r["doc_id"] in kept) == (lang != "und" and known >= model.least)


def test_three_families_and_unlearned_languages(make):
    words = {"en": "the thing that was there with them and then", "de": "der die und das nicht ein eine mit sich auf", "fr": "le chose et la autre avec eux pour dans que", "ru": "это слово там где был дом потом сад", "xx": "zo bip zo kal mun bip kal zo"}
    rng = random.Random(5)
    text = lambda lang, n=25: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    langs = [lang for lang in words for _ in range(60)]
    docs = make([text(lang) for lang in langs], langs)
    model = language_id.train(docs)
    assert sorted(model.families) == ["germanic", "romance", "slavic", "xx"] and len(model.machines) == 5
    probe = [text(lang) for lang in words for _ in range(10)] + ["½ ²", "Ⅷ ½", "12 !", None, "", "qvx jjk wqq xzz kkj " * 4, "日本語の文章です。今日は天気がいい" * 3]
    got = {r["doc_id"]: r for r in language_id.identify(make(probe), model).collect()}
    assert [got[i]["lang_pred"] for i in range(50)] == [lang for lang in words for _ in range(10)]
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in range(50, 55))
    for i, t in enumerate(probe):
        lang, score, _ = plain_language(model, t)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-5)
    kept = {r["doc_id"] for r in language_id.keep_identified(make(probe), model).collect()}
    assert kept == set(range(50))  # texts in no learned language go, clean ones stay


def test_short_texts_go_by_the_same_rule(make):
    docs = make(["the thing that was there with them and then"] * 40 + ["le chose et la autre avec eux pour dans que"] * 40, ["en"] * 40 + ["fr"] * 40)
    probe = ["z9q", "xq", "the", "ab", "q", "then", "qqqq zzz qqq zzz kkk", "1", ""]
    model = language_id.train(docs)
    kept = {r["doc_id"] for r in language_id.keep_identified(make(probe), model).collect()}
    assert kept == {1, 2, 3, 4, 5}  # a text under three bytes holds nothing unknown


def test_all_languages_are_learned(make, monkeypatch):
    langs = [f"x{i}" for i in range(260)]
    docs = make([f"word{lang} of{lang} {lang}talk and {lang}more" for lang in langs for _ in range(8)], [lang for lang in langs for _ in range(8)])
    monkeypatch.setattr(language_id, "MODEL_BYTES", 260 * 4 * 2048)
    model = language_id.train(docs, steps=2)
    assert model.dims == 2048 and sorted(v for own in model.families.values() for v in own) == sorted(langs)
    assert len(model.machines) == language_id.machines_for(langs) == 260


def test_the_sample_holds_the_smallest_hashes(spark):
    import hashlib

    rows = [(i, "ab"[i % 3 == 0]) for i in range(5000)] + [(7, "a")] * 2000
    pool = spark.createDataFrame(rows, "id long, lang string")
    counts = {lang: int(1.02 * len({i for i, own in rows if own == lang})) for lang in "ab"}  # a count of ids may err by some percent
    got = sorted((r["lang"], r["id"]) for r in language_id._smallest(pool, counts, 200).collect())
    by_hash = lambda lang: sorted({(hashlib.md5(f"{language_id.SEED}:{i}".encode()).hexdigest(), str(i)) for i, own in rows if own == lang})[:200]
    assert got == sorted((lang, i) for lang in "ab" for _, i in by_hash(lang))


def plain_word_hash(word):
    h = sum(int(tk._BYTE[b]) * pow(tk._BASE, i, 1 << 64) for i, b in enumerate(word)) & MASK
    h = (h + len(word) * int(tk._MULT[7])) & MASK
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def plain_grades(model, text):
    half = model.dims // 2
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", low) if w]
    x = Counter()
    for k, v in squash(Counter(plain_word_hash(w) % (half - 1) for w in words)).items() if words else ():
        x[k] += v
    grams = Counter(half + (((a << 16 | b << 8 | c) * 0x9E3779B1) >> 9) % half for a, b, c in zip(raw, raw[1:], raw[2:], strict=False))
    for k, v in squash(grams).items() if grams else ():
        x[k] += v
    if len(words) > 1:
        x[half - 1] += 2.0 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / (len(words) - 1)
    f = sum(v * model.weights[k] for k, v in x.items())
    return [sigmoid(f - c) for c in model.cuts]


def test_quality_against_plain_python_and_held_out(spark, sf):
    d = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, queries.graded(labels))
    got = {r["doc_id"]: r for r in quality.grade(docs, model).collect()}
    for r in docs.select("doc_id", "text").limit(150).collect():
        above = plain_grades(model, r["text"])
        assert got[r["doc_id"]]["expected_grade"] == pytest.approx(sum(above), abs=1e-5)
        assert got[r["doc_id"]]["tail_probability"] == pytest.approx(above[0], abs=1e-5)
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] in got]
    good, bad = ([got[r["doc_id"]]["kept"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_viterbi_against_all_readings(make):
    corpus = make(["you are an idiot and a stupid worthless moron, what a clown and loser " * 3] * 5 + ["the thing that was there then with them"] * 20)
    decoder = toxicity.Decoder(toxicity.corpus_trigrams(corpus))

    def cost(seen, extra):
        a = b = 0
        total = extra
        for z in [ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0 for c in seen] + [0]:
            if z == b == 0:
                a = 0
                continue
            total -= decoder.logp[a][b][z]
            a, b = b, z
        return total

    rng = random.Random(9)
    for _ in range(150):
        word = "".join(rng.choice("abdeiot104$!(") for _ in range(rng.randrange(1, 7)))
        every = [("".join(o[0] for o in way), "".join(o[1] for o in way), sum(o[2] for o in way)) for way in product(*decoder.lattice(word))]
        least = min(cost(seen, extra) for seen, _, extra in every)
        ours = decoder.word(word)
        assert min(cost(seen, extra) for seen, written, extra in every if written == ours) == pytest.approx(least)


def test_toxicity_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    decoder = toxicity.Decoder(model.counts)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        words = set(re.findall(r"[^\W\d_]+", decoder.restore(r["text"] or "")))
        marks = words | {w[:n] + "-" for w in words for n in (4, 5, 6, 7) if len(w) > n}
        assert got[r["doc_id"]]["score"] == pytest.approx(sigmoid(model.offset + sum(model.weights.get(m, 0.0) for m in marks)))


def test_long_texts_take_bounded_memory():
    """A worker's peak over a text of 20 MB: some arrays of a window, and 8 bytes a word."""
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from myospark.llm import linear, textkernels
text = pa.array([np.random.default_rng(1).choice(np.frombuffer(b'abcdefgh    ', np.uint8), 20_000_000).tobytes().decode()])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
next(textkernels.shingle_sets(text)); next(linear.trigram_rows(text, 1 << 14)); next(linear.text_rows(text, 1 << 16))
print(peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]), check=True)
    assert float(out.stdout) < 420


def test_windows_make_no_difference():
    rng = random.Random(2)
    big = "".join(rng.choices("ab cé", k=3 << 20))
    words = [w for w in big.split(" ") if w]
    sets = next(tk.shingle_sets(pa.array([big])))
    assert len(sets) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
