"""Entropy spans against every window of every candidate, recall of random strings by class, and time in long texts."""

import random
import re
import time
from collections import Counter
from math import log2

import pytest

from myospark.llm.secrets import ALLOW, CLASSES, base_spans, entropy_spans, scan_secrets, window_entropy

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {"digits": "0123456789", "hexadecimal": "0123456789ABCDEF", "lower case": LETTERS, "upper case": LETTERS.upper(), "letters": LETTERS + LETTERS.upper(), "alphanumeric": LETTERS + LETTERS.upper() + "0123456789", "base64": LETTERS + LETTERS.upper() + "0123456789+/"}


def brute_entropy(word):
    return max(-sum(c / 20 * log2(c / 20) for c in Counter(word[i : i + 20]).values()) for i in range(len(word) - 19))


def brute_spans(text):
    base = base_spans(text)
    inside = lambda a, b: any(s <= a and b <= e for s, _, e in base)
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        word, at = m[0], m.start()
        hit = False
        for _, chars, bits in CLASSES:
            i = 0
            while i < len(word):
                j = i
                while j < len(word) and word[j] in chars:
                    j += 1
                if j - i >= 20 and not inside(at + i, at + j) and not ALLOW.fullmatch(word[i:j]) and brute_entropy(word[i:j]) >= bits - 1e-9:
                    hit = True
                i = max(j, i + 1)
        if hit and not inside(*m.span()) and not ALLOW.fullmatch(word):
            out.append(m.span())
    return out


def test_entropy_spans_against_every_window():
    rng = random.Random(6)
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            chars = rng.choice([*ALPHABETS.values(), "ab", "0123456789-", "abc/"])
            parts.append("".join(rng.choice(chars) for _ in range(rng.randrange(1, 60))))
            parts.append(rng.choice([" ", "=", "-", "token: ", ".", "_"]))
        text = "".join(parts)
        assert entropy_spans(text, base_spans(text)) == brute_spans(text)


@pytest.mark.parametrize(("kind", "least"), [("hexadecimal", 0.95), ("lower case", 0.65), ("upper case", 0.65), ("letters", 0.95), ("alphanumeric", 0.95), ("base64", 0.9)])
def test_random_strings_of_each_class_are_found(make, kind, least):
    rng = random.Random(kind)
    made = ["".join(rng.choice(ALPHABETS[kind]) for _ in range(40)) for _ in range(100)]
    rows = scan_secrets(make([f"see {w} there" for w in made])).collect()
    assert sum("entropy:4:44" in r["spans"].split(",") for r in rows) >= 100 * least
    digits = scan_secrets(make(["see 31415926535897932384 there"])).first()
    assert digits["spans"] == "hex:4:24" and digits["n_entropy"] == 0  # base holds them


def test_harmless_strings_are_left(make):
    texts = ["550e8400-e29b-41d4-a716-446655440000", "2024-05-06T07080910111213", "src/main/java/org/example/project", "some-words-joined-by-signs_here", "2024-05-06/2024-05-07-99", "z" * 500, "keitstlichschenverpfenungtz", "=" * 200, None, ""]
    assert [r["spans"] for r in scan_secrets(make(texts)).collect()] == [""] * len(texts)


def test_many_base_spans_and_candidates_take_linear_time():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice(LETTERS + "0123456789") for _ in range(n))
    text = " ".join(f"token={word(14)} {word(24)}" for _ in range(16_000))
    began = time.time()
    found = entropy_spans(text, base_spans(text))
    assert time.time() - began < 5 and len(found) > 10_000
    assert window_entropy("ab" * 50_000) == pytest.approx(1.0)
