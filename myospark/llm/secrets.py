"""Secret scans: key patterns, and sliding-window entropy per character class over candidate strings."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: The patterns of the three base kinds, the group that is measured and its least length.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
#: No shorter run can pass, and a run is matched whole either way; so short ones need not be visited.
_HEX_LONG = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Classes: name, characters, least entropy in bits of a window of 20 characters. Words of prose stay below 3.75 in any class.
#: Digits alone are no class: a run of 16 or more is a base match of kind hex already, as is one of lower-case hexadecimal.
_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = [
    ("hexadecimal", _DIGITS + "abcdefABCDEF", 3.2),
    ("lower case", _LOWER, 3.85),
    ("upper case", _LOWER.upper(), 3.85),
    ("letters", _LOWER + _LOWER.upper(), 3.8),
    ("alphanumeric", _DIGITS + _LOWER + _LOWER.upper(), 3.8),
    ("base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", 3.9),
]
#: Maximal runs of a class, long enough for a window, with its least entropy.
_RUNS = [(re.compile(f"[{re.escape(chars)}]{{{WINDOW},}}"), bits) for _, chars, bits in CLASSES]
#: Strings that look random but are not secret: UUIDs, dates and times, numbers or words of some letters joined by signs, digits in order.
ALLOW = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-]?[0-9]*"
    r"|[/_=+-]*[A-Za-z]{1,15}(?:[/_=+-]+[A-Za-z]{1,15})+[/_=+-]*|[/_=+-]*[0-9]{1,8}(?:[/_=+-]+[0-9]{1,8})+[/_=+-]*|0?(?:1234567890)+(?:123456789)?"
)


def window_entropy(text: str, width: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits, of any window of the text, from counts updated character by character."""
    n = len(text)
    if n < width:
        return 0.0
    counts: dict[str, int] = {}
    part = [0.0] + [c * log2(c) for c in range(1, width + 2)]
    total = 0.0
    least = None
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += part[c + 1] - part[c]
        if i >= width:
            out = text[i - width]
            c = counts[out]
            counts[out] = c - 1
            total += part[c - 1] - part[c]
        if i >= width - 1 and (least is None or total < least):
            least = total
    return log2(width) - least / width


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, by start and kind."""
    out = []
    for k, (name, pattern, group, least) in enumerate(BASE):
        for m in (_HEX_LONG if name == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def entropy_spans(text: str, taken: list[tuple[int, int, int]], allow: re.Pattern = ALLOW) -> list[tuple[int, int]]:
    """Candidate strings with a run of one class that is random for it, which no base span holds and no allow-list entry names.

    A run is maximal, so that a sign or a character of another class bounds it; it is random if one of its windows has the
    class' least entropy. ``taken`` has the base spans in order.
    """
    starts, furthest = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))

    def held(a: int, b: int) -> bool:
        n = bisect_right(starts, a)
        return n > 0 and furthest[n - 1] >= b

    def random(word: str, at: int) -> bool:
        return any(
            not held(at + m.start(), at + m.end()) and not allow.fullmatch(m[0]) and window_entropy(m[0]) >= bits for run, bits in _RUNS for m in run.finditer(word)
        )

    return [m.span() for m in CANDIDATE.finditer(text) if not held(*m.span()) and not allow.fullmatch(m[0]) and random(m[0], m.start())]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    A span is kind:start:end in code points, end exclusive, ordered by start and then kind (assign, access, hex, entropy)
    and joined by commas; base_sha256 is over the base spans alone. ``allow`` is a pattern of strings, besides the built-in
    ones, that the entropy kind passes over; base spans always stay. Null and empty texts have no spans. Texts are read
    whole, and time is linear in their length, but for a search among base spans for each candidate.
    """
    bounded_batches(docs.sparkSession)
    names = [b[0] for b in BASE]
    more = re.compile(f"{ALLOW.pattern}|{allow}") if allow else ALLOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            shas, spans = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                extra = entropy_spans(text, base, more)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                counts[3].append(len(extra))
                shas.append(hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
                full = sorted(base + [(a, 3, b) for a, b in extra])
                spans.append(",".join(f"{[*names, 'entropy'][k]}:{a}:{b}" for a, k, b in full))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"],
            )

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
