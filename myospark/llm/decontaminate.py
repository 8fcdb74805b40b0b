"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is cut into k + 1 pieces: a passage within k edits of it leaves at least one piece
untouched. Exact piece hits are found by hashes: every place of a text is hashed at a few anchor lengths, looked up among the
hashed beginnings of all pieces, and compared with the whole piece; around each hit Myers' bit-parallel distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, materialize

#: BLOCK_CHARS of items make a table of some 150 MB in a worker.
RATE, BLOCK_CHARS, WINDOW = 0.08, 32_000_000, 1 << 20
#: A piece is looked up by its first characters: as many as the longest of these that is no longer than the piece.
ANCHORS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16)
_U = np.uint64
_BASE, _SPREAD = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)


def normalize(text: str | None) -> str:
    """Lower case, with every run of whitespace as one space; long texts are taken in parts, as a split makes an object a word."""
    low = (text or "").lower()
    out, gap = [], False
    for a in range(0, len(low), WINDOW):
        part = low[a : a + WINDOW]
        words = part.split()
        if words:
            if out and (gap or part[0].isspace()):
                out.append(" ")
            out.append(" ".join(words))
            gap = part[-1].isspace()
        else:
            gap = True
    return "".join(out)


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their offsets, as equal in length as can be."""
    cut = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def myers_within(pattern: str, text: str, k: int) -> int | None:
    """The least edit distance between the pattern and any part of the text, if it is at most k."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        eq[ch] = eq.get(ch, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for ch in text:
        e = eq.get(ch, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best if best <= k else None


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def anchored(points: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each anchor length, in rising order, the hash of that many characters from every place on."""
    rolled = points.astype(np.uint64)
    for size in range(1, (sizes[-1] if sizes else 0) + 1):
        if size > 1:
            rolled = rolled[:-1] * _BASE + points[size - 1 :] if len(rolled) > 1 else rolled[:0]
        if size in sizes:
            yield size, (rolled + _U(size)) * _SPREAD


class Matcher:
    """The hashed beginnings of all pieces of a block of items: 16 bytes a piece, some 12 characters, and a filter in front."""

    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        owner, offset, place, length, base = [], [], [], [], 0
        self.size: list[list[int]] = []
        for n, (_, text, k) in enumerate(self.items):
            own = pieces(text, k)
            self.size.append([len(p) for _, p in own])
            for j, (at, piece) in enumerate(own):
                owner.append(n)
                offset.append(j)
                place.append(base + at)
                length.append(max(a for a in ANCHORS if a <= len(piece)))
            base += len(text) + 1
        self.anchors = sorted(set(length))
        places, lengths, keys = np.array(place, dtype=np.int64), np.array(length, dtype=np.int64), np.zeros(len(place), dtype=np.uint64)
        points = codes("\n".join(t for _, t, _ in self.items))
        for size, hashes in anchored(points, self.anchors):
            use = lengths == size
            keys[use] = hashes[places[use]]
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.offset = keys[order], np.array(owner, dtype=np.int32)[order], np.array(offset, dtype=np.int32)[order]
        bits = min(26, max(16, len(keys).bit_length() + 8))
        self.shift = _U(64 - bits)
        self.filter = np.zeros(1 << bits, dtype=bool)
        self.filter[(self.keys >> self.shift).astype(np.int64)] = True

    def hits(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the text and entries of the table whose anchors are equal, window by window."""
        far = self.anchors[-1] if self.anchors else 1
        for a in range(0, len(points), WINDOW):
            for _, hashes in anchored(points[a : a + WINDOW + far - 1], self.anchors):
                hashes = hashes[:WINDOW]
                at = np.flatnonzero(self.filter[(hashes >> self.shift).astype(np.int64)])
                low = np.searchsorted(self.keys, hashes[at], "left")
                n = np.searchsorted(self.keys, hashes[at], "right") - low
                if n.any():
                    entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                    yield np.repeat(at + a, n), entry

    def matches(self, texts: list[str]) -> list[dict]:
        """For each normalised text the items found in it, with the least distance of each."""
        found: list[dict] = [{} for _ in texts]
        first = 0
        while first < len(texts):
            last, total = first + 1, len(texts[first])
            while last < len(texts) and total + len(texts[last]) < WINDOW:
                total += len(texts[last]) + 1
                last += 1
            ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
            tried: set[tuple[int, int, int]] = set()
            for places, entries in self.hits(codes("\n".join(texts[first:last]))):
                which = np.searchsorted(ends, places, "right")
                starts = places - np.where(which > 0, ends[which - 1], 0)
                for d, p, n, j in zip(which.tolist(), starts.tolist(), self.owner[entries].tolist(), self.offset[entries].tolist(), strict=True):
                    self._try(texts[first + d], p, n, j, found[first + d], tried, d)
            first = last
        return found

    def _try(self, text: str, place: int, n: int, j: int, found: dict, tried: set[tuple[int, int, int]], d: int) -> None:
        """Whether piece j of item n is at a place of a text, and the item around it."""
        item, pattern, k = self.items[n]
        if found.get(item) == 0:
            return
        at = len(pattern) * j // (k + 1)
        start = place - at
        if (d, n, start) in tried or not text.startswith(pattern[at : at + self.size[n][j]], place):
            return
        tried.add((d, n, start))
        if start >= 0 and text.startswith(pattern, start):
            found[item] = 0
            return
        far = myers_within(pattern, text[max(0, start - k) : start + len(pattern) + k], k) if k else None
        if far is not None and far < found.get(item, k + 1):
            found[item] = far


def blocks(items: DataFrame, item_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The test items in blocks of bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("i is not null").orderBy("i", "t").toLocalIterator():
        text = normalize(row["t"])
        if not text:
            continue
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((row["i"], text))
        size += len(text)
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Which test items each document holds: doc_id, contaminated, n_items, item_ids, distances (of item_ids, in order).

    An item of n characters (lower case, whitespace collapsed) is held if some part of the whole document is within
    floor(n * rate) edits of it. Empty and null items match nothing; items with a repeated id are one item, at their least
    distance; ids may be of any type that sorts. Null and empty texts hold nothing. One output row per input row. Up to
    BLOCK_CHARS characters of items are one pass over the documents.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    item_type = items.schema[item_col].dataType
    of_item, name = pa.list_(to_arrow_type(item_type)), item_type.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast(f"array<{name}>").alias("item_ids"), F.array().cast("array<int>").alias("distances"))
    first = True
    for block in blocks(items, item_col, item_text_col):
        known = docs.sparkSession.sparkContext.broadcast((block, rate))  # bounded by BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*known.value)
            for batch in batches:
                ids, far = [], []
                held = matcher.matches([normalize(t.as_py()) for t in batch.column(1)])
                for new, old_ids, old_far in zip(held, batch.column(2), batch.column(3), strict=True):
                    found = dict(zip(old_ids.as_py(), old_far.as_py(), strict=True))
                    for item, d in new.items():
                        found[item] = min(d, found.get(item, d))
                    ids.append(sorted(found))
                    far.append([found[i] for i in sorted(found)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, of_item), pa.array(far, pa.list_(pa.int32()))], names=["doc_id", "text", "item_ids", "distances"])

        out = (out if first else materialize(out)).mapInArrow(run, f"doc_id {kind}, text string, item_ids array<{name}>, distances array<int>")
        first = False
    n = F.size("item_ids").cast("bigint")
    return out.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), "item_ids", "distances")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    bounded_batches(docs.sparkSession)
    at, out = docs.columns.index(text_col), docs
    for block in blocks(items, item_col, item_text_col):
        known = docs.sparkSession.sparkContext.broadcast((block, rate))  # bounded by BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*known.value)
            for batch in batches:
                held = matcher.matches([normalize(t.as_py()) for t in batch.column(at)])
                yield batch.filter(pa.array([not found for found in held], pa.bool_()))

        out = (out if out is docs else materialize(out)).mapInArrow(run, docs.schema)
    return out
