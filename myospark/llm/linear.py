"""Hashed text features and small linear models trained on a bounded sample on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernels import CHUNK_BYTES, chunks, windows, words

#: The 64 byte classes of letter trigrams. Letters A-Z and a-z are 1 to 26, other ASCII bytes 0, bytes of multi-byte characters 27 to 63.
SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = 27 + np.arange(128) % 37


class Rows:
    """Sparse rows: index and value of every entry, and where each row starts."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        sizes = np.array([len(i) for i, _ in parts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.idx = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in parts]) if parts else np.zeros(0)
        self.row = np.repeat(np.arange(len(parts)), sizes)
        self.n = len(parts)

    def dot(self, w: np.ndarray) -> np.ndarray:
        if not len(self.idx):
            return np.zeros(self.n)
        at = self.start[:-1]
        full = self.start[1:] > at  # reduceat gives an empty row the entry at its place
        out = np.zeros(self.n)
        out[full] = np.add.reduceat(self.val * w[self.idx], at[full])
        return out

    def tdot(self, g: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.idx, weights=self.val * g[self.row], minlength=dims)


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam; deterministic."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def squashed(counts: np.ndarray) -> np.ndarray:
    v = 1 + np.log(counts)
    return v / np.sqrt((v * v).sum())


def _counted(n: int, places: Callable[[int, int], np.ndarray], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of a text's n bytes, less two, and how often each occurs; a long text is counted window by window."""
    if n <= CHUNK_BYTES:
        return np.unique(places(0, n), return_counts=True)
    total = np.zeros(dims, dtype=np.int64)
    for a, b in windows(n, 2):
        if b - a > 2:
            total += np.bincount(places(a, b), minlength=dims)
    idx = np.flatnonzero(total)
    return idx, total[idx]


def trigram_rows(texts: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed letter trigrams of each whole text: indices and log counts of unit length."""

    def grams(raw: np.ndarray) -> np.ndarray:
        s = SYMBOL[raw]
        return ((((s[:-2] << 12) | (s[1:-1] << 6) | s[2:]) * 0x9E3779B1) >> 8) % dims

    for _, _, data, offs in chunks(texts):
        whole = grams(data) if 2 < len(data) <= CHUNK_BYTES else None
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            if b - a < 3:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            idx, counts = _counted(b - a, lambda x, y, a=a: grams(data[x:y]) if whole is None else whole[a + x : a + y - 2], dims)
            yield idx, squashed(counts)


def text_rows(texts: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each whole text: lower-case words, raw byte trigrams (case and symbols count) and runs of one word.

    Half of the dimensions are for words, half for trigrams; the last is the share of words that repeat the word before.
    """
    half = dims // 2

    def grams(raw: np.ndarray) -> np.ndarray:
        raw = raw.astype(np.int64)
        return half + ((((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]) * 0x9E3779B1) >> 9) % half

    for _, _, data, offs in chunks(texts):
        h, first = words(data, offs)
        w = (h % np.uint64(half - 1)).astype(np.int64)
        again = np.zeros(len(h) + 1, dtype=np.int64)
        if len(h) > 1:
            again[2:] = np.cumsum(h[1:] == h[:-1])
        whole = grams(data) if 2 < len(data) <= CHUNK_BYTES else None
        for a, b, c, d in zip(offs[:-1].tolist(), offs[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            parts_i, parts_v = [], []
            if d > c:
                wi, wc = np.unique(w[c:d], return_counts=True)
                parts_i.append(wi)
                parts_v.append(squashed(wc))
            if b - a > 2:
                gi, gc = _counted(b - a, lambda x, y, a=a: grams(data[x:y]) if whole is None else whole[a + x : a + y - 2], dims)
                parts_i.append(gi)
                parts_v.append(squashed(gc))
            if d - c > 1:
                parts_i.append(np.array([half - 1]))
                parts_v.append(np.array([2.0 * (again[d] - again[c + 1]) / (d - c - 1)]))
            yield (np.concatenate(parts_i), np.concatenate(parts_v)) if parts_i else (np.zeros(0, np.int64), np.zeros(0))


def bounded_sample(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows with the smallest hash of their id: the same rows in every run. ``ids`` has a column id."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary"))
    return ids.orderBy(order, "id").limit(most)
