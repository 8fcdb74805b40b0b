"""Vectorised text kernels over the byte buffers of Arrow string columns.

A batch is cut into chunks of at most a megabyte of whole texts, so temporaries stay small whatever the batch holds;
one text longer than that makes a chunk of its own and is taken in windows of that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20_240_611)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MULT = _RNG.integers(0, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: space and the control characters tab to carriage return
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int) -> np.ndarray:
    x = np.full(CHUNK_BYTES + 1, base, dtype=np.uint64)
    x[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(x)


@lru_cache(maxsize=1)
def _scales() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, for the bytes of one window: 16 MB for a worker, whatever its texts."""
    return _powers(_BASE), _powers(_BASE_INV)


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets); offsets start at 0 and null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_string(texts.type) and not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, offs, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def windows(n: int, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """Bounds of windows of at most CHUNK_BYTES that cover 0 to n, each with the last ``overlap`` places of the one before."""
    a = 0
    while a < n:
        yield max(0, a - overlap), min(n, a + CHUNK_BYTES - overlap)
        a += CHUNK_BYTES - overlap


def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unfinished hashes, byte starts and lengths of the runs between blanks and edges of texts, A-Z lower-cased."""
    n = len(data)
    data = LOWER[data]
    full = ~BLANK[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.ones(n, dtype=bool)
    before[1:] = ~full[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = ~full[1:]
    starts = np.flatnonzero(full & (before | edge[:n]))
    ends = np.flatnonzero(full & (after | edge[1:])) + 1
    up, down = _scales()
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * down[starts]
    return hashes, starts, ends - starts


def _finished(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(hashes + sizes.astype(np.uint64) * _MULT[7])


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text window by window; a word that a window cuts is put together from its parts."""
    out: list[np.ndarray] = []
    open_hash, open_size = 0, 0
    for a, b in windows(len(data)):
        part = data[a:b]
        hashes, starts, sizes = _runs(part, np.array([0, len(part)]))
        if open_size and not (len(starts) and starts[0] == 0):
            hashes, sizes = np.insert(hashes, 0, open_hash), np.insert(sizes, 0, open_size)
        elif open_size:
            hashes[0] = (open_hash + int(hashes[0]) * pow(_BASE, open_size, 1 << 64)) % (1 << 64)
            sizes[0] += open_size
        open_hash, open_size = 0, 0
        if len(sizes) and b < len(data) and not BLANK[part[-1]]:
            open_hash, open_size = int(hashes[-1]), int(sizes[-1])
            hashes, sizes = hashes[:-1], sizes[:-1]
        out.append(_finished(hashes, sizes))
    return np.concatenate(out)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a chunk, split at blanks, and the index of each text's first word (with the end).

    Temporaries take some 40 bytes for each byte of a chunk; a text longer than a chunk is taken in windows, and then only
    the hashes, 8 bytes a word, grow with it.
    """
    if len(data) > CHUNK_BYTES:
        hashes = _long_words(data)
        return hashes, np.array([0, len(hashes)])
    hashes, starts, sizes = _runs(data, offs)
    return _finished(hashes, sizes), np.searchsorted(starts, offs)


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    m = len(h) - width + 1
    out = np.zeros(max(m, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if m > 0 else 0):
            out += h[k : k + m] * _MULT[k]
        return mix64(out)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """One sorted array of distinct 64-bit shingle hashes for each text.

    A text of fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    for _, _, data, offs in chunks(texts):
        h, first = words(data, offs)
        if len(h) > CHUNK_BYTES // 2:  # more words than a chunk can hold: one long text
            yield np.unique(np.concatenate([np.unique(_rolled(h[a:b], width)) for a, b in windows(len(h), width - 1)]))
            continue
        rolled = _rolled(h, width)
        with np.errstate(over="ignore"):
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= width:
                    yield np.unique(rolled[a : b - width + 1])
                elif b > a:
                    yield mix64(np.array([(h[a:b] * _MULT[: b - a]).sum(dtype=np.uint64) + _U(b - a)], dtype=np.uint64))
                else:
                    yield np.zeros(0, dtype=np.uint64)
