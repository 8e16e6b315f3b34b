"""Numpy kernels over the UTF-8 bytes of whole Arrow batches.

Texts are never decoded: every delimiter these operators use is ASCII, so a
word, a line or a character class can be told from the bytes.  A batch is cut
into runs of documents of about ``SLICE`` bytes (a longer document is a run of
its own), which bounds memory whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _K1
    h = (h ^ (h >> np.uint64(27))) * _K2
    return h ^ (h >> np.uint64(31))


def powers(n: int, which: str) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64, or the same of B's inverse."""
    if len(_powers[which]) < n:
        step = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        full = np.full(max(n, SLICE + (1 << 16)), step, np.uint64)
        full[0] = 1
        _powers[which] = np.multiply.accumulate(full)
    return _powers[which][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of at most ``most`` bytes, or of one document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of each document; no word crosses ``bounds``."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[text]
    first = np.zeros(len(text) + 1, bool)
    first[bounds] = True
    before = np.empty(len(text), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(text), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends


def prefix_hash(text: np.ndarray, lower: bool) -> np.ndarray:
    """c[i]: sum of the values of the first i bytes, each times B^position."""
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[text] * powers(len(text), "up"), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, which depend on their bytes alone."""
    down = powers(len(prefix), "down")
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def owners(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of the document that each position falls into."""
    return np.searchsorted(bounds, starts, "right") - 1


def shingles(text: np.ndarray, bounds: np.ndarray, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, words of each document) of all word ``k``-shingles.

    A document of fewer than ``k`` words, but one at least, gives one shingle:
    its whole sequence.
    """
    starts, ends = words(text, bounds)
    count = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), count
    w = span_hash(prefix_hash(text, lower), starts, ends)
    doc = np.repeat(np.arange(len(count)), count)
    mul = np.uint64(0xD6E8FEB86659FD93)
    n = len(w) - k + 1
    out, where = [], []
    if n > 0:
        h = w[:n].copy()
        for j in range(1, k):
            h = h * mul + w[j : j + n]
        whole = doc[:n] == doc[k - 1 :]
        out.append(mix(h[whole]))
        where.append(doc[:n][whole])
    first = np.concatenate([[0], np.cumsum(count)])
    for length in range(1, k):
        short = np.flatnonzero(count == length)
        if len(short):
            h = w[first[short]].copy()
            for j in range(1, length):
                h = h * mul + w[first[short] + j]
            out.append(mix(h + np.uint64(0x5851F42D4C957F2D * (k - length) & _MASK)))
            where.append(short)
    return np.concatenate(out), np.concatenate(where), count
