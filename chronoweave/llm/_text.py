"""Vectorised text kernels: every function works on all bytes of a batch of texts at once.

A batch is the concatenated UTF-8 of several texts plus their offsets. Words are
runs of bytes other than space and 0x09-0x0D, so they never split a code point.
A word's 64-bit hash is a polynomial over its bytes modulo 2**64, finished with
a bit mixer; it needs one cumulative sum for the whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the kernels handle at once; one longer text is still taken whole.
CHUNK = 1 << 21

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Classes of bytes: 0 white space, 1 all others.
RUNS = np.ones(256, dtype=np.uint8)
RUNS[[0x20, *range(0x09, 0x0E)]] = 0
#: The same, with ASCII signs as a class of their own: a word and the signs around it are apart.
SIGNS = RUNS.copy()
SIGNS[[b for b in range(0x80) if RUNS[b] and not chr(b).isalnum()]] = 2
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) with their bytes and offsets, of about ``limit`` bytes and at most ``rows`` rows each."""
    data, offsets = utf8(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a batch: byte starts and ends, hashes, and each text's words first[i] to first[i + 1].

    ``kinds`` maps bytes to classes; a word is a run of one class other than 0.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, *, fold: bool = True, kinds: np.ndarray = RUNS):
        n = len(data)
        self.data = LOWER[data] if fold else data
        kind = kinds[data]
        cut = np.ones(n + 1, dtype=bool)  # cut[i]: between bytes i - 1 and i
        if n:
            np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
            cut[offsets] = True
        solid = kind != 0
        self.starts = np.flatnonzero(cut[:-1] & solid)
        self.ends = np.flatnonzero(cut[1:] & solid) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        up, down = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, and the offsets of each text's shingles.

    A text of fewer than k words (but at least one) has its whole sequence as its
    only shingle.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(offsets[-1]), dtype=np.uint64)
    if len(hashes) >= k:
        m = len(hashes) - k + 1
        rolled = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            rolled += hashes[j : j + m] * _STEP[j]
        long_docs = counts >= k
        take = np.repeat(first[:-1][long_docs] - offsets[:-1][long_docs], n[long_docs])
        slots = np.flatnonzero(np.repeat(long_docs, n))
        out[slots] = rolled[slots + take]
    for d in np.flatnonzero((counts < k) & (counts > 0)):
        words = hashes[first[d] : first[d + 1]]
        out[offsets[d]] = (words * _STEP[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
    return mix(out), offsets
