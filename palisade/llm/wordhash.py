"""Vectorised hashing of words, shingles and windows over Arrow text columns.

A word's hash is a polynomial in its bytes modulo 2^64 with random coefficients, taken
from running sums; hashes of k consecutive words come from running sums over words.
All work is on numpy arrays over CHUNK bytes of text, or one longer text, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 18
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_TABLES = {seed: np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1) for seed in (11, 12)}
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, n of them at least."""
    have = _powers.get((base, 0))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base & 0xFFFFFFFFFFFFFFFF, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK:
            _powers[(base, 0)] = have
    return have


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def table(seed: int, lower: bool) -> np.ndarray:
    t = _TABLES[seed]
    if lower:
        t = t.copy()
        t[65:91] = t[97:123]
    return t


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_binary():
        column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of the column whose texts together have about `limit` bytes, one text at least."""
    raw, offsets = texts(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends as byte positions, and each text's first word, one more at the end."""
    word = ~_BLANK[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def coded(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The words themselves, each distinct one once."""
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    data = np.ascontiguousarray(raw[np.cumsum(mark[:-1], dtype=np.int8) == 1])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, coeff: np.ndarray) -> np.ndarray:
    """A hash for each word, over some bytes at a time: a word's hash doesn't depend on where it stands."""
    out, lo = np.zeros(len(starts), U), 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        part = raw[base : ends[hi - 1]]
        total = np.zeros(len(part) + 1, U)
        np.cumsum(coeff[part] * powers(_P, len(part))[: len(part)], out=total[1:])
        at = starts[lo:hi] - base
        out[lo:hi] = mix((total[ends[lo:hi] - base] - total[at]) * powers(inverse(_P), len(part))[at])
        lo = hi
    return out


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for every i, across text ends too: callers keep those within one text."""
    n = len(words)
    if n < k:
        return np.zeros(0, U)
    up = powers(_Q, n)[:n]
    total = np.zeros(n + 1, U)
    np.cumsum(words * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(inverse(_Q), n)[: n - k + 1] + U(k))


def ranges(words: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Hash of the words at[i] .. at[i] + k[i] - 1 for each i."""
    n = len(words)
    total = np.zeros(n + 1, U)
    np.cumsum(words * powers(_Q, n)[:n], out=total[1:])
    return mix((total[at + k] - total[at]) * powers(inverse(_Q), n + 1)[at] + k.astype(U))


def slide(x: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over x[i : i + width] for each i."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    return op(out[: len(out) - (width - have)], out[width - have :]) if width > have else out
