"""Vectorised word hashing over the UTF-8 bytes of Arrow string columns.

Words are runs of bytes of a given class. A word's 64-bit hash is a polynomial
of its bytes, read off one running sum, and then mixed. Everything is numpy over
slices of a batch, so memory is bounded by the slice (or one longer text)."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_powers = [np.ones(1, _U), np.ones(1, _U)]

try:
    _libc = ctypes.CDLL(None)
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library: its free memory stays with the worker
    _libc = None


def give_back() -> None:
    """Return a worker's free memory to the system: workers are kept for later tasks,
    and what one stage needed must not stand beside what the next one needs."""
    _powers[:] = [np.ones(1, _U), np.ones(1, _U)]
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def tidy(run):
    """An Arrow function that begins and ends without unused memory."""

    def tidied(batches):
        give_back()
        yield from run(batches)
        give_back()

    return tidied


SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 9, 10, 11, 12, 13]] = True
NON_SPACE = ~SPACE_BYTES
#: 0-9, a-z and every byte of a code point above 127 (after lower-casing A-Z).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power_tables(n: int):
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64 (fixed public constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Yield (first row, offsets, bytes) of slices of at most ``limit`` bytes
    (one row at least). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    off = off.astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, off[row:end + 1] - off[row], data[off[row]:off[end]]
        row = end


def words(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray):
    """(starts, ends, first) of the words: byte ranges and each text's first word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return code_hashes(data.astype(_U) + _U(1), starts, ends) if len(starts) else np.zeros(0, _U)


def code_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``word_hashes`` of letters that are given as 64-bit codes, none of them 0."""
    p, inv = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * p[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(_U))


def gram_hashes(h: np.ndarray, first: np.ndarray, k: int):
    """Hashes of all runs of k words inside each text: (hashes, first gram of
    each text, position of each gram's first word in the slice)."""
    n = len(h)
    if n < k:
        z = np.zeros(0, _U)
        return z, np.zeros(len(first), np.int64), np.zeros(0, np.int64)
    g = np.zeros(n - k + 1, _U)
    for i in range(k):
        g = (g + h[i:n - k + 1 + i]) * _U(_BASE)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(text[:n - k + 1] == text[k - 1:])
    grams = np.maximum(count - (k - 1), 0)
    return mix64(g[at]), np.concatenate([[0], np.cumsum(grams)]), at


def spans(first: np.ndarray):
    """Indices of the non-empty texts and their first entries, for reduceat."""
    some = np.flatnonzero(np.diff(first) > 0)
    return some, first[some]
