"""Suffixes sorted to a bounded depth by bucket-pointer refinement, in numpy.

Every position of a text points to its bucket: at first that of the q bytes that
begin there. A bucket is refined by sorting its positions on the pointers q bytes
further on, which tells them apart by 2q bytes; the new pointers are written back, so
that the next refinement, 2q bytes further on, reads what this one found, and depth
doubles each time. Positions alone in their bucket are done and are sorted no more."""

from __future__ import annotations

import numpy as np

from .textbytes import _power_tables, mix64

_U = np.uint64


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes, from which any range's hash is read."""
    p, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * p[:-1], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _power_tables(len(sums))
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U))


def gram_hashes_at_all(sums: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes at every position that has them."""
    n = len(sums) - q
    if n <= 0:
        return np.zeros(0, _U)
    _, inverse = _power_tables(len(sums))
    return mix64((sums[q:] - sums[:-q]) * inverse[:n])


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first member of every run of equal values, and the length."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def shared(buckets: np.ndarray) -> np.ndarray:
    """Which entries are not alone in their bucket (buckets are numbered from 0)."""
    return np.bincount(buckets)[buckets] > 1


def refined(pointers: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """Buckets of the positions ``at``: refined by the pointers ``offset`` further on."""
    pair = (pointers[at] << _U(32)) | pointers[at + offset]
    order = np.argsort(pair)
    cut = runs(pair[order])
    found = np.empty(len(at), np.int64)
    found[order] = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    return found


def equal_rows(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the n bytes at a[i] and at b[i] are the same, in bounded steps."""
    out = np.empty(len(a), bool)
    span = np.arange(n)
    for i in range(0, len(a), 20_000):
        out[i:i + 20_000] = (data[a[i:i + 20_000, None] + span] == data[b[i:i + 20_000, None] + span]).all(axis=1)
    return out


def equal_buckets(data: np.ndarray, starts: np.ndarray, length: int, sums: np.ndarray | None = None):
    """(members, bucket): the positions among ``starts`` whose ``length`` bytes occur at
    another of them too, and the number of their bucket. ``length`` is four times q."""
    q, rest = divmod(length, 4)
    if rest or len(data) >= 1 << 31:
        raise ValueError("the length must be divisible by four, the text shorter than 2 GB")
    grams = gram_hashes_at_all(prefix_sums(data) if sums is None else sums, q)
    if not len(starts):
        return starts, starts
    _, pointers = np.unique(grams, return_inverse=True)
    at = starts[shared(pointers)[starts]]  # buckets of q bytes with more than one position
    pointers = pointers.astype(_U)
    depth = q
    while depth < length and len(at):
        # later refinements read the pointers ``2 * depth`` on, so these are refined as well
        needed = np.unique(np.concatenate([at, at + 2 * depth])) if 2 * depth < length else at
        bucket = refined(pointers, needed, depth)
        depth *= 2
        pointers[needed] = bucket.astype(_U)
        at = at[shared(pointers[at].astype(np.int64))]
    bucket = pointers[at].astype(np.int64)
    order = np.lexsort((at, bucket))
    at, bucket = at[order], bucket[order]
    # first pointers are hashes of q bytes: the bytes themselves decide
    first = np.repeat(runs(bucket)[:-1], np.diff(runs(bucket))) if len(at) else at
    same = equal_rows(data, at, at[first], length)
    if not same.all():
        odd = np.isin(bucket, bucket[~same])
        rows = np.ascontiguousarray(data[at[odd, None] + np.arange(length)]).view(f"V{length}").ravel()
        _, by_bytes = np.unique(rows, return_inverse=True)
        bucket = bucket.copy()
        bucket[odd] = bucket.max() + 1 + by_bytes
    keep = shared(np.unique(bucket, return_inverse=True)[1]) if len(at) else np.zeros(0, bool)
    return at[keep], bucket[keep]
