"""E8 lattice points by numpy: decoding, and the neighbouring cells to probe."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np

from .textbytes import mix64

DIM = 8
_U = np.uint64


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to be integers."""
    out = []
    for i, j in combinations(range(DIM), 2):
        for a, b in product((-2, 2), repeat=2):
            v = [0] * DIM
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in product((-1, 1), repeat=DIM) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out, np.int64)


ROOTS = roots()


def _even_points(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row, doubled."""
    whole, half = _even_points(y), _even_points(y - 0.5) + 0.5
    nearer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return (2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


def cell_keys(points: np.ndarray, table) -> np.ndarray:
    """64-bit keys of doubled lattice points (the last axis) of a table."""
    h = np.full(points.shape[:-1], table, _U) + _U(1)
    for i in range(DIM):
        h = mix64(h * _U(0x9E3779B97F4A7C15) + points[..., i].view(_U))
    return h


def probes(y: np.ndarray, home: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` lattice points around ``home`` nearest to ``y``, doubled."""
    near = (2 * y - home) @ ROOTS.T.astype(np.float64)
    pick = np.argpartition(-near, n - 1, axis=1)[:, :n]
    return home[:, None, :] + ROOTS[pick]


def rotations(dim: int, rounds: int, seed: int) -> np.ndarray:
    """(tables, dim, 8): each round cuts one random rotation into tables of eight
    dimensions, so that the tables of a round share out a pair's whole distance."""
    padded = -(-dim // DIM) * DIM
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rounds):
        q, r = np.linalg.qr(rng.normal(size=(padded, padded)))
        q = (q * np.sign(np.diag(r)))[:dim]
        out += [q[:, i:i + DIM] for i in range(0, padded, DIM)]
    return np.stack(out) * np.sqrt(padded)
