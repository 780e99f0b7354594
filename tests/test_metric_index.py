import math

import numpy as np
import pytest

from lakeloom.operators import metric_index, search


def clustered(n, seed, dim=16, centres=None):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(centres or max(4, n // 50), dim))
    return centre[r.integers(0, len(centre), n)] + 0.12 * r.normal(size=(n, dim))


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x] if x is not None else None) for i, x in rows], "id long, v array<double>")


def brute(x, t):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= t, 1))
    return set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("t", [0.97, 0.9, 0.3])
def test_deep_hierarchy_is_exact(spark, t, monkeypatch):
    monkeypatch.setattr(metric_index, "PART", 40)
    x = clustered(500, 1)
    x = np.concatenate([x, x[:20], x[:20] * 3])
    points = frame(spark, list(enumerate(x))).withColumnRenamed("v", "x")
    got = {(r["i"], r["j"]) for r in metric_index.near_pairs(points, t, leaf=30).collect()}
    assert got == brute(x, t)


def test_lengths_never_meet(spark):
    x = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 1e-9, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]),
         (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0]), (10, [1.0])]
    got = {(r["i"], r["j"]) for r in search.cosine_pairs(frame(spark, x), "id", "v", 0.99).collect()}
    assert got == {(0, 1), (0, 9), (1, 9), (2, 3)}
    kept = sorted(r["id"] for r in search.semantic_dedupe(frame(spark, x), "id", "v", 0.99).collect())
    assert kept == [0, 2, 4, 5, 6, 7, 8, 10]


def test_comparisons_grow_little_more_than_the_table(spark):
    work = []
    for n in (4000, 16000):
        points = frame(spark, list(enumerate(clustered(n, 2)))).withColumnRenamed("v", "x")
        work.append(metric_index.comparisons(metric_index.leaves(points, math.sqrt(2 - 2 * 0.97), leaf=60)))
    assert work[1] <= work[0] * 4 ** 1.2
    assert work[1] < 16000 * 16000 / 50


def test_cells_that_prune_nothing_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric_index, "MANY", 100, raising=False)
    monkeypatch.setattr(metric_index, "BLOCK_BYTES", 10_000, raising=False)
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(900, 12)), clustered(300, 4, 12)])
    points = frame(spark, list(enumerate(x))).withColumnRenamed("v", "x")
    visits = metric_index.leaves(points, math.sqrt(2 - 2 * 0.4), leaf=30)
    assert visits.where("home").count() == len(x)
    assert visits.count() <= 64 * len(x)  # before: 97,072 rows of 1,200
    found = metric_index.near_pairs(points, 0.4, leaf=30).collect()
    assert {(p["i"], p["j"]) for p in found} == brute(x, 0.4)


def test_greedy_rounds(spark):
    x = clustered(400, 5, 6, centres=12)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, kept = u @ u.T >= 0.8, []
    for i in range(len(x)):
        if not near[i, kept].any():
            kept.append(i)
    got = search.semantic_dedupe(frame(spark, list(enumerate(x))), "id", "v", 0.8).collect()
    assert sorted(r["id"] for r in got) == kept
