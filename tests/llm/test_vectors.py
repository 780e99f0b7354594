import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import lattice, lattice_dedup, vptree_search
from lakeloom.llm.vectors import pair_cosines, unit

from .helpers import SF, spark_rows, sql_rows

SF01 = "/root/testdata/sf0.01"


def table(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows],
                               "vec_id long, embedding array<float>").repartition(3)
    for c in ("id", "v", "vv", "ball", "key", "shard", "dim", "rank", "label"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def at_cosine(rng, a, c):
    """A unit vector at cosine c of each row of a."""
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(axis=1, keepdims=True) * a
    return c * a + np.sqrt(1 - c * c) * unit(n)


def usable_rows(rows):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None for x in v):
            continue
        x = np.array(v, np.float32).astype(float)
        if np.isfinite(x).all() and x.any():
            best[i] = min(best.get(i, x.tolist()), x.tolist())
    return best


ODD = [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [1.0] * 23 + [None]), (9005, [float("nan")] + [1.0] * 23),
       (9006, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (9007, [1.0, 2.0, 3.0]), (9008, [2.0, 4.0, 6.0]), (9009, [3e38] * 24), (9050, [1e-30] * 24)]


def planted(seed=0):
    rng = np.random.default_rng(seed)
    a = unit(rng.normal(size=(120, 24)))
    group = at_cosine(rng, np.repeat(a[:1], 150, axis=0), 0.985)   # a large group of near copies
    wide = at_cosine(rng, np.repeat(a[1:2], 60, axis=0), 0.972)    # near its centre, not all near each other
    far = at_cosine(rng, a[2:60], 0.90)
    near = at_cosine(rng, a[60:120], 0.965)
    x = np.concatenate([a, group, wide, far, near, np.repeat(a[5:6], 40, axis=0), 2 * a[6:7]])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    return rows + rows[:3] + [(rows[0][0], rows[7][1])] + ODD  # repeated rows, one id with two vectors


def brute_links(rows, threshold=0.95):
    best = usable_rows(rows)
    ids = sorted(best)
    links, parent = {i: 0 for i in ids}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(best[i]) == len(best[j]):
                a, b = unit(np.array([best[i]])), unit(np.array([best[j]]))
                if float((a * b).sum()) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return {i: (links[i], find(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rows = planted()
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in lattice_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_every_row_is_returned(spark, tmp_path):
    rows = planted(1)
    path = str(tmp_path / "embeddings.parquet")
    table(spark, rows).write.parquet(path)
    out = lattice_dedup.op3_lattice_dedup(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    want = brute_links(rows)
    for r in out:
        links, component = want.get(r["vec_id"], (0, r["vec_id"]))
        assert (r["n_links"], r["component_id"], r["kept"]) == (links, component, component == r["vec_id"])


def test_empty_tables(spark):
    assert lattice_dedup.near_duplicates(table(spark, ODD).limit(0)).count() == 0
    assert vptree_search.nearest(table(spark, ODD).limit(0), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("module,name", [(lattice_dedup, "op3_lattice_dedup"), (vptree_search, "op9_vptree_search")])
def test_queries_match_sql(spark, module, name):
    for sf in (SF, SF01):
        assert spark_rows(getattr(module, name)(spark, sf)) == sql_rows(module.SQL, sf)


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = unit(rng.normal(size=(2000, 64)))
    b = at_cosine(rng, a, 0.951)
    spaces = lattice.rotations(64, 1, 29)
    found = np.zeros(len(a), bool)
    for t, space in enumerate(spaces):
        y, z = a @ space / lattice_dedup.WIDTH, b @ space / lattice_dedup.WIDTH
        ha, hb = lattice.decode(y), lattice.decode(z)
        ka, kb = lattice.cell_keys(ha, t), lattice.cell_keys(hb, t)
        pa, pb = (lattice.cell_keys(lattice.probes(u, h, lattice_dedup.PROBES), t) for u, h in ((y, ha), (z, hb)))
        found |= (ka == kb) | (pa == kb[:, None]).any(axis=1) | (pb == ka[:, None]).any(axis=1)
    assert found.mean() >= 0.998


def test_decoding_gives_the_nearest_lattice_point():
    rng = np.random.default_rng(4)
    assert len(lattice.ROOTS) == 240 and (np.square(lattice.ROOTS).sum(axis=1) == 8).all()
    y = rng.normal(0, 3, (500, 8))
    p = lattice.decode(y)
    assert ((p % 2 == p[:, :1] % 2).all(axis=1) & (p.sum(axis=1) % 4 == 0)).all()
    own = np.square(2 * y - p).sum(axis=1)
    around = np.square((2 * y - p)[:, None, :] - lattice.ROOTS[None]).sum(axis=2)
    assert (own[:, None] <= around + 1e-9).all()


def brute_nearest(rows, k=5):
    best = usable_rows(rows)
    ids = sorted(best)
    out = []
    for q in ids:
        if q % 50:
            continue
        others = [i for i in ids if i != q and len(best[i]) == len(best[q])]
        if others:
            s = pair_cosines(np.array([best[q]] * len(others)), np.array([best[i] for i in others]))
            out += [(q, n + 1, others[j], s[j]) for n, j in enumerate(np.lexsort((others, -s))[:k])]
    return out


def test_exact_search_matches_brute_force(spark):
    rows = planted(2)
    got = sorted(tuple(r) for r in vptree_search.nearest(table(spark, rows), F.col("id") % 50 == 0, factor=1.0,
                                                         shard_rows=90, query_block=3).collect())
    assert got == sorted(brute_nearest(rows))


def test_relaxed_search_prunes_and_keeps_recall():
    rng = np.random.default_rng(5)
    centres = unit(rng.normal(size=(40, 16)))
    x = unit(np.repeat(centres, 100, axis=0) + rng.normal(0, 0.05, (4000, 16)))
    q = unit(np.repeat(centres, 3, axis=0) + rng.normal(0, 0.05, (120, 16)))
    true = np.argsort(vptree_search.distances(q, x), axis=1)[:, :5]
    seen = {}
    for factor in (1.0, vptree_search.FACTOR):
        tree = vptree_search.VantageTree(x)
        found, d = tree.search(q, 5, factor)
        seen[factor] = tree.visited
        recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.tolist(), true.tolist())])
        assert recall >= (1.0 if factor == 1.0 else 0.9)
        assert (np.diff(d, axis=1) >= 0).all()
    assert seen[vptree_search.FACTOR] <= seen[1.0] < 0.7 * x.shape[0] * len(q)


def test_ties_of_many_multiples_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(5)
    base = np.abs(rng.normal(size=8)) + 0.1
    x = np.concatenate([base * 2.0 ** np.arange(-40, 40)[:, None], rng.normal(size=(120, 8))])  # 80 equal directions
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    got = sorted(tuple(r) for r in vptree_search.nearest(table(spark, rows), F.col("id") % 5 == 0, factor=1.0).collect())
    want = []
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q in sorted(vectors):
        if q % 5 == 0:
            others = [i for i in sorted(vectors) if i != q]
            score = pair_cosines(np.repeat(vectors[q][None, :], len(others), 0), np.stack([vectors[i] for i in others]))
            best = np.lexsort((others, -score))[:5]
            want += [(q, rank, others[b]) for rank, b in enumerate(best, 1)]
    assert [g[:3] for g in got] == want
