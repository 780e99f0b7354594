import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import lexical_search
from lakeloom.llm.lexical_search import Best, WeightTiles, ranked_search
from lakeloom.llm.registry import ORACLE, QUERIES

from .helpers import SF, documents, lower, spark_rows, sql_rows


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in wanted.items():
        found = []
        for (doc, c), size in zip(counts, sizes):
            m = 50 + (50 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in ts if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("rank", F.lit("clash")).withColumn("item", F.lit("clash"))


def search(spark, docs, items, **kw):
    got = ranked_search(documents(spark, docs), benchmark(spark, items), **kw)
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_random_texts_with_ties(spark, seed):
    r = random.Random(seed)
    say = lambda: r.choice([" ", "-", "\n"]).join(r.choice("Ab ab c Éa éa z9 rare the".split()) for _ in range(r.randint(0, 12)))
    docs = [(i, say()) for i in range(400)] + [(7, "rare"), (7, "rare"), (None, "rare z9"), (401, None), (402, ""), (403, "!!")]
    items = [(i, say()) for i in range(8)] + [(20, None), (21, "?"), (22, "absent"), (3, "rare"), (None, "z9"), (None, "c")]
    assert search(spark, docs, items) == brute(docs, items)
    assert search(spark, docs, items, k=3) == brute(docs, items, 3)


def test_several_groups_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS", 3)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 30)))) for i in range(200)]
    items = [(i, " ".join(r.choices(vocabulary, k=10))) for i in range(11)]
    assert search(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert search(spark, [(1, None)], [(1, "a")]) == []
    empty = documents(spark, [(1, "a")]).where("false")
    assert ranked_search(empty, benchmark(spark, [(1, "a")])).count() == 0
    assert ranked_search(documents(spark, [(1, "a")]), benchmark(spark, [(1, "a")]).where("false")).count() == 0


def test_long_text(spark):
    docs = [(1, "common " * 300_000 + "rare"), (2, "rare common"), (3, "other")]
    assert search(spark, docs, [(1, "rare common")]) == brute(docs, [(1, "rare common")])


def test_tiles_stay_exact():
    r = np.random.default_rng(0)
    terms, items, docs = 300, 7, 20
    weights = r.integers(1, 40_000, terms)
    holds = r.random((terms, items)) < 0.7
    term, item = np.nonzero(holds)
    impact = r.integers(0, 10**6, (terms, docs))
    at, doc = np.nonzero(impact)
    for heaviest in (1, EXACT_SMALL):  # the second leaves two terms a tile
        w = weights.copy()
        w[0] = max(w[0], heaviest)
        tiles = WeightTiles(term, item, w, items)
        assert tiles.terms * w.max() * lexical_search.IMPACT < lexical_search.EXACT
        got = tiles.scores(doc, at, impact[at, doc], docs)
        want = (holds * w[:, None]).T.astype(object) @ impact.astype(object)
        assert (got == want.astype(np.int64)).all()


EXACT_SMALL = (1 << 53) // (2 * 10**6) - 1


def test_ties_at_the_border_go_to_smaller_ids():
    best = Best(1, 2)
    best.add(np.array([[5, 5, 5]]), np.array([30, 20, 10]), np.zeros(3, bool))
    best.add(np.array([[5, 4, 5]]), np.array([5, 1, 40]), np.zeros(3, bool))
    assert list(zip(best.score, best.doc)) == [(5, 5), (5, 10)]


def test_against_sql(spark):
    assert spark_rows(QUERIES["op12_ranked_search"](spark, SF)) == sql_rows(ORACLE["op12_ranked_search"])
