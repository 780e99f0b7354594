import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import mixing as m

from .helpers import SF, documents, sf_documents, words


def filled(sizes, weights=(5, 2, 1), share=1.5, passes=2):
    """Water filling by repeated sharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if passes * sizes[s] <= left * w[s] / total]
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            target[s] = passes * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    return target


def mixed(spark, docs, **options):
    rows = m.document_rows(docs)
    pieces, targets = m.mix(rows.select("rid", "key", "source", "size"), **options)
    return rows, pieces, targets


ROWS = ([(i, "w " * (i % 37), "en", f"s{i % 4}") for i in range(300)] + [(300 + i, "x y", "en", None) for i in range(20)]
        + [(400, None, "en", "s1"), (401, "", "en", "empty"), (402, "one word here two", "en", "Z")]
        + [(500, "a b c", "en", "s0")] * 5 + [(None, "long " * 9000, "en", "long")])


def test_targets_and_pieces(spark):
    docs = documents(spark, ROWS)
    rows, pieces, targets = mixed(spark, docs, block_words=64, depth=3)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    want = filled(sizes)
    got = {r["source"]: r for r in targets.collect()}
    assert set(got) == set(want)
    for s, t in want.items():
        assert got[s]["source_size"] == sizes[s] and math.isclose(got[s]["target"], t, rel_tol=1e-9, abs_tol=1e-6)
    by = rows.join(pieces, "rid").collect()
    taken = Counter()
    for r in by:
        assert 0 <= r["start"] and r["start"] + r["words"] <= r["size"] and r["words"] > 0 and 0 <= r["shard"] < 8
        taken[r["source"]] += r["words"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 1
    # a word is taken at most once in a pass, and there are two passes
    spans = {}
    for r in by:
        spans.setdefault((r["rid"], r["pass"]), []).append((r["start"], r["start"] + r["words"]))
    for parts in spans.values():
        parts.sort()
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    assert {p for _, p in spans} == {0, 1}


def test_query_reruns_agree_and_stay_within_bounds(spark):
    a = sorted(map(tuple, m.op2_mix_sources(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(map(tuple, m.op2_mix_sources(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
    text = {r["doc_id"]: r["text"] for r in sf_documents(spark).collect()}
    assert {r[0]: r[1] for r in a} == {i: len(words(t)) for i, t in text.items()}
    assert all(0 <= r[4] <= 2 * r[1] for r in a)


def test_quotas_are_split_exactly(spark):
    targets = spark.createDataFrame([(0, 1000), (1, 37), (2, 0), (3, 5)], "rank long, quota long")
    ends = {r["rank"]: r["ends"] for r in m.split_quotas(targets, 4, 7).collect()}
    assert {k: v[-1] for k, v in ends.items()} == {0: 1000, 1: 37, 2: 0, 3: 5}
    shards = [sum(v[i] - (v[i - 1] if i else 0) for v in ends.values()) for i in range(16)]
    assert max(shards) - min(shards) <= 1 and sum(shards) == 1042


@pytest.mark.parametrize("n_all,marked,drawn", [(20, 7, 9), (5000, 40, 2500), (3, 3, 2)])
def test_draws_follow_the_hypergeometric_distribution(spark, n_all, marked, drawn):
    n = 4000
    got = Counter(r["x"] for r in spark.range(n).select(m.hypergeometric(
        F.lit(n_all).cast("long"), F.lit(marked).cast("long"), F.lit(drawn).cast("long"), (F.col("id") + 0.5) / n).alias("x")).collect())
    for x in range(marked + 1):
        p = math.comb(marked, x) * math.comb(n_all - marked, drawn - x) / math.comb(n_all, drawn) if 0 <= drawn - x <= n_all - marked else 0
        assert abs(got[x] / n - p) < 2 / n + 1e-9  # u runs over a grid: counts are exact to a step


def test_stage_texts_are_cut_from_the_documents(spark):
    docs = documents(spark, [(1, " a\tb\n\nc  d e ", "en", "x"), (2, "p q r s t u v w x y z " * 30, "en", "y"), (3, None, "en", "y"),
                             (4, "k l\nm", "en", "z"), (4, "k l\nm", "en", "z")])
    out = m.mix_stage(spark, docs, "")
    assert out.dtypes == docs.dtypes
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = out.collect()
    assert rows and all(r["text"] in text[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["text"] == text[1] for r in rows) == 2  # weight 5: taken whole twice, space and all
    assert m.mix_stage(spark, docs.limit(0), "").count() == 0
