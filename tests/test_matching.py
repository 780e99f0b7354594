"""Fuzzy matching, clustering, search and vectors, checked against brute
force on small fixtures and on the sf0.001 tables."""

import math
import random
from collections import Counter

from lakeloom.operators import geo, graph, search, similarity
from tests.conftest import SF
from tests.test_batch_similarity import jaro_winkler as jaro_winkler_py  # letter by letter


def test_record_match_fixture(spark):
    df = spark.createDataFrame([(1, "Acme Inc"), (2, "Acme Inc."), (3, "Globex")], "id int, name string")
    out = similarity.record_match(df, "name", "jaro-winkler", 0.85).collect()
    assert len(out) == 1 and out[0].id == 1 and out[0].matched_key == "acme inc."


def test_fuzzy_dedupe_fixture(spark):
    df = spark.createDataFrame([(1, "Acme Inc"), (2, "Acme Inc."), (3, "Globex"), (4, "globex")], "id int, name string")
    assert sorted(r.id for r in similarity.fuzzy_dedupe(df, "name", "jaro-winkler", 0.9).collect()) == [1, 3]


def test_record_link_fixture(spark):
    a = spark.createDataFrame([(1, "Acme Inc"), (2, "Globex Corporation"), (3, "Initech")], "cust_id int, name string")
    b = spark.createDataFrame([(1, "Acme Incorporated"), (2, "Globex Corp"), (3, "Umbrella")], "ref_id int, company string")
    pairs = {(r.left_key, r.right_key) for r in similarity.record_link(a, b, "name", "company", "jaro-winkler", 0.85).collect()}
    assert ("Acme Inc", "Acme Incorporated") in pairs


def _brute_pairs(keys, t):
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            x, y = min(a, b), max(a, b)
            if x != y and jaro_winkler_py(x, y) >= t:
                out.add((x, y))
    return out


def test_key_pairs_exact_against_brute_force(spark):
    rnd = random.Random(7)
    words = ["acme", "globex", "initech", "umbrella", "hooli", "stark", "wayne", "wonka", "tyrell", "cyberdyne"]
    keys = sorted({" ".join(rnd.sample(words, rnd.randint(1, 2))) + rnd.choice(["", "s", " inc", " co", "x"]) for _ in range(300)})
    df = spark.createDataFrame([(k,) for k in keys], "_key string")
    for t in (0.8, 0.9):
        got = {(r.k1, r.k2) for r in similarity.key_pairs(df, None, "jaro-winkler", t).collect()}
        assert got == _brute_pairs(keys, t)


def test_record_match_on_table_matches_brute_force(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name")
    rows = sorted(((r.p_name.lower(), r.p_partkey, r.p_name) for r in part.collect()))
    expect = Counter()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            s = jaro_winkler_py(a[0], b[0])
            if s >= 0.9:
                expect[(a[1], b[0], round(s, 4))] += 1
    got = Counter((r.p_partkey, r.matched_key, r.match_score) for r in similarity.record_match(part, "p_name", "jaro-winkler", 0.9).collect())
    assert got == expect


def test_match_groups(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d"), ("e", None)], "id_a string, id_b string")
    out = {r.id: r.cluster_id for r in graph.match_groups(df).collect()}
    assert out == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_match_groups_long_chain(spark):
    n = 300
    df = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)], "id_a string, id_b string")
    assert {r.cluster_id for r in graph.match_groups(df).collect()} == {"n0000"}


def _bm25(docs, query):
    toks = {i: [t for t in "".join(c if "a" <= c <= "z" else " " for c in txt.lower()).split()] for i, txt in docs}
    n, avg = len(toks), sum(len(v) for v in toks.values()) / len(toks)
    terms = list(dict.fromkeys(query.lower().split()))
    dfreq = {t: sum(1 for v in toks.values() if t in v) for t in terms}
    out = {}
    for i, v in toks.items():
        s = 0.0
        for t in terms:
            tf = v.count(t)
            if tf:
                idf = math.log10(1 + (n - dfreq[t] + 0.5) / (dfreq[t] + 0.5))
                s += idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(v) / avg))
        if s:
            out[i] = s
    return out


def test_text_search_fixture_and_brute_force(spark):
    docs = [(1, "duck duck goose"), (2, "the quick brown fox"), (3, "duckdb is fast for analytics")]
    df = spark.createDataFrame(docs, "id int, body string")
    assert [r.id for r in search.text_search(df, "id", "body", "duck").collect()] == [1]
    got = {r.id: r.score for r in search.text_search(df, "id", "body", "the duck fox", stop_words=(), stemming=False).collect()}
    exp = _bm25(docs, "the duck fox")
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-9 for k in exp)


def test_vector_search_fixture(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.1, 0.0])], "id int, vec array<float>")
    top = search.vector_search(df, "vec", [0.9, 0.1, 0.0], 3, "cosine", top_k=2).collect()
    assert top[0].id == 3 and len(top) == 2


def _greedy(vecs, t):
    kept = []
    for i, v in sorted(vecs.items()):
        nv = math.sqrt(sum(x * x for x in v))
        if not any(sum(a * b for a, b in zip(v, vecs[j])) / (nv * math.sqrt(sum(x * x for x in vecs[j]))) >= t for j in kept):
            kept.append(i)
    return kept


def test_semantic_dedupe_fixture_and_brute_force(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0]), (4, [0.7, 0.7])], "id int, embedding array<float>")
    assert sorted(r.id for r in search.semantic_dedupe(df, "id", "embedding", 0.95).collect()) == [1, 3, 4]
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    vecs = {r.vec_id: [float(x) for x in r.embedding] for r in emb.collect()}
    for t in (0.4, 0.3):
        got = sorted(r.vec_id for r in search.semantic_dedupe(emb, "vec_id", "embedding", t).collect())
        assert got == _greedy(vecs, t)


def test_spatial_join_fixture(spark):
    pts = spark.createDataFrame([(1, "POINT(1 1)"), (2, "POINT(5 5)"), (3, "POINT(9 9)")], "id int, geom string")
    polys = spark.createDataFrame([("a", "POLYGON((0 0, 6 0, 6 6, 0 6, 0 0))"), ("b", "POLYGON((4 4, 10 4, 10 10, 4 10, 4 4))")],
                                  "name string, area string")
    inner = sorted((r.id, r.name) for r in geo.join_spatial(pts, polys, "geom", "area").collect())
    assert inner == [(1, "a"), (2, "a"), (2, "b"), (3, "b")]
    far = spark.createDataFrame([(4, "POINT(50 50)")], "id int, geom string")
    left = geo.join_spatial(pts.unionByName(far), polys, "geom", "area", join_type="left").collect()
    assert sorted((r.id, r.name) for r in left if r.id == 4) == [(4, None)]


def test_copies_of_few_pairs_are_made_by_many_tasks(spark):
    # before, a key's copies were made by the one task that held the key
    from pyspark.sql import functions as F

    df = spark.range(600).select(F.col("id"), F.when(F.col("id") % 2 == 0, "acme limited").otherwise("acme limitid").alias("name"))
    for out, n in ((similarity.record_match(df, "name", "jaro-winkler", 0.85), 600 * 599 // 2),
                   (similarity.record_link(df, df, "name", "name"), 600 * 600)):
        per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per_task) == n and len(per_task) >= 8 and max(per_task) <= n / 4


def test_more_copies_take_more_tasks_not_longer_ones(spark, monkeypatch):
    # before, the copies were dealt over spark.sql.shuffle.partitions tasks however many there were
    from pyspark.sql import functions as F

    monkeypatch.setattr(similarity, "COPIES", 100)
    monkeypatch.setattr(similarity, "TASK_ROWS", 5_000, raising=False)
    df = spark.range(600).select(F.col("id"), F.when(F.col("id") % 2 == 0, "acme limited").otherwise("acme limitid").alias("name"))
    for out, n in ((similarity.record_match(df, "name", "jaro-winkler", 0.85), 600 * 599 // 2),
                   (similarity.record_match(df, "name", "levenshtein", 0.75), 600 * 599 // 2),
                   (similarity.record_link(df, df, "name", "name"), 600 * 600)):
        per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per_task) == n and max(per_task) <= 2 * 5_000
    none = similarity.record_match(df.where("id < 0"), "name", "jaro-winkler", 0.85)
    assert none.count() == 0 and similarity.record_link(df.where("id < 0"), df, "name", "name").count() == 0
