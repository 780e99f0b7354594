from collections import defaultdict

import numpy as np

from lakeloom.llm import ngram_join as m

from .helpers import SF, documents, lower, sf_documents, words


def brute(rows, k=5, threshold=0.8):
    """Links of each row, and the smallest id of its component."""
    sets = []
    for _, text, *_ in rows:
        w = words(lower(text or ""))
        sets.append({tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            inter = len(a & b)
            if not a and not b or inter and inter >= threshold * (len(a) + len(b) - inter):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], links[i], least[find(i)]) for i, r in enumerate(rows)), key=repr)


def group_rows(df):
    return sorted(((r["id"], r["n_links"], r["class_id"]) for r in df.collect()), key=repr)


def near_copies(n, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(200, 1 + i % 4, replace=False):
            w[at] = f"new{i}_{at}"
        out.append((1000 + i, " ".join(w)))
    return out


ROWS = near_copies(300) + [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "ONE  two\nthree"), (6, "one two four"),
    (7, "a b c d e"), (7, "a b c d e"), (7, "quite another text under the same id as before"), (None, "a b c d e"), (None, "x y z u v w"),
    (9, "été " * 50), (10, "ÉTÉ " * 50), (11, "long " * 30000), (12, "long " * 30000 + "end"),
]


def test_awkward_rows_and_a_large_group_match_brute_force(spark):
    docs = documents(spark, ROWS).selectExpr("doc_id AS id", "text", "size")
    assert group_rows(m.jaccard_groups(docs)) == brute(ROWS)


def test_chunks_of_a_bucket_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 16)
    rows = near_copies(90, seed=2)
    assert group_rows(m.jaccard_groups(documents(spark, rows).selectExpr("doc_id AS id", "text"))) == brute(rows)


def test_driver_documents_match_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in sf_documents(spark).collect()]
    got = m.op5_ngram_jaccard_join(spark, SF).collect()
    assert sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in got), key=repr) == brute(rows)


def test_bands_reach_the_recall():
    bands, rows = m.choose_bands(0.8, 0.9995, 104)
    assert bands * rows <= 104 and 1 - (1 - 0.8 ** rows) ** bands >= 0.9995


def test_stage_keeps_one_of_each_group(spark):
    docs = documents(spark, ROWS)
    out = m.one_per_group(spark, docs, "")
    assert out.dtypes == docs.dtypes
    want = {(c if c is not None else None) for _, _, c in brute(ROWS)}
    got = [r["doc_id"] for r in out.collect()]
    # id 7 stands on two different texts, each the smallest of its group
    assert sorted(map(str, got)) == sorted([str(x) for x in want] + ["7"])
    assert m.one_per_group(spark, docs.limit(0), "").count() == 0
