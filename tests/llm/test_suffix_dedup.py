import random

import numpy as np
import pytest

from lakeloom.llm.bucket_refine import equal_buckets
from lakeloom.llm.registry import ORACLE, QUERIES
from lakeloom.llm.suffix_dedup import dedup_substrings, reference_cut
from pyspark.sql import functions as F

from .helpers import SF, documents, spark_rows, sql_rows


def cut(spark, rows, **kw):
    out = dedup_substrings(documents(spark, rows).coalesce(1), **kw)
    return sorted(map(tuple, out.select("doc_id", "n_bytes", F.col("n_bytes") - F.length("kept"), F.size("removed"),
                                        F.sha2("kept", 256)).collect()), key=repr)


def want(rows, length=100):
    return sorted(reference_cut(rows, length), key=repr)


def shuffled_texts(seed, n):
    """Texts that share passages, whole copies, periods and one very common passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(60) for _ in range(6)]
    common = prose(40)
    out = []
    for i in range(n):
        text = prose(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            text += r.choice(passages)[r.randint(0, 80):] + prose(r.randint(0, 30))
        if r.random() < 0.6:
            text = prose(3) + common + text
        if r.random() < 0.1:
            text += r.choice(["x", "ab", "abc"]) * r.randint(60, 300)
        if out and r.random() < 0.2:
            text = r.choice(out)[1]
        out.append((i, text))
    return out


@pytest.mark.parametrize("hot", [4096, 2, 0])
def test_random_texts(spark, hot):
    rows = shuffled_texts(hot, 120)
    assert cut(spark, rows, hot=hot) == want(rows)


def test_other_length(spark):
    rows = shuffled_texts(9, 60)
    assert cut(spark, rows, length=72) == want(rows, 72)
    with pytest.raises(ValueError):
        dedup_substrings(documents(spark, rows), length=70)


def test_long_text_and_nulls(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh ") for _ in range(1_150_000))
    rows = [(5, None), (6, ""), (7, long), (8, "q" + long[990_000:1_010_500] + "r" + long[:150]), (9, long[-99:]), (10, "a" * 99),
            (11, "a" * 100), (12, "a" * 101), (13, "a" * 350)]
    assert cut(spark, rows) == want(rows)


def test_repeated_rows_and_null_ids(spark):
    a, b = "one passage of the text that is long enough to count " * 3, "another passage, as long as the first or longer still " * 3
    rows = [(None, a), (3, b), (3, b), (1, a), (None, b), (2, "x" + a + b)]
    assert cut(spark, rows) == want(rows)


def test_empty_table(spark):
    assert cut(spark, [(1, "x")], )[0][:4] == (1, 1, 0, 0)
    assert dedup_substrings(documents(spark, [(1, "x")]).where("false")).count() == 0


def test_spans_are_the_removed_bytes(spark):
    rows = shuffled_texts(4, 30)
    texts = {i: t.encode() for i, t in rows}
    for r in dedup_substrings(documents(spark, rows)).collect():
        at, kept = 0, b""
        for s, e in r["removed"]:
            kept += texts[r["doc_id"]][at:s]
            at = e
        assert kept + texts[r["doc_id"]][at:] == bytes(r["kept"])


def test_buckets_against_sorting():
    r = np.random.default_rng(3)
    for n, letters in ((4000, 2), (4000, 4), (300, 1)):
        data = r.integers(0, letters, n).astype(np.uint8)
        if letters > 1:
            data[2000:2500] = data[100:600]
        starts = np.arange(n - 15)
        groups: dict = {}
        for s in starts:
            groups.setdefault(data[s:s + 16].tobytes(), []).append(int(s))
        expected = sorted(g for g in groups.values() if len(g) > 1)
        at, bucket = equal_buckets(data, starts, 16)
        found: dict = {}
        for s, k in zip(at.tolist(), bucket.tolist()):
            found.setdefault(k, []).append(s)
        assert sorted(map(sorted, found.values())) == expected


def test_against_sql(spark):
    assert spark_rows(QUERIES["op11_suffix_array_dedup"](spark, SF)) == sql_rows(ORACLE["op11_suffix_array_dedup"])
