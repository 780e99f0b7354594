import hashlib

from pyspark.sql import functions as F

from lakeloom.llm import line_dedup as m

from .helpers import documents, lower, spark_rows, sql_rows

LONG = "a passage that many documents share"
ROWS = [
    (3, f"{LONG}\nown line of three\nshort\nshort"),
    (1, f"  {LONG.upper()}\t\nshort\n{LONG}"),
    (2, f"{LONG}\n\n\nÉTÉ is kept in capitals"),
    (2, f"{LONG}\n\n\nÉTÉ is kept in capitals"),          # a repeated row
    (5, "été is kept in capitals\nÉTÉ is kept in capitals"),
    (7, None), (8, ""), (9, "\n"), (None, f"{LONG}\nonly the null id has this"),
    (-4, "nine char\nnine char"), (6, "nine char"),
    (10, "\n".join(f"line number {i} of a long text" for i in range(3000))),
    (11, "\n".join(f"line number {i} of a long text" for i in range(0, 6000, 2))),
]


def brute(rows):
    owner = {}
    last = 1 << 63
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(" \t\n\x0b\f\r"))
            if len(key) >= 10:
                owner[key] = min(owner.get(key, last), last if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(lower(x.strip(" \t\n\x0b\f\r")), last if doc is None else doc) == (last if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n"], r["g"], r["t"]) for r in df.select(
        "doc_id", F.size("__lines").alias("n"), F.coalesce(F.size("__dropped"), F.lit(0)).alias("g"),
        m.kept_text().alias("t")).collect()), key=repr)


def test_awkward_rows_match_brute_force(spark):
    docs = documents(spark, ROWS)
    want = brute(ROWS)
    for batches, fanout in ((1, 2), (3, 2), (6, 3)):
        got = result(m.dedup_lines(docs, batches=batches, fanout=fanout))
        assert [(a, b, max(c, 0), d) for a, b, c, d in got] == want


def test_runs_compact_by_level(spark):
    runs = m.SortedRuns(spark, fanout=2, buckets=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(i, i, b) for i in range(b, b + 3)], "h1 long, h2 long, owner long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    rows = sorted(tuple(r) for run in runs.runs() for r in run.collect())
    assert rows == sorted((i, i, max(0, i - 2)) for i in range(7))  # each key belongs to its first batch


def test_query_matches_sql(spark):
    from .helpers import SF

    assert spark_rows(m.op10_line_dedup(spark, SF)) == sql_rows(m.SQL)


def test_stage_keeps_columns_and_empty_table(spark):
    docs = documents(spark, ROWS)
    out = m.dedup_stage(spark, docs, "")
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert m.dedup_stage(spark, docs.limit(0), "").count() == 0


def test_digest_is_of_utf8(spark):
    row = m.dedup_lines(documents(spark, [(1, "été")])).select(F.sha2(m.kept_text().cast("binary"), 256).alias("h")).first()
    assert row["h"] == hashlib.sha256("été".encode()).hexdigest()
