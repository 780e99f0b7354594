"""Driver contract: entry runs, every oracle has a query, names line up."""

import duckdb

import __spark_entry__ as entry_mod
from tests.conftest import SF


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["r_name", "n_name", "revenue", "lines"]


def test_oracle_keys_subset_of_queries():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 150


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def test_sample_of_queries_against_oracle(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    for name in ["revenue_by_nation", "group_by", "distinct_on", "row_number_global", "cdc_diff", "expect", "text_search", "chunk_text"]:
        df = q[name](spark, SF)
        got = sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=repr)
        res = con.execute(o[name])
        cols = [d[0] for d in res.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        exp = sorted((tuple(plain(r[i]) for i in order) for r in res.fetchall()), key=repr)
        assert got == exp, name
