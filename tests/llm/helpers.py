"""Small tables with the awkward rows every operator must take: nulls, empty and
long texts, repeated rows and ids, and extra columns with clashing names."""

import os
import re

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "id rid size key text_ pos line lines d b h1 pass shard words rank cid c1 c2 bands n labels score ids grams template v vv".split()


def documents(spark, rows, extra=True):
    """``rows``: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA).repartition(3)
    if extra:
        for c in CLASHING:
            df = df.withColumn(c, F.lit("clash"))
    return df


def sf_documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sql_rows(sql, sf=SF, **tables):
    """Rows of DuckDB SQL over the driver tables or given pandas frames."""
    import duckdb

    con = duckdb.connect()
    for name in "documents embeddings conversations labels pages benchmark".split():
        if name in tables:
            con.register(name, tables[name])
        elif os.path.exists(f"{sf}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(map(repr, (tuple(r[i] for i in sorted(range(len(names)), key=lambda i: names[i])) for r in got.fetchall())))


def spark_rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
