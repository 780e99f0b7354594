import datetime as dt
import decimal
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import rows, selection, windows


@pytest.fixture(autouse=True)
def few_rows(monkeypatch):
    monkeypatch.setattr(selection, "FEW", 20)
    monkeypatch.setattr(selection, "BUCKETS", 16)
    monkeypatch.setattr(rows, "BUFFER", 5)


def table(spark, seed=0, n=900):
    r = random.Random(seed)
    return spark.createDataFrame([(
        r.choice([None, r.randint(-10**18, 10**18), (1 << 63) - 1, -(1 << 63), 5, 6]),
        r.choice([None, float("nan"), float("inf"), float("-inf"), r.gauss(0, 1), r.gauss(0, 1) * 1e300, 0.0]),
        r.choice([None, decimal.Decimal(r.randint(-10**9, 10**9)).scaleb(-4)]),
        dt.date(2020, 1, 1) + dt.timedelta(days=r.randint(0, 90)),
        dt.datetime(2020, 1, 1) + dt.timedelta(seconds=r.randint(0, 10**6)),
        r.choice([None, "", "a", "prefix-" + "x" * r.randint(0, 9) + r.choice("abz"), "prefix-é", "\0", "a\0"]),
        r.random() < 0.5) for _ in range(n)], "i long, x double, d decimal(20,4), day date, at timestamp, s string, b boolean").repartition(5)


@pytest.mark.parametrize("column", ["i", "x", "d", "day", "at", "s", "b"])
@pytest.mark.parametrize("way", ["asc", "desc"])
def test_first_rows_of_every_type(spark, column, way):
    df = table(spark, 1, 300)
    spec = rows.order_spec([(column, way)])
    every = [getattr(r, column) for r in df.orderBy(*spec).collect()]
    for k in (1, 150, 299):
        got = rows.top_n(df, k + 5 if k < 6 else k, [(column, way)])
        want = every[:k + 5 if k < 6 else k]
        assert sorted(map(repr, (r[column] for r in got.collect()))) == sorted(map(repr, want))


def test_several_columns_and_equal_rows(spark):
    df = table(spark, 2, 200).select("b", "day", "s")
    df = df.unionByName(df).unionByName(df.where("b"))
    spec = rows.order_spec("b desc, day asc, s desc")
    want = df.orderBy(*spec).limit(333).collect()
    got = rows.top_n(df, 333, "b desc, day asc, s desc").collect()
    assert list(map(tuple, got)) == list(map(tuple, want))
    one = spark.range(1000).select(F.lit(1).alias("c"))
    assert rows.top_n(one, 777, "c").count() == 777


def test_samples_have_their_size_and_repeat(spark):
    df = table(spark, 3)
    a = sorted(map(repr, rows.sample_percent(df, 33).collect()))
    assert len(a) == round(df.count() * 0.33)
    assert a == sorted(map(repr, rows.sample_percent(df.repartition(2), 33).collect()))
    assert rows.sample_rows(df, 500).count() == 500
    assert "TakeOrderedAndProject" not in rows.sample_percent(df, 33)._jdf.queryExecution().toString()


def test_quantiles_are_exact(spark):
    values = np.random.default_rng(4).normal(size=5000) ** 3
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    got = selection.quantiles(df, "v", [0.0, 0.25, 0.5, 0.731, 1.0])
    assert got == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.731, 1.0]), rel=1e-15)
    assert selection.quantiles(df.where("v > 1e9"), "v", [0.5]) == [None]
    split = windows.outlier(df, "v")
    assert split.passed.count() + split.rejected.count() == 5000


def test_distinct_on_keeps_order_at_the_edges(spark):
    low = -(1 << 63)
    df = spark.createDataFrame([(1, low, 1.0), (1, low + 1, 2.0), (2, low, float("nan")), (2, low, 3.0), (3, None, None), (3, low, 0.0)],
                               "k int, i long, x double")
    assert sorted((r.k, r.i) for r in rows.distinct_on(df, "k", "i desc").collect()) == [(1, low + 1), (2, low), (3, low)]
    got = {r.k: repr(r.x) for r in rows.distinct_on(df, "k", "x desc").collect()}
    assert got == {1: "2.0", 2: "nan", 3: "0.0"}
