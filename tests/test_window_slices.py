"""Windows over hot keys cut into slices give what Spark's own windows give, value and
type, whatever the keys hold and are called."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import segmented, windows

SCHEMA = "n double, v string, fk int, at timestamp, i int, d decimal(31,10), wide decimal(38,10), x double, s string"


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(segmented, "ROWS", 25)
    monkeypatch.setattr(segmented, "SAMPLES", 8)


def rows(seed, n=400):
    r = random.Random(seed)
    base = dt.datetime(2024, 11, 3, 4, 30)
    out = []
    for i in range(n):
        key = r.choice([float("nan"), float("nan"), float("nan"), 0.0, -0.0, 1.5, None, float("inf")])
        out.append((key, r.choice(["a", "b", None]), r.choice([1, 1, 1, 2, None]), base + dt.timedelta(minutes=r.choice([0, 1, 9, 50]) + i // 3) if r.random() < 0.95 else None,
                    r.choice([i, i // 9, None]), r.choice([None, decimal.Decimal(r.randint(-10**30, 10**30)).scaleb(-10)]),
                    decimal.Decimal(r.randint(-10**34, 10**34)).scaleb(-10), r.choice([None, float(r.randint(-50, 50))]),
                    r.choice([None, "x", "y" * r.randint(0, 3)])))
    return out


@pytest.fixture(params=[1, 7])
def table(spark, request):
    return spark.createDataFrame(rows(request.param), SCHEMA).withColumn("id", F.monotonically_increasing_id()).repartition(request.param).cache()


def same(got, want):
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


KEYS = [["n"], ["n", "v", "fk"]]
ORDER = ["i", "id"]


def over(keys, *order):
    return Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])


@pytest.mark.parametrize("keys", KEYS)
def test_numbers_and_ranks(table, keys):
    w, plain = over(keys, *ORDER), over(keys, "i")
    same(windows.rank_rows(table, "row_number", keys, ORDER), table.withColumn("row_number", F.row_number().over(w).cast("bigint")))
    same(windows.rank_rows(table, "ntile", keys, ORDER, 5), table.withColumn("ntile", F.ntile(5).over(w).cast("bigint")))
    same(windows.rank_rows(table, "rank", keys, "i"), table.withColumn("rank", F.rank().over(plain).cast("bigint")))
    same(windows.rank_rows(table, "dense_rank", keys, "i"), table.withColumn("dense_rank", F.dense_rank().over(plain).cast("bigint")))


@pytest.mark.parametrize("offset", [1, 40])
def test_lag_and_lead(table, offset):
    for keys in (["n"],):
        w = over(keys, *ORDER)
        same(windows.lead_lag(table, "lag", "at", offset, keys, ORDER), table.withColumn("lag", F.lag("at", offset).over(w)))
        same(windows.lead_lag(table, "lead", "wide", offset, keys, ORDER), table.withColumn("lead", F.lead("wide", offset).over(w)))


@pytest.mark.parametrize("column", ["d", "i", "x", "s", "at"])
def test_running_aggregates(table, column):
    for function in {"d": ["sum", "avg"], "i": ["sum", "count"], "x": ["avg", "max"]}.get(column, ["min"]):
        f = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}[function]
        for keys in (["n"],):
            w = over(keys, *ORDER).rowsBetween(Window.unboundedPreceding, 0)
            same(windows.cumulative(table, column, ORDER, function, keys, "run"), table.withColumn("run", f(column).over(w)))


def test_running_sum_without_keys(table):
    w = Window.orderBy(*[F.col(c).asc_nulls_last() for c in ORDER]).rowsBetween(Window.unboundedPreceding, 0)
    same(windows.cumulative(table, "d", ORDER, "sum", None, "run"), table.withColumn("run", F.sum("d").over(w)))


@pytest.mark.parametrize("column", ["at", "wide", "x", "s"])
def test_fills(table, column):
    holes = table.withColumn(column, F.when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, F.col(column)))
    for keys in (["v"],):
        w = over(keys, *ORDER)
        down = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        up = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        same(windows.fill_forward(holes, column, ORDER, keys), holes.withColumn(column, down))
        same(windows.fill_backward(holes, column, ORDER, keys), holes.withColumn(column, up))


def test_sessions(table):
    for keys in (["n"], ["fk"]):
        one = table.where("at is not null").dropDuplicates([*keys, "at"])
        got = windows.sessionize(one, keys, "at", 5, "minutes")
        same(got, windows.sessionize(one, keys, "at", 5, "minutes", skew_safe=False))


def test_plan_has_no_second_shuffle(table):
    plan = windows.sessionize(table, "n", "at", 5)._jdf.queryExecution().toString()
    assert "__pid" not in plan


def test_backward_fills_read_every_row_once(table):
    """A frame that shrinks to the end of its partition is built anew for each row."""
    for keys, skew_safe in ((["n"], True), (["n"], False), (None, True)):
        plan = windows.fill_backward(table, "x", ORDER, keys, skew_safe=skew_safe)._jdf.queryExecution().toString()
        assert "unboundedfollowing" not in plan.lower()


def test_backward_fill_of_everything(table):
    up = F.first("x", ignorenulls=True).over(Window.orderBy(*[F.col(c).asc_nulls_last() for c in ORDER]).rowsBetween(0, Window.unboundedFollowing))
    same(windows.fill_backward(table, "x", ORDER), table.withColumn("x", up))


@pytest.mark.parametrize("function", ["rank", "dense_rank"])
def test_ranks_spread_the_rows_of_one_value(spark, function):
    """Only distinct order values are numbered: no window sorts the rows."""
    table = spark.range(3000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 5 > 0, F.lit(1.5)).alias("v"), "id").cache()
    plain = {"rank": F.rank, "dense_rank": F.dense_rank}[function]().over(over(["k"], "v")).cast("bigint")
    got = windows.rank_rows(table, function, "k", "v")
    same(got, table.withColumn(function, plain))
    assert f"{function}(" not in got._jdf.queryExecution().optimizedPlan().toString()
