"""Small fixtures with exact expected rows for columns, rows, aggregates,
joins, set operations and windows."""

import datetime as dt

from pyspark.sql import functions as F

from lakeloom.operators import aggregate as agg
from lakeloom.operators import columns as cols
from lakeloom.operators import joins as jn
from lakeloom.operators import rows
from lakeloom.operators import windows as win


def test_filter_and_reject_cover_input(spark):
    df = spark.createDataFrame([(1, "paid", 10), (2, "pending", 20), (3, "paid", 30), (4, "refunded", 5), (5, None, 1)],
                               "order_id int, status string, amount int")
    s = cols.filter_split(df, "status = 'paid'")
    assert sorted(r.order_id for r in s.passed.collect()) == [1, 3]
    assert sorted(r.order_id for r in s.rejected.collect()) == [2, 4, 5]  # NULL predicate rejects


def test_group_by_and_default_alias(spark):
    df = spark.createDataFrame([("west", 10), ("west", 20), ("east", 5), ("east", 15), ("east", 5)], "region string, amount int")
    out = {r.region: r.sum_amount for r in agg.group_by(df, "region", [{"column": "amount", "func": "sum"}]).collect()}
    assert out == {"west": 30, "east": 25}
    assert agg.group_by(df).collect()[0].row_count == 5


def test_rollup_total(spark):
    df = spark.createDataFrame([("west", 10), ("east", 20)], "region string, amount int")
    out = agg.rollup(df, "region", [{"column": "amount", "func": "sum", "output": "total"}]).collect()
    assert len(out) == 3 and {r.total for r in out if r.region is None} == {30}


def test_collect_list_keeps_nulls_last(spark):
    df = spark.createDataFrame([("a", 2), ("a", None), ("a", 1), ("b", 9)], "g string, v int")
    out = {r.g: r.items for r in agg.collect_list(df, "v", "g").collect()}
    assert out["a"] == [1, 2, None] and out["b"] == [9]


def test_distinct_on_minimum_row(spark):
    df = spark.createDataFrame([("a", 9), ("a", 2), ("a", 5)], "g string, v int")
    assert [tuple(r) for r in rows.distinct_on(df, "g").collect()] == [("a", 2)]
    assert [tuple(r) for r in rows.distinct_on(df, "g", [("v", "desc")]).collect()] == [("a", 9)]


def test_rank_filter_top2(spark):
    data = [("us", "a", 100), ("us", "b", 80), ("us", "c", 60), ("us", "d", 40), ("eu", "e", 90), ("eu", "f", 70), ("eu", "g", 50)]
    df = spark.createDataFrame(data, "region string, user string, amount int")
    users = sorted(r.user for r in rows.rank_filter(df, "region", "amount", 2).collect())
    assert users == ["a", "b", "e", "f"]


def test_survivor_most_recent_skips_null(spark):
    df = spark.createDataFrame([(1, "Jon", "111", 1), (1, "Jonathan", None, 2), (2, "Amy", "333", 1)],
                               "id int, name string, phone string, updated int")
    out = {r.id: (r.name, r.phone, r.updated) for r in agg.survivor(df, "id", "most_recent", "updated").collect()}
    assert out[1] == ("Jonathan", "111", 2) and out[2] == ("Amy", "333", 1)


def test_denormalize_aligned(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", None), ("b", "z", "3")], "g string, v string, w string")
    out = {r.g: (r.v, r.w) for r in agg.denormalize(df, "g", ["v", "w"]).collect()}
    assert out == {"a": ("x, y", "1"), "b": ("z", "3")}


def test_join_keeps_one_key(spark):
    l = spark.createDataFrame([(1, "alice"), (2, "bob")], "id int, name string")
    r = spark.createDataFrame([(1, "paris"), (3, "oslo")], "id int, city string")
    out = jn.join_inner(l, r, "id").collect()
    assert [tuple(x) for x in out] == [(1, "alice", "paris")] and out[0].__fields__ == ["id", "name", "city"]


def test_join_right_coalesces_keys(spark):
    l = spark.createDataFrame([(1, "alice")], "lid int, name string")
    r = spark.createDataFrame([(1, "paris"), (2, "oslo")], "rid int, city string")
    assert sorted(x.lid for x in jn.join_right(l, r, "lid", "rid").collect()) == [1, 2]


def test_anti_join_null_safe(spark):
    l = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    r = spark.createDataFrame([(2,), (None,)], "id int")
    assert sorted(x.id for x in jn.join_anti(l, r, "id").collect()) == [1, 3]


def test_union_by_name_fills_missing(spark):
    a = spark.createDataFrame([(1, "alice", "paid")], "id int, name string, status string")
    b = spark.createDataFrame([("bob", 2)], "name string, id int")
    out = {r.name: r.status for r in jn.union_distinct(a, b).collect()}
    assert out == {"alice": "paid", "bob": None}


def test_reconcile_metrics(spark):
    s = spark.createDataFrame([(1, 100), (2, 200), (3, 300), (4, 400)], "id int, amount int")
    t = spark.createDataFrame([(1, 100), (2, 250), (3, 300), (5, 500)], "id int, amount int")
    m = {r.metric: r.value for r in jn.reconcile(s, t, "id", "amount").collect()}
    assert m["rows_only_in_source"] == 1 and m["rows_only_in_target"] == 1 and m["keys_matched"] == 3
    assert m["amount_difference"] == -150


def test_last_value_whole_frame(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 3, 30)], "g string, ord int, amt int")
    assert {r.last_value for r in win.first_last_value(df, "last_value", "amt", "g", "ord").collect()} == {30}


def test_cumulative_and_global_match(spark):
    data = [("us", 1, 10), ("us", 2, 20), ("us", 3, 30), ("eu", 1, 5), ("eu", 2, 15)]
    df = spark.createDataFrame(data, "region string, day int, amount int")
    out = {(r.region, r.day): r.amount_running_sum for r in win.cumulative(df, "amount", "day", "sum", "region").collect()}
    assert out[("us", 3)] == 60 and out[("eu", 2)] == 20
    g = {r.k: r.k_running_sum for r in win.cumulative(spark.range(1, 101).withColumnRenamed("id", "k"), "k", "k").collect()}
    assert all(g[k] == k * (k + 1) // 2 for k in range(1, 101))


def test_fill_forward_backward(spark):
    data = [("A", 1, 10), ("A", 2, None), ("A", 3, None), ("A", 4, 20), ("B", 1, 5), ("B", 2, None), ("B", 3, 15)]
    df = spark.createDataFrame(data, "sensor string, ts int, reading int")
    f = {(r.sensor, r.ts): r.reading for r in win.fill_forward(df, "reading", "ts", "sensor").collect()}
    assert f[("A", 2)] == 10 and f[("A", 3)] == 10 and f[("B", 2)] == 5
    data2 = [("A", 1, None), ("A", 2, 10), ("A", 3, None), ("A", 4, 20), ("B", 1, None), ("B", 2, None), ("B", 3, 15)]
    b = {(r.sensor, r.ts): r.reading for r in win.fill_backward(spark.createDataFrame(data2, df.schema), "reading", "ts", "sensor").collect()}
    assert b[("A", 1)] == 10 and b[("A", 3)] == 20 and b[("B", 1)] == 15 and b[("B", 2)] == 15


def test_sessionize_gap(spark):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    data = [("u1", t(10, 0)), ("u1", t(10, 5)), ("u1", t(10, 40)), ("u1", t(10, 42)), ("u2", t(10, 1)), ("u2", t(10, 2))]
    df = spark.createDataFrame(data, "user_id string, ts timestamp_ntz")
    out = {(r.user_id, r.ts.minute, r.ts.hour): (r.session_id, r.session_seq) for r in win.sessionize(df, "user_id", "ts", 30).collect()}
    assert out[("u1", 40, 10)] == (2, 1) and out[("u1", 42, 10)] == (2, 2) and out[("u2", 2, 10)] == (1, 2)


def test_zscore_and_outliers(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "id int, v double")
    assert [r.v_zscore for r in win.zscore(df, "v").collect() if r.v == 3.0] == [0.0]
    o = spark.createDataFrame([(1, 10.0), (2, 11.0), (3, 12.0), (4, 13.0), (5, 1000.0), (6, None)], "id int, amount double")
    s = win.outlier(o, "amount", "iqr")
    assert s.passed.count() == 5 and [r.id for r in s.rejected.collect()] == [5]


def test_global_ranks_partition_invariant(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "id int, k int")
    ref = None
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted((r.id, r.dense_rank) for r in win.rank_rows(df, "dense_rank", None, "k").collect())
        assert ref is None or got == ref
        ref = got
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {r[1] for r in ref} == set(range(1, 8))


def test_surrogate_key_sequence(spark):
    df = spark.createDataFrame([("ACME", "US", 100), ("ACME", "US", 200), ("Beta", "UK", 50), ("Gamma", "US", 75)],
                               "company string, country string, amt int")
    assert cols.surrogate_key(df, "company, country", "hash").select("surrogate_key").distinct().count() == 3
    assert max(r.surrogate_key for r in cols.surrogate_key(df, "company, country", "sequence").collect()) == 4


def test_sample_percent_exact_and_repeatable(spark):
    df = spark.range(1, 201)
    a = sorted(r.id for r in rows.sample_percent(df, 10, "reservoir", 42).collect())
    b = sorted(r.id for r in rows.sample_percent(df, 10, "reservoir", 42).collect())
    assert len(a) == 20 and a == b


def test_rename_moves_renamed_last(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert cols.rename(df, "a:x").columns == ["b", "c", "x"]


def test_skew_safe_windows_match_plain_windows(spark):
    # one key holds most rows; the skew-safe forms must equal Spark's window
    data = [("hot" if i % 10 else f"k{i % 7}", i, None if i % 4 == 0 else float(i)) for i in range(600)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for fn, kw in [(win.cumulative, {"column": "v", "order_by": "t", "partition_by": "k"}),
                       (win.fill_forward, {"column": "v", "order_by": "t", "partition_by": "k"}),
                       (win.fill_backward, {"column": "v", "order_by": "t", "partition_by": "k"})]:
            a = sorted(map(tuple, fn(df, skew_safe=False, **kw).collect()), key=repr)
            b = sorted(map(tuple, fn(df, skew_safe=True, **kw).collect()), key=repr)
            assert a == b, fn.__name__
        a = sorted(map(tuple, win.rank_rows(df, "row_number", "k", "t", skew_safe=False).collect()))
        b = sorted(map(tuple, win.rank_rows(df, "row_number", "k", "t", skew_safe=True).collect()))
        assert a == b
        a = sorted(map(tuple, win.lead_lag(df, "lag", "v", 3, "k", "t", skew_safe=False).collect()), key=repr)
        b = sorted(map(tuple, win.lead_lag(df, "lag", "v", 3, "k", "t", skew_safe=True).collect()), key=repr)
        assert a == b
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_top_k_and_skip(spark):
    import lakeloom.operators.rows as r

    df = spark.range(1, 301)
    picked = sorted(x.id for x in r.sample_percent(df, 10, "reservoir", 7).collect())
    assert len(picked) == 30 and picked == sorted(x.id for x in r.sample_percent(df.repartition(5), 10, "reservoir", 7).collect())
    assert [x.id for x in r.top_n(df, 20, [("id", "desc")]).collect()] == list(range(300, 280, -1))
    assert sorted(x.id for x in r.skip_rows(df, 290, ["id"]).collect()) == list(range(291, 301))


def test_distinct_on_desc_text(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "z", 2), ("a", "z", 1), ("a", None, 0), ("b", None, 5), ("b", None, 4)],
                               "g string, s string, v int")
    out = {r.g: (r.s, r.v) for r in rows.distinct_on(df, "g", [("s", "desc")]).collect()}
    assert out == {"a": ("z", 1), "b": (None, 4)}


def test_approximate_aggregates_within_tolerance(spark):
    from tests.conftest import SF

    o = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/orders.parquet")
    exact = {r.o_orderstatus: r.n for r in o.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n")).collect()}
    approx = {r.o_orderstatus: r.customers for r in agg.approx_distinct(o, "o_custkey", "o_orderstatus", "customers").collect()}
    assert all(abs(approx[k] - exact[k]) <= 0.03 * exact[k] + 1 for k in exact)  # rsd 1%, 3 sigma
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    q = agg.approx_quantile(li, "l_extendedprice", 0.5).collect()[0][0]
    vals = sorted(r[0] for r in li.select("l_extendedprice").collect())
    rank = sum(1 for v in vals if v <= q) / len(vals)
    assert abs(rank - 0.5) < 0.01
