"""Partitioned windows over a few very large keys (order status, event
type), run with ``skew_safe=True``: each hot key is split over range
partitions instead of being sorted by one task. Same results as the plain
window forms, checked against the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import windows as win
from lakeloom.plans.registry import Tables, query
from lakeloom.plans.relational import session_sql


@query(
    "row_number_skew_safe",
    "SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS row_number FROM orders",
)
def q_rn_skew(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderstatus")
    return win.rank_rows(o, "row_number", "o_orderstatus", "o_orderkey", skew_safe=True)


@query(
    "cumulative_skew_safe",
    """SELECT o_orderkey, o_orderstatus, o_custkey,
              CAST(SUM(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
              AS o_custkey_running_sum FROM orders""",
)
def q_cum_skew(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    return win.cumulative(o, "o_custkey", "o_orderkey", "sum", "o_orderstatus", skew_safe=True)


_NULLED = "CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END"


def _events(spark, d):
    e = Tables(spark, d).events
    return e.select("event_id", "ts", "event_type", F.when(F.pmod("user_id", F.lit(3)) != 0, F.col("value")).alias("value"))


@query(
    "fill_forward_skew_safe",
    f"""SELECT event_id, ts, event_type, last({_NULLED} IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""",
)
def q_ffill_skew(spark, d):
    return win.fill_forward(_events(spark, d), "value", ["ts", "event_id"], "event_type", skew_safe=True)


@query(
    "fill_backward_skew_safe",
    f"""SELECT event_id, ts, event_type, first({_NULLED} IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM events""",
)
def q_bfill_skew(spark, d):
    return win.fill_backward(_events(spark, d), "value", ["ts", "event_id"], "event_type", skew_safe=True)


@query(
    "lag_skew_safe",
    "SELECT event_id, ts, event_type, lag(event_id, 2) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS lag FROM events",
)
def q_lag_skew(spark, d):
    e = Tables(spark, d).events.select("event_id", "ts", "event_type")
    return win.lead_lag(e, "lag", "event_id", 2, "event_type", ["ts", "event_id"], skew_safe=True)


@query(
    "lead_skew_safe",
    "SELECT event_id, ts, event_type, lead(event_id, 1) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS lead FROM events",
)
def q_lead_skew(spark, d):
    e = Tables(spark, d).events.select("event_id", "ts", "event_type")
    return win.lead_lag(e, "lead", "event_id", 1, "event_type", ["ts", "event_id"], skew_safe=True)


_SESS = session_sql("event_type", "2 MINUTE")


@query("sessionize_skew_safe", _SESS)
def q_sess_skew(spark, d):
    e = Tables(spark, d).events.select("event_id", "ts", "event_type")
    return win.sessionize(e, "event_type", "ts", 2, "minutes", skew_safe=True)


@query("rank_skew_safe", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS BIGINT) AS rank FROM lineitem")
def q_rank_skew(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return win.rank_rows(li, "rank", "l_returnflag", "l_quantity", skew_safe=True)


@query("dense_rank_skew_safe", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, CAST(dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS BIGINT) AS dense_rank FROM lineitem")
def q_dense_rank_skew(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return win.rank_rows(li, "dense_rank", "l_returnflag", "l_quantity", skew_safe=True)


@query("ntile_skew_safe", "SELECT o_orderkey, o_orderstatus, CAST(ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS ntile FROM orders")
def q_ntile_skew(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderstatus")
    return win.rank_rows(o, "ntile", "o_orderstatus", "o_orderkey", ntile_buckets=5, skew_safe=True)


_SESS_GLOBAL = session_sql(None, "15 SECOND")


@query("sessionize_global", _SESS_GLOBAL)
def q_sess_global(spark, d):
    # one stream of all events: the whole table is a single hot key
    e = Tables(spark, d).events.select("event_id", "ts")
    return win.sessionize(e, None, "ts", 15, "seconds")


@query(
    "distinct_on_desc_text",
    """SELECT DISTINCT ON (o_custkey) * FROM orders
       ORDER BY o_custkey, o_orderpriority DESC NULLS LAST, o_orderkey, o_orderstatus, o_totalprice, o_orderdate""",
)
def q_distinct_on_desc_text(spark, d):
    # DESC on a text column takes the aggregate-and-narrow path
    from lakeloom.operators import rows

    return rows.distinct_on(Tables(spark, d).orders, "o_custkey", [("o_orderpriority", "desc")])
