"""Queries for the Structured Streaming variants (§2.11) and the SQL / user
code surface (§2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import code
from lakeloom.plans.io import scratch
from lakeloom.plans.registry import Tables, query
from lakeloom.streaming import streams as st


def _event_stream(spark, d):
    schema = Tables(spark, d).events.schema
    # a glob: the file stream source lists a directory or pattern
    return st.stream_files(spark, f"{d}/events*.parquet", schema)


def _drained(spark, df, name: str):
    return st.run_to_files(df, scratch(spark, name), scratch(spark, f"{name}-ckpt"))


@query(
    "stream_time_bin",
    """WITH b AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS bin_start, event_type, value FROM events),
            g AS (SELECT bin_start, bin_start + INTERVAL '5 minutes' AS bin_end, event_type, COUNT(*) AS events,
                         SUM(value) AS sum_value FROM b GROUP BY ALL)
       SELECT bin_start, bin_end, event_type, events, ROUND(sum_value, 6) AS sum_value FROM g
       WHERE bin_end <= (SELECT MAX(ts) FROM events) - INTERVAL '10 minutes'""",
)
def q_stream_time_bin(spark, d):
    agg = st.stream_time_bin(_event_stream(spark, d), "ts", "event_type", "5 minutes", None, "10 minutes", "value")
    out = _drained(spark, agg, "time_bin")
    return out.withColumn("sum_value", F.round("sum_value", 6))


# A session starts at an event with none in the 30 minutes before it; it holds the events
# up to the next such start.
_SESS_SQL = """
WITH e AS (SELECT user_id, ts, COUNT(*) AS n FROM events GROUP BY user_id, ts),
starts AS (SELECT user_id, ts AS session_start FROM e
           WHERE NOT EXISTS (SELECT 1 FROM e AS b WHERE b.user_id = e.user_id AND b.ts < e.ts AND b.ts >= e.ts - INTERVAL '30 minutes')),
held AS (SELECT e.user_id, s.session_start, e.ts, e.n FROM e ASOF JOIN starts AS s ON e.user_id = s.user_id AND e.ts >= s.session_start)
SELECT user_id, session_start, MAX(ts) + INTERVAL '30 minutes' AS session_end, CAST(SUM(n) AS BIGINT) AS events
FROM held GROUP BY user_id, session_start
HAVING MAX(ts) + INTERVAL '30 minutes' <= (SELECT MAX(ts) FROM events) - INTERVAL '1 hour'
"""


@query("stream_sessionize", _SESS_SQL)
def q_stream_sessionize(spark, d):
    s = st.stream_sessionize(_event_stream(spark, d), "ts", "user_id", "30 minutes", "1 hour")
    return _drained(spark, s, "sessions")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def q_stream_dedupe(spark, d):
    s = st.stream_dedupe(_event_stream(spark, d), ["user_id", "event_type"], "ts", "1 hour")
    return _drained(spark, s.select("user_id", "event_type"), "dedupe")


@query("stream_enrich", "SELECT e.event_id, e.user_id, c.c_name, c.c_mktsegment FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def q_stream_enrich(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment")
    s = st.stream_enrich(_event_stream(spark, d), c, "user_id", "c_custkey")
    return _drained(spark, s.select("event_id", "user_id", "c_name", "c_mktsegment"), "enrich")


@query("stream_quality_split", "SELECT * FROM events WHERE COALESCE(value >= 5, FALSE)")
def q_stream_quality_split(spark, d):
    ok, bad = scratch(spark, "stream-pass"), scratch(spark, "stream-reject")
    st.stream_quality_split(_event_stream(spark, d), "value >= 5", ok, bad, scratch(spark, "stream-ckpt"))
    return spark.read.parquet(ok).drop("batch")


@query("stream_incremental", "SELECT * FROM orders")
def q_stream_incremental(spark, d):
    o = Tables(spark, d).orders
    src, sink = scratch(spark, "inc-src"), scratch(spark, "inc-sink")
    o.write.mode("overwrite").parquet(src)
    st.stream_incremental(spark, src, o.schema, sink, scratch(spark, "inc-ckpt"))
    return spark.read.parquet(sink).select(*o.columns)


_PREV_SQL = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P')"
_SRC_SQL = ("(SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, "
            "CASE WHEN o_orderpriority = '2-HIGH' THEN 'delete' ELSE 'upsert' END AS op FROM orders "
            "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))")


@query(
    "stream_upsert",
    f"""SELECT * FROM {_PREV_SQL} t WHERE NOT EXISTS (SELECT 1 FROM {_SRC_SQL} s WHERE s.o_orderkey = t.o_orderkey)
        UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {_SRC_SQL} WHERE op <> 'delete'""",
)
def q_stream_upsert(spark, d):
    """Two micro-batches: the newest changes, then late ones of the same keys, which lose."""
    from lakeloom.plans.io import _prev, _src

    log, changes = scratch(spark, "su-log"), scratch(spark, "su-changes")
    new = _src(spark, d).withColumn("seq", F.lit(2))
    late = new.withColumn("seq", F.lit(1)).withColumn("op", F.lit("upsert")).withColumn("o_totalprice", F.lit(0.0).cast(new.schema["o_totalprice"].dataType))
    for rows in (new, late):
        rows.coalesce(1).write.mode("append").parquet(changes)
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(changes)
    st.stream_upsert(stream, log, scratch(spark, "su-ckpt"), "o_orderkey", "seq")
    st.compact_changes(spark, log, "o_orderkey")
    return st.upserted(_prev(spark, d), log, "o_orderkey", spark, delete_column="op").drop("seq")


def _stream_changes_sql():
    from lakeloom.plans.io import _CHANGES_SQL, _PREV_SQL

    return (f"SELECT *, TIMESTAMP '2024-02-01' AS changed_at FROM ({_CHANGES_SQL}) "
            f"UNION ALL SELECT *, 'insert', TIMESTAMP '2024-01-01' FROM {_PREV_SQL}")


@query("stream_changes", _stream_changes_sql())
def q_stream_changes(spark, d):
    """The feed is stopped after the first snapshot and resumed after the second."""
    from lakeloom.plans.io import _V1, _V2, _current, _prev
    from lakeloom.sources import tables

    path, sink, ckpt = scratch(spark, "feed-src"), scratch(spark, "feed"), scratch(spark, "feed-ckpt")
    for rows, when in ((_prev(spark, d), _V1), (_current(spark, d), _V2)):
        tables.write_snapshot(rows, path, when)
        st.stream_changes(spark, path, "o_orderkey", sink, ckpt)
    return spark.read.parquet(sink).drop("at")


# ----------------------------------------------------------- SQL and code

@query("sql_node", "SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
def q_sql_node(spark, d):
    return code.sql_node(spark, "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_custkey) AS s FROM input GROUP BY o_orderstatus",
                         input=Tables(spark, d).orders)


@query("sql_template", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000")
def q_sql_template(spark, d):
    return code.sql_template(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status "
                                    "AND o_totalprice > ${context.min_total}",
                             args={"status": "F"}, context={"min_total": 250000}, orders=Tables(spark, d).orders)


@query("sql_routine", "SELECT p_partkey, p_retailprice * 1.2 AS gross FROM part")
def q_sql_routine(spark, d):
    code.sql_routine(spark, "lakeloom_gross", ["price DOUBLE"], "price * 1.2")
    return code.sql_node(spark, "SELECT p_partkey, lakeloom_gross(p_retailprice) AS gross FROM input", input=Tables(spark, d).part)


def _process(row: dict):
    if row["c_acctbal"] < 0:
        return None
    return {"c_custkey": row["c_custkey"], "tier": "gold" if row["c_acctbal"] > 5000 else "std"}


@query("python_rows", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'gold' ELSE 'std' END AS tier FROM customer WHERE c_acctbal >= 0")
def q_python_rows(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_acctbal")
    return code.python_rows(c, _process, "c_custkey bigint, tier string")


def _word_counts(values: list) -> list:
    return [len(v.split()) if v is not None else None for v in values]


@query("map_batches", "SELECT conv_id, turn, CAST(len(string_split_regex(trim(text), '\\s+')) AS BIGINT) AS words FROM conversations")
def q_map_batches(spark, d):
    c = Tables(spark, d).conversations.select("conv_id", "turn", "text")
    return code.map_batches(c, _word_counts, "text", "words", "bigint", batch_size=100).drop("text")
