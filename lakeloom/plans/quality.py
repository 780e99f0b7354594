"""Queries for data quality checks and change data capture (§2.10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakeloom.operators import cdc
from lakeloom.operators import quality as qa
from lakeloom.plans.registry import Tables, query

_EV_NULL = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"


def _events(spark, d):
    e = Tables(spark, d).events
    return e.select("event_id", "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


@query("check_not_null", f"SELECT * FROM (SELECT event_id, user_id, event_type, {_EV_NULL} AS value FROM events) WHERE value IS NOT NULL AND user_id IS NOT NULL")
def q_notnull(spark, d):
    return qa.check_not_null(_events(spark, d), ["value", "user_id"]).passed


@query("check_not_null_reject", f"SELECT * FROM (SELECT event_id, user_id, event_type, {_EV_NULL} AS value FROM events) WHERE NOT (value IS NOT NULL AND user_id IS NOT NULL)")
def q_notnull_rej(spark, d):
    return qa.check_not_null(_events(spark, d), ["value", "user_id"]).rejected


@query("check_range", "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 40")
def q_range(spark, d):
    return qa.check_range(Tables(spark, d).lineitem, "l_quantity", 10, 40).passed


@query("check_range_reject", "SELECT * FROM lineitem WHERE NOT COALESCE(l_quantity BETWEEN 10 AND 40, FALSE)")
def q_range_rej(spark, d):
    return qa.check_range(Tables(spark, d).lineitem, "l_quantity", 10, 40).rejected


@query("check_regex", "SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https://[a-z.]+/(en|fr)/[0-9]+')")
def q_regex(spark, d):
    return qa.check_regex(Tables(spark, d).pages.select("page_id", "url"), "url", "https://[a-z.]+/(en|fr)/[0-9]+").passed


@query(
    "check_unique",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def q_unique(spark, d):
    return qa.check_unique(Tables(spark, d).orders, "o_custkey", "o_orderkey").passed


@query(
    "check_unique_reject",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1",
)
def q_unique_rej(spark, d):
    return qa.check_unique(Tables(spark, d).orders, "o_custkey", "o_orderkey").rejected


@query("profile")
def q_profile(spark, d):
    return qa.profile(Tables(spark, d).lineitem)


def _profile_sql(table: str, col: str, top_n: int) -> str:
    """From the column's frequency table: every metric is a sum over its rows."""
    shapes = ", ".join(f"('{name}', '{p}')" for name, p in qa.PROFILE_PATTERNS.items())
    return f"""
WITH freq AS (SELECT CAST({col} AS VARCHAR) AS v, COUNT(*) AS n FROM {table} GROUP BY ALL),
size AS (SELECT SUM(n)::BIGINT AS all_rows, COALESCE(SUM(n) FILTER (v IS NULL), 0)::BIGINT AS empty_rows, COUNT(v) AS kinds,
                MIN(v) AS lo, MAX(v) AS hi FROM freq),
shares(metric, k, base, shown) AS (
  SELECT 'null_count', empty_rows, all_rows, FALSE FROM size
  UNION ALL SELECT 'null_pct', empty_rows, all_rows, TRUE FROM size
  UNION ALL SELECT 'pattern_' || s.name, COALESCE((SELECT SUM(n) FROM freq WHERE regexp_full_match(v, s.pattern)), 0)::BIGINT,
                   (SELECT all_rows - empty_rows FROM size), TRUE
            FROM (VALUES {shapes}) AS s(name, pattern)),
ranked AS (SELECT v, n::BIGINT AS n FROM freq WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT {top_n}),
facts(metric, value) AS (
  SELECT unnest(['column', 'min', 'max']), unnest(['{col}', lo, hi]) FROM size)
SELECT metric, value, NULL::BIGINT AS count, NULL::DOUBLE AS pct FROM facts
UNION ALL SELECT 'distinct_approx', kinds::VARCHAR, kinds, NULL FROM size
UNION ALL SELECT 'count', all_rows::VARCHAR, all_rows, 100 FROM size
UNION ALL SELECT metric, CASE WHEN shown THEN round(100.0::DOUBLE * k / base, 4)::VARCHAR || '%' ELSE k::VARCHAR END, k,
                 round(100.0::DOUBLE * k / base, 4) FROM shares
UNION ALL SELECT 'top_value', v, n, round(100.0::DOUBLE * n / (SELECT all_rows FROM size), 4) FROM ranked
"""


@query("profile_column", _profile_sql("orders", "o_orderpriority", 3))
def q_profile_column(spark, d):
    return qa.profile_column(Tables(spark, d).orders, "o_orderpriority", top_n=3, exact_distinct=True)


@query(
    "describe",
    """SELECT column_name,
              CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                               WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END
              AS column_type, "null", CAST(key AS VARCHAR) AS key, CAST("default" AS VARCHAR) AS "default",
              CAST(extra AS VARCHAR) AS extra
       FROM (DESCRIBE SELECT * FROM lineitem)""",
)
def q_describe(spark, d):
    return qa.describe(Tables(spark, d).lineitem)


@query("histogram", "SELECT o_orderpriority AS value, COUNT(*) AS frequency FROM orders GROUP BY o_orderpriority")
def q_histogram(spark, d):
    return qa.histogram(Tables(spark, d).orders, "o_orderpriority")


# Java upper-cases ß to "SS" (full case mapping); DuckDB gives ẞ. The oracle
# states the Java rule explicitly.
@query("standardize", r"SELECT conv_id, turn, trim(regexp_replace(replace(upper(text), 'ẞ', 'SS'), '\s+', ' ', 'g')) AS text FROM conversations")
def q_standardize(spark, d):
    c = Tables(spark, d).conversations.select("conv_id", "turn", "text")
    return qa.standardize(c, "text", case="upper")


@query(
    "mask",
    """SELECT c_custkey, md5('pepper' || c_name) AS c_name,
              CASE WHEN length(c_mktsegment) <= 3 THEN repeat('*', length(c_mktsegment))
                   ELSE repeat('*', length(c_mktsegment) - 3) || right(c_mktsegment, 3) END AS c_mktsegment,
              NULL::DOUBLE AS c_acctbal, 'hidden' AS c_nationkey FROM customer""",
)
def q_mask(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    return qa.mask(c, [{"column": "c_name", "mode": "hash", "salt": "pepper"},
                       {"column": "c_mktsegment", "mode": "partial", "show_last": 3},
                       {"column": "c_acctbal", "mode": "null"},
                       {"column": "c_nationkey", "mode": "constant", "value": "hidden"}])


def _classify_sql(table: str, cols: list[str]) -> str:
    """One row per cell and kind; a column's kind is the largest (hits, earlier kind)."""
    kinds = ", ".join(f"({i}, '{n}', {p}, '{rx}')" for i, (n, p, rx) in enumerate(qa.CLASSIFY_PATTERNS))
    return f"""
WITH cells AS (SELECT unnest([{', '.join(f"'{c}'" for c in cols)}]) AS name, unnest([{', '.join(f'{c}::VARCHAR' for c in cols)}]) AS x FROM {table}),
kinds(place, kind, personal, pattern) AS (VALUES {kinds}),
hits AS (
  SELECT name, place, kind, personal, COUNT(x) AS n,
         COUNT(*) FILTER (regexp_full_match(CASE kind WHEN 'credit_card' THEN translate(x, ' -', '') ELSE x END, pattern)) AS k
  FROM cells CROSS JOIN kinds GROUP BY ALL),
won AS (SELECT name, MAX(n) AS n, MAX({{'k': k, 'earlier': -place, 'kind': kind, 'personal': personal}}) AS w FROM hits GROUP BY name)
SELECT name AS "column", CASE WHEN w.k >= 0.8 * n AND n > 0 THEN w.kind ELSE 'text' END AS detected_type,
       COALESCE(round(w.k / NULLIF(n, 0), 4), 0) AS match_rate, n AS sample_count,
       w.k >= 0.8 * n AND n > 0 AND w.personal AS is_pii FROM won
"""


@query("classify_columns", _classify_sql("pages", ["page_id", "url", "html"]))
def q_classify(spark, d):
    return qa.classify_columns(Tables(spark, d).pages.select("page_id", "url", "html"))


_EXPECT_RULES = [
    {"column": "l_shipdate", "check": "not_null"},
    {"column": "l_orderkey", "check": "unique"},
    {"column": "l_returnflag", "check": "in_set", "args": ["R", "A"]},
    {"column": "l_discount", "check": "in_range", "args": {"min": 0, "max": 0.08}},
    {"column": "l_linestatus", "check": "regex", "args": "[OF]"},
    {"column": "l_tax", "check": "non_negative"},
]

_EXPECT_SQL = """
WITH seen AS (
  SELECT COUNT(*) AS n, SUM((l_shipdate IS NULL)::INT) AS e1, SUM((l_returnflag NOT IN ('A', 'R'))::INT) AS e3,
         SUM((l_discount < 0 OR l_discount > 0.08)::INT) AS e4, SUM((l_linestatus NOT IN ('O', 'F'))::INT) AS e5,
         SUM((l_tax < 0)::INT) AS e6
  FROM lineitem),
twice AS (SELECT COALESCE(SUM(c), 0) AS e2 FROM (SELECT COUNT(*) AS c FROM lineitem GROUP BY l_orderkey HAVING c > 1)),
card AS (
  SELECT n, unnest(['not_null(l_shipdate)', 'unique(l_orderkey)', 'in_set(l_returnflag, 2 values)', 'in_range(l_discount, 0, 0.08)',
                    'regex(l_linestatus)', 'non_negative(l_tax)']) AS expectation,
         unnest([e1, e2, e3, e4, e5, e6])::BIGINT AS failed
  FROM seen, twice)
SELECT expectation, n AS total, failed, (n - failed)::DOUBLE / n AS pass_rate, failed < 1 AS passed FROM card
"""


@query("expect", _EXPECT_SQL)
def q_expect(spark, d):
    return qa.expect(Tables(spark, d).lineitem, _EXPECT_RULES)


@query("contract", "SELECT * FROM lineitem")
def q_contract(spark, d):
    return qa.contract(Tables(spark, d).lineitem, [
        {"column": "l_quantity", "check": "in_range", "args": {"min": 0, "max": 100}},
        {"column": "l_orderkey", "check": "not_null"},
        {"column": "l_returnflag", "check": "in_set", "args": ["R", "A", "N"]},
    ])


@query("assert_rows", "SELECT * FROM orders")
def q_assert(spark, d):
    return qa.assert_rows(Tables(spark, d).orders, "o_totalprice > 0", "non-positive order total")


@query("row_count_gate", "SELECT * FROM orders")
def q_gate(spark, d):
    return qa.row_count_gate(Tables(spark, d).orders, "orders table is empty", "no-rows")


_NOW = dt.datetime(2024, 2, 1, 12, 0, 0)


@query(
    "freshness",
    """SELECT MAX(ts) AS max_timestamp, date_diff('hour', MAX(ts), TIMESTAMP '2024-02-01 12:00:00') AS age_hours,
              48 AS threshold_hours, date_diff('hour', MAX(ts), TIMESTAMP '2024-02-01 12:00:00') <= 48 AS is_fresh FROM events""",
)
def q_freshness(spark, d):
    return qa.freshness(Tables(spark, d).events, "ts", 48, "hours", "report", now=_NOW)


@query("freshness_gate", "SELECT * FROM events")
def q_freshness_gate(spark, d):
    return qa.freshness(Tables(spark, d).events, "ts", 60, "days", "gate", now=_NOW)


_SW = ["o_totalprice > 300000", "o_totalprice > 100000"]


@query("switch_case_1", "SELECT * FROM orders WHERE COALESCE(o_totalprice > 300000, FALSE)")
def q_switch1(spark, d):
    return qa.switch(Tables(spark, d).orders, _SW)["case_1"]


@query("switch_case_2", "SELECT * FROM orders WHERE NOT COALESCE(o_totalprice > 300000, FALSE) AND COALESCE(o_totalprice > 100000, FALSE)")
def q_switch2(spark, d):
    return qa.switch(Tables(spark, d).orders, _SW)["case_2"]


@query("switch_default", "SELECT * FROM orders WHERE NOT COALESCE(o_totalprice > 300000, FALSE) AND NOT COALESCE(o_totalprice > 100000, FALSE)")
def q_switch_default(spark, d):
    return qa.switch(Tables(spark, d).orders, _SW)["default"]


_DRIFT_SQL = """
SELECT * FROM (VALUES
  ('o_orderkey', 'ok', 'bigint', 'bigint', FALSE,
   (SELECT COUNT(*) FILTER (WHERE o_orderkey IS NOT NULL AND TRY_CAST(o_orderkey AS BIGINT) IS NULL) FROM orders)),
  ('o_totalprice', 'type_changed', 'int', 'double', TRUE,
   (SELECT COUNT(*) FILTER (WHERE o_totalprice IS NOT NULL AND TRY_CAST(o_totalprice AS INTEGER) IS NULL) FROM orders)),
  ('o_orderdate', 'ok', 'timestamp_ntz', 'timestamp_ntz', FALSE,
   (SELECT COUNT(*) FILTER (WHERE o_orderdate IS NOT NULL AND TRY_CAST(o_orderdate AS TIMESTAMP) IS NULL) FROM orders)),
  ('o_comment', 'missing', 'string', NULL, TRUE, NULL),
  ('o_orderstatus', 'ok', 'string', 'string', FALSE,
   (SELECT COUNT(*) FILTER (WHERE o_orderstatus IS NOT NULL AND TRY_CAST(o_orderstatus AS VARCHAR) IS NULL) FROM orders)),
  ('o_custkey', 'added', NULL, 'bigint', FALSE, NULL),
  ('o_orderpriority', 'added', NULL, 'string', FALSE, NULL)
) AS t("column", status, expected_type, actual_type, breaking, cast_failures)
"""


@query("schema_drift", _DRIFT_SQL)
def q_drift(spark, d):
    return qa.schema_drift(Tables(spark, d).orders, {"o_orderkey": "int64", "o_totalprice": "int32", "o_orderdate": "timestamp",
                                                     "o_comment": "string", "o_orderstatus": "string"})


@query("dataset_fingerprint")
def q_fingerprint(spark, d):
    return qa.dataset_fingerprint(Tables(spark, d).lineitem)


_DIFF_SQL = """
WITH p AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
           FROM orders WHERE o_orderstatus <> 'P'),
     c AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT 'nation' AS "table", 'added' AS status, NULL::BIGINT AS left_rows, (SELECT COUNT(*) FROM nation) AS right_rows,
       (SELECT COUNT(*) FROM nation) AS row_delta, NULL::BIGINT AS changed_rows
UNION ALL SELECT 'orders', 'common', (SELECT COUNT(*) FROM p), (SELECT COUNT(*) FROM c),
       (SELECT COUNT(*) FROM c) - (SELECT COUNT(*) FROM p),
       (SELECT COUNT(*) FROM p JOIN c USING (o_orderkey)
        WHERE p.o_custkey IS DISTINCT FROM c.o_custkey OR p.o_orderstatus IS DISTINCT FROM c.o_orderstatus
           OR p.o_totalprice IS DISTINCT FROM c.o_totalprice)
UNION ALL SELECT 'region', 'removed', (SELECT COUNT(*) FROM region), NULL, -(SELECT COUNT(*) FROM region), NULL
"""


@query("dataset_diff", _DIFF_SQL)
def q_dataset_diff(spark, d):
    t = Tables(spark, d)
    cur, prev = _cur(spark, d), _prev(spark, d)
    return qa.dataset_diff({"orders": prev, "region": t.region}, {"orders": cur, "nation": t.nation}, {"orders": ["o_orderkey"]})


# ---------------------------------------------------------------- CDC / SCD

def _cur(spark, d):
    return Tables(spark, d).orders.where("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _prev(spark, d):
    o = Tables(spark, d).orders.where("o_orderstatus <> 'P'")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus",
                    F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))


_CUR_SQL ="(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')"
_PREV_SQL = ("(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 "
             "ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P')")


@query(
    "cdc_diff",
    f"""SELECT COALESCE(c.o_orderkey, p.o_orderkey) AS o_orderkey, c.o_custkey, c.o_orderstatus, c.o_totalprice,
              CASE WHEN p.o_orderkey IS NULL THEN 'inserted' WHEN c.o_orderkey IS NULL THEN 'deleted'
                   WHEN c.o_totalprice IS DISTINCT FROM p.o_totalprice OR c.o_orderstatus IS DISTINCT FROM p.o_orderstatus THEN 'updated'
                   ELSE 'unchanged' END AS change_type
       FROM {_CUR_SQL} c FULL JOIN {_PREV_SQL} p ON c.o_orderkey = p.o_orderkey
       WHERE change_type <> 'unchanged'""",
)
def q_cdc(spark, d):
    return cdc.cdc_diff(_cur(spark, d), _prev(spark, d), "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query(
    "scd1",
    f"SELECT * FROM {_CUR_SQL} UNION ALL BY NAME SELECT * FROM {_PREV_SQL} p WHERE NOT EXISTS (SELECT 1 FROM {_CUR_SQL} c WHERE c.o_orderkey = p.o_orderkey)",
)
def q_scd1(spark, d):
    return cdc.scd1(_cur(spark, d), _prev(spark, d), "o_orderkey")


@query(
    "upsert_delta",
    f"SELECT c.* FROM {_CUR_SQL} c LEFT JOIN {_PREV_SQL} p ON c.o_orderkey = p.o_orderkey WHERE p.o_orderkey IS NULL OR c.o_totalprice IS DISTINCT FROM p.o_totalprice",
)
def q_upsert_delta(spark, d):
    return cdc.upsert_delta(_cur(spark, d), _prev(spark, d), "o_orderkey", "o_totalprice")


_T0, _T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)


def _history(spark, d):
    p = _prev(spark, d)
    open_ = p.select("*", F.lit(_T0).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
                     F.lit(True).alias("is_current"))
    old = p.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") - 5).alias("o_totalprice"),
                                                F.lit(dt.datetime(2023, 1, 1)).cast("timestamp_ntz").alias("valid_from"),
                                                F.lit(_T0).cast("timestamp_ntz").alias("valid_to"), F.lit(False).alias("is_current"))
    return open_.unionByName(old)


_HIST_SQL = f"""(SELECT *, TIMESTAMP '2024-01-01' AS valid_from, NULL::TIMESTAMP AS valid_to, TRUE AS is_current FROM {_PREV_SQL}
  UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice - 5, TIMESTAMP '2023-01-01', TIMESTAMP '2024-01-01', FALSE
  FROM {_PREV_SQL} WHERE o_orderstatus = 'F')"""

# A current row lives on if the source repeats its key and tracked value; else it
# is closed. A source row opens a version unless such a current row exists.
_SCD2_SQL = f"""
WITH h AS {_HIST_SQL}, c AS {_CUR_SQL},
v AS (SELECT h.*, is_current AND EXISTS (FROM c WHERE c.o_orderkey = h.o_orderkey AND c.o_totalprice IS NOT DISTINCT FROM h.o_totalprice) AS lives FROM h)
SELECT v.* EXCLUDE (lives) REPLACE (CASE WHEN is_current AND NOT lives THEN TIMESTAMP '2024-06-01' ELSE valid_to END AS valid_to, lives AS is_current)
FROM v
UNION ALL
SELECT c.*, TIMESTAMP '2024-06-01', NULL, TRUE
FROM c ANTI JOIN (FROM v WHERE lives) l ON c.o_orderkey = l.o_orderkey AND c.o_totalprice IS NOT DISTINCT FROM l.o_totalprice
"""


@query("scd2", _SCD2_SQL)
def q_scd2(spark, d):
    return cdc.scd2(_cur(spark, d), _history(spark, d), "o_orderkey", "o_totalprice", as_of=_T1)


@query(
    "scd3",
    f"SELECT c.*, p.o_totalprice AS previous_o_totalprice, p.o_orderstatus AS previous_o_orderstatus FROM {_CUR_SQL} c LEFT JOIN {_PREV_SQL} p ON c.o_orderkey = p.o_orderkey",
)
def q_scd3(spark, d):
    return cdc.scd3(_cur(spark, d), _prev(spark, d), "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("incremental_load", "SELECT * FROM events WHERE ts > (SELECT MIN(ts) + INTERVAL 1 DAY FROM events)")
def q_incremental(spark, d):
    e = Tables(spark, d).events
    mark = e.agg(F.min("ts")).first()[0] + dt.timedelta(days=1)  # as a state table would hold it
    return cdc.incremental_load(e, "ts", mark)
