"""Queries for readers, writers and table modes: each writes a driver table
(or a frame derived from it) to the shared scratch area under the session's
checkpoint directory and reads it back through the operator under test."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from lakeloom.core import checkpoint_dir
from lakeloom.operators import aggregate as agg
from lakeloom.sources import readers, tables, writers
from lakeloom.plans.registry import Tables, query


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/lakeloom-scratch/{name}-{uuid.uuid4().hex}"


@query("read_csv", "SELECT * FROM orders")
def q_read_csv(spark, d):
    o = Tables(spark, d).orders
    path = scratch(spark, "csv")
    writers.write_csv(o, path)
    return readers.read_csv(spark, path, schema=o.schema)


@query("read_csv_split", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'")
def q_read_csv_split(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_orderstatus",
                                       F.when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a"))
                                       .otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"))
    path = scratch(spark, "csvsplit")
    writers.write_csv(o, path)
    s = readers.read_csv_split(spark, path, [{"name": "o_orderkey", "type": "int64"}, {"name": "o_custkey", "type": "int64"},
                                             {"name": "o_totalprice", "type": "float64"}])
    return s.passed


@query("read_tsv", "SELECT * FROM customer")
def q_read_tsv(spark, d):
    c = Tables(spark, d).customer
    path = scratch(spark, "tsv")
    writers.write_csv(c, path, delimiter="\t")
    return readers.read_tsv(spark, path, schema=c.schema)


@query("read_json", "SELECT event_id, user_id, event_type, value FROM events")
def q_read_json(spark, d):
    e = Tables(spark, d).events.select("event_id", "user_id", "event_type", "value")
    path = scratch(spark, "json")
    writers.write_json(e, path)
    return readers.read_json(spark, path, format="newline_delimited", schema=e.schema)


@query(
    "read_fixedwidth",
    "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, rtrim(rpad(c_name, 20, ' ')) AS name, rtrim(rpad(c_mktsegment, 10, ' ')) AS segment FROM customer",
)
def q_read_fixedwidth(spark, d):
    c = Tables(spark, d).customer
    lines = c.select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.rpad("c_name", 20, " "),
                              F.rpad("c_mktsegment", 10, " ")).alias("value"))
    path = scratch(spark, "fixed")
    lines.write.mode("overwrite").text(path)
    return readers.read_fixedwidth(spark, path, [{"name": "id", "start": 1, "width": 8}, {"name": "name", "start": 9, "width": 20},
                                                 {"name": "segment", "start": 29, "width": 10}])


@query("read_xml", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def q_read_xml(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = scratch(spark, "xml")
    writers.write_xml(c, path, "customers", "customer")
    x = readers.read_xml(spark, path, "customers/customer")
    return x.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"), "c_mktsegment")


@query("read_xml_path", "SELECT c_custkey, c_name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def q_read_xml_path(spark, d):
    """The tag ``row`` stands under two parents; one of them is asked for."""
    c = Tables(spark, d).customer
    buyer = F.struct(F.struct(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"),
                              F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("segment")).alias("row"))
    seller = F.struct(F.struct((-F.col("c_custkey")).alias("_id"), F.lit("a > b").alias("name")).alias("row"))
    path = scratch(spark, "xmlpath")
    c.select(seller.alias("sellers"), buyer.alias("buyers")).write.mode("overwrite").format("xml") \
        .option("rootTag", "shops").option("rowTag", "shop").save(path)
    x = readers.read_xml(spark, path, "shop/buyers/row")
    return x.select(F.col("@id").alias("c_custkey"), F.col("name").alias("c_name"), F.col("segment").alias("c_mktsegment"))


@query("write_parquet", "SELECT * FROM lineitem")
def q_write_parquet(spark, d):
    li = Tables(spark, d).lineitem
    path = scratch(spark, "parquet")
    writers.write_parquet(li, path, partition_by="l_returnflag", max_partitions=100)
    return readers.read_parquet(spark, path).select(*li.columns)


@query("split_write", "SELECT * FROM orders")
def q_split_write(spark, d):
    o = Tables(spark, d).orders
    path = scratch(spark, "split")
    writers.split_write(o, "o_orderstatus", path, "parquet")
    return spark.read.parquet(path).select(*o.columns)


@query("checkpoint_table", "SELECT * FROM part")
def q_checkpoint_table(spark, d):
    return writers.checkpoint_table(Tables(spark, d).part, scratch(spark, "ckpt"))


@query("kafka_payload", "SELECT CAST(c_custkey AS VARCHAR) AS key, to_json(struct_pack(c_custkey, c_name, c_mktsegment))::VARCHAR AS value FROM customer")
def q_kafka_payload(spark, d):
    return writers.kafka_payload(Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")


# ------------------------------------------------------------ table modes

def _prev(spark, d):
    return Tables(spark, d).orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _src(spark, d):
    o = Tables(spark, d).orders.where("o_orderpriority IN ('1-URGENT', '2-HIGH')")
    return o.select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"),
                    F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("delete")).otherwise(F.lit("upsert")).alias("op"))


_PREV_SQL = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P')"
_SRC_SQL = ("(SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, "
            "CASE WHEN o_orderpriority = '2-HIGH' THEN 'delete' ELSE 'upsert' END AS op FROM orders "
            "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))")


@query(
    "upsert_table",
    f"""SELECT * FROM {_PREV_SQL} t WHERE NOT EXISTS (SELECT 1 FROM {_SRC_SQL} s WHERE s.o_orderkey = t.o_orderkey)
        UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {_SRC_SQL} WHERE op <> 'delete'""",
)
def q_upsert_table(spark, d):
    path = scratch(spark, "upsert")
    tables.write_table(_prev(spark, d), path, "overwrite")
    tables.upsert_table(_src(spark, d), path, "o_orderkey", delete_column="op")
    return spark.read.parquet(path)


@query("upsert_rows_first_load", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {_SRC_SQL} WHERE op <> 'delete'")
def q_upsert_first(spark, d):
    path = scratch(spark, "upsert-first")
    tables.upsert_table(_src(spark, d), path, "o_orderkey", delete_column="op")
    return spark.read.parquet(path)


@query(
    "merge_table",
    f"""SELECT COALESCE(t.o_orderkey, s.o_orderkey) AS o_orderkey,
               CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
               CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
               t.o_totalprice
        FROM {_PREV_SQL} t FULL JOIN (SELECT o_orderkey, o_custkey, o_orderstatus, op FROM {_SRC_SQL}) s ON t.o_orderkey = s.o_orderkey
        WHERE NOT (s.o_orderkey IS NOT NULL AND COALESCE(s.op = 'delete', FALSE))""",
)
def q_merge_table(spark, d):
    path = scratch(spark, "merge")
    tables.write_table(_prev(spark, d), path, "overwrite")
    src = _src(spark, d).drop("o_totalprice")  # merge updates only the columns the source carries
    tables.merge_table(src, path, "o_orderkey", delete_column="op")
    return spark.read.parquet(path)


@query("write_table_append", f"SELECT * FROM {_PREV_SQL} UNION ALL SELECT * FROM {_PREV_SQL}")
def q_write_append(spark, d):
    path = scratch(spark, "append")
    tables.write_table(_prev(spark, d), path, "overwrite")
    tables.write_table(_prev(spark, d), path, "append")
    return spark.read.parquet(path)


_V1, _V2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def _current(spark, d):
    return Tables(spark, d).orders.where("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _two_versions(spark, d):
    path = scratch(spark, "versions")
    tables.write_snapshot(_prev(spark, d), path, _V1)
    tables.write_snapshot(_current(spark, d), path, _V2)
    return path


@query("read_as_of", f"SELECT * FROM {_PREV_SQL}")
def q_read_as_of(spark, d):
    path = _two_versions(spark, d)
    return tables.read_as_of(spark, path, as_of_timestamp=dt.datetime(2024, 1, 15))


_CUR_SQL = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')"
_CHANGES_SQL = f"""
WITH j AS (SELECT o.o_orderkey AS ok, o.o_custkey AS oc, o.o_orderstatus AS os, o.o_totalprice AS op, o.o_orderkey IS NOT NULL AS in_o,
                  n.o_orderkey AS nk, n.o_custkey AS nc, n.o_orderstatus AS ns, n.o_totalprice AS np, n.o_orderkey IS NOT NULL AS in_n
           FROM {_PREV_SQL} o FULL JOIN {_CUR_SQL} n ON o.o_orderkey IS NOT DISTINCT FROM n.o_orderkey)
SELECT ok AS o_orderkey, oc AS o_custkey, os AS o_orderstatus, op AS o_totalprice, 'update_preimage' AS change_type FROM j
  WHERE in_o AND in_n AND NOT (oc IS NOT DISTINCT FROM nc AND os IS NOT DISTINCT FROM ns AND op IS NOT DISTINCT FROM np)
UNION ALL SELECT nk, nc, ns, np, 'update_postimage' FROM j
  WHERE in_o AND in_n AND NOT (oc IS NOT DISTINCT FROM nc AND os IS NOT DISTINCT FROM ns AND op IS NOT DISTINCT FROM np)
UNION ALL SELECT nk, nc, ns, np, 'insert' FROM j WHERE in_n AND NOT in_o
UNION ALL SELECT ok, oc, os, op, 'delete' FROM j WHERE in_o AND NOT in_n
"""


@query("read_changes", _CHANGES_SQL)
def q_read_changes(spark, d):
    path = _two_versions(spark, d)
    return tables.read_changes(spark, path, "o_orderkey", _V1, _V2)


@query(
    "diff_summary",
    f"""WITH c AS ({_CHANGES_SQL}), s AS (SELECT COUNT(*) FILTER (WHERE change_type = 'insert') AS added,
                COUNT(*) FILTER (WHERE change_type = 'delete') AS removed,
                COUNT(*) FILTER (WHERE change_type = 'update_postimage') AS updated FROM c)
        SELECT added, removed, updated, added + removed + updated AS total_changes,
               CAST(added AS VARCHAR) || ' added, ' || CAST(removed AS VARCHAR) || ' removed, ' || CAST(updated AS VARCHAR) || ' updated' AS summary
        FROM s""",
)
def q_diff_summary(spark, d):
    path = _two_versions(spark, d)
    return agg.diff_summary(tables.read_changes(spark, path, "o_orderkey", _V1, _V2))


@query("read_changes_incremental", _CHANGES_SQL)
def q_read_changes_incremental(spark, d):
    path = _two_versions(spark, d)
    feed, _ = tables.read_changes_incremental(spark, path, "o_orderkey", _V1)
    return feed
