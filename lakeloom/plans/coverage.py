"""One query per remaining operator key of the inventory: single-purpose
forms of functions that other queries exercise together, and the sinks,
each written to the scratch area and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import nested as nf
from lakeloom.functions import numeric as nu
from lakeloom.operators import quality as qa
from lakeloom.plans.io import scratch
from lakeloom.plans.registry import Tables, query
from lakeloom.sources import readers, tables, writers

# ------------------------------------------------------------ array functions

_WORDS = "string_split(p_name, ' ')"


def _words(spark, d):
    return Tables(spark, d).part.select("p_partkey", F.split("p_name", " ").alias("words"))


@query("arr_element", f"SELECT p_partkey, {_WORDS}[2] AS words FROM part")
def q_arr_element(spark, d):
    return nf.arr_element(_words(spark, d), "words", 2)


@query("arr_distinct", f"SELECT p_partkey, CAST(to_json(list_sort(list_distinct({_WORDS} || {_WORDS}))) AS VARCHAR) AS words FROM part")
def q_arr_distinct(spark, d):
    w = _words(spark, d).withColumn("words", F.concat("words", "words"))
    return nf.arr_distinct(w, "words").select("p_partkey", F.to_json(F.array_sort("words")).alias("words"))


@query("arr_contains", f"SELECT p_partkey, COALESCE(list_contains({_WORDS}, 'plate'), FALSE) AS words_contains FROM part")
def q_arr_contains(spark, d):
    return nf.arr_contains(_words(spark, d), "words", "plate").drop("words")


@query("arr_length", f"SELECT p_partkey, CAST(len({_WORDS}) AS BIGINT) AS words_length FROM part")
def q_arr_length(spark, d):
    return nf.arr_length(_words(spark, d), "words").drop("words")


@query("zip_to_table", "SELECT p_name AS name, p_brand AS brand FROM part")
def q_zip(spark, d):
    p = Tables(spark, d).part.select(F.array(F.lit("name"), F.lit("brand")).alias("h"),
                                     F.array(F.array("p_name", "p_brand")).alias("rows"))
    return nf.zip_to_table(p, "h", "rows", headings=["name", "brand"])


@query("json_stringify", "SELECT c_custkey, CAST(to_json(struct_pack(c_name := c_name, n := c_nationkey)) AS VARCHAR) AS info FROM customer")
def q_json_stringify(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", F.struct(F.col("c_name"), F.col("c_nationkey").alias("n")).alias("info"))
    return nf.json_stringify(c, "info")


# ---------------------------------------------------------- numeric, single

def _li(spark, d):
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount",
                                            "l_extendedprice", "l_tax")


_LI = "l_orderkey, l_linenumber, l_partkey"


@query("num_round", f"SELECT {_LI}, round(l_quantity / 4, 1) AS q FROM lineitem")
def q_num_round(spark, d):
    return nu.num_round(_li(spark, d).withColumn("q", F.col("l_quantity") / 4), "q", 1).select("l_orderkey", "l_linenumber", "l_partkey", "q")


@query("num_abs", f"SELECT {_LI}, abs(l_discount - 0.05) AS d FROM lineitem")
def q_num_abs(spark, d):
    return nu.num_abs(_li(spark, d).withColumn("d", F.col("l_discount") - 0.05), "d").select("l_orderkey", "l_linenumber", "l_partkey", "d")


@query("num_sqrt", f"SELECT {_LI}, ROUND(sqrt(l_extendedprice), 6) AS l_extendedprice FROM lineitem")
def q_num_sqrt(spark, d):
    out = nu.num_sqrt(_li(spark, d), "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 6).alias("l_extendedprice"))


@query("num_power", f"SELECT {_LI}, ROUND(power(l_quantity, 3), 6) AS l_quantity FROM lineitem")
def q_num_power(spark, d):
    out = nu.num_power(_li(spark, d), "l_quantity", 3)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 6).alias("l_quantity"))


@query("num_mod", f"SELECT {_LI}, l_linenumber % 4 AS m FROM lineitem")
def q_num_mod(spark, d):
    return nu.num_mod(_li(spark, d), "l_linenumber", 4, output="m").select("l_orderkey", "l_linenumber", "l_partkey", "m")


@query("num_log", f"SELECT {_LI}, ROUND(log(2, l_extendedprice), 9) AS l_extendedprice FROM lineitem")
def q_num_log(spark, d):
    out = nu.num_log(_li(spark, d), "l_extendedprice", 2)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 9).alias("l_extendedprice"))


@query("num_sign", "SELECT c_custkey, CAST(sign(c_acctbal) AS INTEGER) AS c_acctbal_sign FROM customer")
def q_num_sign(spark, d):
    return nu.num_sign(Tables(spark, d).customer.select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal")


# ------------------------------------------------------------------ quality

@query("check_schema", "SELECT * FROM customer WHERE c_custkey IS NOT NULL AND c_name IS NOT NULL AND c_acctbal IS NOT NULL")
def q_check_schema(spark, d):
    return qa.check_schema(Tables(spark, d).customer, ["c_custkey", "c_name", "c_acctbal"]).passed


@query(
    "switch",
    """SELECT *, CASE WHEN COALESCE(o_totalprice > 300000, FALSE) THEN 'case_1'
                      WHEN COALESCE(o_totalprice > 100000, FALSE) THEN 'case_2' ELSE 'default' END AS route FROM orders""",
)
def q_switch(spark, d):
    outs = qa.switch(Tables(spark, d).orders, ["o_totalprice > 300000", "o_totalprice > 100000"])
    frames = [f.withColumn("route", F.lit(name)) for name, f in outs.items()]
    res = frames[0]
    for f in frames[1:]:
        res = res.unionByName(f)
    return res


# ------------------------------------------------------------------- sinks

@query("write_csv", "SELECT * FROM orders")
def q_write_csv(spark, d):
    o = Tables(spark, d).orders
    path = scratch(spark, "wcsv")
    writers.write_csv(o, path, partition_by="o_orderstatus")
    back = readers.read_csv(spark, path, schema=o.drop("o_orderstatus").schema)
    return back.select(*o.columns)


@query("write_json", "SELECT event_id, user_id, event_type, value FROM events")
def q_write_json(spark, d):
    e = Tables(spark, d).events.select("event_id", "user_id", "event_type", "value")
    path = scratch(spark, "wjson")
    writers.write_json(e, path)
    return spark.read.schema(e.schema).json(path)


@query("write_xml", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def q_write_xml(spark, d):
    s = Tables(spark, d).supplier.select("s_suppkey", "s_name", "s_nationkey")
    path = scratch(spark, "wxml")
    writers.write_xml(s, path, "suppliers", "supplier")
    back = readers.read_xml(spark, path, "suppliers/supplier")
    return back.select(F.col("s_suppkey").cast("bigint"), "s_name", F.col("s_nationkey").cast("int"))


@query("write_table", "SELECT * FROM supplier")
def q_write_table(spark, d):
    path = scratch(spark, "wtable")
    s = Tables(spark, d).supplier
    tables.write_table(s.limit(0), path, "overwrite")
    tables.write_table(s, path, "truncate")
    return spark.read.parquet(path)


@query("read_cloud", "SELECT * FROM customer")
def q_read_cloud(spark, d):
    c = Tables(spark, d).customer
    path = scratch(spark, "cloud") + "/customer.csv"
    writers.write_cloud(c, "file", path)
    return readers.read_cloud(spark, "file", path, schema=c.schema)


@query("write_cloud", "SELECT * FROM supplier")
def q_write_cloud(spark, d):
    s = Tables(spark, d).supplier
    path = scratch(spark, "cloudw") + "/supplier.parquet"
    writers.write_cloud(s, "file", path)
    return readers.read_cloud(spark, "file", path)


_DL_SRC = "(SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS cust FROM orders)"


def _dl_frame(spark, d):
    o = Tables(spark, d).orders
    return o.select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a"))
                    .otherwise(F.col("o_custkey").cast("string")).alias("cust"))


@query("write_with_dead_letter", f"SELECT o_orderkey, CAST(cust AS BIGINT) AS cust FROM {_DL_SRC} WHERE cust <> 'n/a'")
def q_write_dead_letter(spark, d):
    clean_path, dl_path = scratch(spark, "clean"), scratch(spark, "deadletter")
    writers.write_with_dead_letter(_dl_frame(spark, d), {"cust": "int64"},
                                   lambda c: c.write.mode("overwrite").parquet(clean_path), dl_path)
    return spark.read.parquet(clean_path)


@query("dead_letter", f"SELECT o_orderkey, cust FROM {_DL_SRC} WHERE cust = 'n/a'")
def q_dead_letter(spark, d):
    path = scratch(spark, "dl")
    writers.dead_letter(_dl_frame(spark, d).where("cust = 'n/a'"), path, "parquet")
    return spark.read.parquet(path).drop("__rejected_at")


@query("fan_out", "SELECT 'F' AS branch, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'rest', COUNT(*) FROM orders WHERE o_orderstatus <> 'F'")
def q_fan_out(spark, d):
    a, b = scratch(spark, "fan-a"), scratch(spark, "fan-b")
    writers.fan_out(Tables(spark, d).orders, [
        lambda f: f.where("o_orderstatus = 'F'").write.mode("overwrite").parquet(a),
        lambda f: f.where("o_orderstatus <> 'F'").write.mode("overwrite").parquet(b),
    ])
    return (spark.read.parquet(a).agg(F.lit("F").alias("branch"), F.count(F.lit(1)).alias("n"))
            .unionByName(spark.read.parquet(b).agg(F.lit("rest").alias("branch"), F.count(F.lit(1)).alias("n"))))


@query("partition_guard", "SELECT * FROM lineitem")
def q_partition_guard(spark, d):
    li = Tables(spark, d).lineitem
    path = scratch(spark, "guard")
    writers.partition_guard(li, ["l_returnflag", "l_linestatus"], max_partitions=50)
    writers.write_parquet(li, path, partition_by=["l_returnflag", "l_linestatus"], max_partitions=50)
    return spark.read.parquet(path).select(*li.columns)


@query("pii_guard", "SELECT c_custkey, md5(c_name) AS c_name, c_mktsegment FROM customer")
def q_pii_guard(spark, d):
    c = writers.tag_pii(Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment"), "c_name")
    masked = c.withColumn("c_name", F.md5("c_name"))
    path = scratch(spark, "pii")
    writers.pii_guard(masked, require_columns="c_custkey").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("write_kafka", "SELECT CAST(s_suppkey AS VARCHAR) AS key, to_json(struct_pack(s_suppkey, s_name))::VARCHAR AS value FROM supplier")
def q_write_kafka(spark, d):
    # The broker client jar is not on this classpath: the message payload
    # (key + one JSON document per row) is what is produced and checked.
    return writers.kafka_payload(Tables(spark, d).supplier.select("s_suppkey", "s_name"), "s_suppkey")


@query(
    "read_kafka",
    "SELECT event_id AS offset, epoch_us(ts) // 1000 AS timestamp_ms, CAST(user_id AS VARCHAR) AS key, props AS value FROM events",
)
def q_read_kafka(spark, d):
    # Record shaping on a frame with the Kafka source schema (key/value
    # binary, offset, partition, timestamp) built from the events table.
    e = Tables(spark, d).events
    raw = e.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"),
                   F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
                   F.col("ts").cast("timestamp").alias("timestamp"))
    return readers.shape_kafka(raw, partition=0)


@query("inspect")
def q_inspect(spark, d):
    _schema, preview = readers.inspect(spark, f"{d}/orders.parquet")
    return preview
