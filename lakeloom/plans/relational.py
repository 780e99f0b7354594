"""Queries for projection, row selection, aggregation, joins, set
operations and windows over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import aggregate as agg
from lakeloom.operators import columns as cols
from lakeloom.operators import joins as jn
from lakeloom.operators import rows, sketches
from lakeloom.operators import windows as win
from lakeloom.plans.registry import Tables, query


def money(c) -> F.Column:
    """Exact money total: sum in DECIMAL, rounded to cents, as DOUBLE."""
    return F.round(F.sum(F.col(c).cast("decimal(18,4)") if isinstance(c, str) else c.cast("decimal(18,4)")), 2).cast("double")


MONEY_SQL = "CAST(ROUND(SUM(CAST({} AS DECIMAL(18,4))), 2) AS DOUBLE)"


# --------------------------------------------------------------------------
# Flagship: revenue per nation, top nations per region
# --------------------------------------------------------------------------

def revenue_by_nation(spark, sf_dir, top_per_region: int = 3):
    t = Tables(spark, sf_dir)
    li = cols.filter_rows(
        t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"),
        (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz")),
    )
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select("c_custkey", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    j = jn.join_inner(li, o, "l_orderkey", "o_orderkey")
    j = jn.join_inner(j, c, "o_custkey", "c_custkey")
    j = jn.join_inner(j, n, "c_nationkey", "n_nationkey")
    j = jn.join_inner(j, r, "n_regionkey", "r_regionkey")
    j = cols.add_columns(j, [{"name": "rev", "expression": "l_extendedprice * (1 - l_discount)"}])
    g = j.groupBy("r_name", "n_name").agg(money("rev").alias("revenue"), F.count(F.lit(1)).alias("lines"))
    top = rows.rank_filter(g, "r_name", "revenue", n=top_per_region, desc=True)
    return top


REVENUE_BY_NATION_SQL = """
SELECT r_name, n_name, revenue, lines FROM (
  SELECT r_name, n_name, revenue, lines,
         row_number() OVER (PARTITION BY r_name ORDER BY revenue DESC NULLS LAST) AS rn
  FROM (
    SELECT r_name, n_name,
           CAST(ROUND(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue,
           COUNT(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
         JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey
    WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2001-01-01'
    GROUP BY r_name, n_name))
WHERE rn <= 3
"""

query("revenue_by_nation", REVENUE_BY_NATION_SQL)(revenue_by_nation)


# --------------------------------------------------------------------------
# 2.1 read_parquet / 2.3 projection, columns, filters
# --------------------------------------------------------------------------

@query("read_parquet", "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem")
def q_read_parquet(spark, d):
    from lakeloom.sources.readers import read_parquet

    return read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_quantity", "l_shipdate"])


@query("filter_rows", "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30")
def q_filter_rows(spark, d):
    return cols.filter_rows(Tables(spark, d).lineitem, "l_returnflag = 'R' AND l_quantity > 30")


@query("filter_rows_reject", "SELECT * FROM lineitem WHERE NOT COALESCE(l_returnflag = 'R' AND l_quantity > 30, FALSE)")
def q_filter_reject(spark, d):
    return cols.filter_split(Tables(spark, d).lineitem, "l_returnflag = 'R' AND l_quantity > 30").rejected


@query("project", "SELECT o_orderkey, o_totalprice FROM orders")
def q_project(spark, d):
    return cols.project(Tables(spark, d).orders, "o_orderkey, o_totalprice")


@query("drop_columns", "SELECT * EXCLUDE (o_orderpriority, o_orderdate) FROM orders")
def q_drop(spark, d):
    return cols.drop_columns(Tables(spark, d).orders, ["o_orderpriority", "o_orderdate"])


@query("reorder", "SELECT o_totalprice, o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def q_reorder(spark, d):
    return cols.reorder(Tables(spark, d).orders, ["o_totalprice", "o_orderkey"])


@query("rename", "SELECT c_nationkey, c_acctbal, c_mktsegment, c_custkey AS customer_id, c_name AS customer_name FROM customer")
def q_rename(spark, d):
    return cols.rename(Tables(spark, d).customer, {"c_custkey": "customer_id", "c_name": "customer_name"})


@query(
    "cast_columns",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey, o_orderstatus,
              CAST(ROUND(o_totalprice) AS INTEGER) AS o_totalprice,
              try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS o_orderdate, o_orderpriority FROM orders""",
)
def q_cast(spark, d):
    # the date travels as day/month/year text and is cast back with a format
    o = Tables(spark, d).orders.withColumn("o_orderdate", F.date_format("o_orderdate", "dd/MM/yyyy"))
    return cols.cast_columns(
        o,
        [{"column": "o_orderkey", "targetType": "string"}, {"column": "o_totalprice", "targetType": "int32"},
         {"column": "o_orderdate", "targetType": "timestamp", "format": "%d/%m/%Y"}],
    )


@query(
    "add_columns",
    """SELECT *, l_extendedprice * (1 - l_discount) AS disc_price,
              CAST(l_quantity AS BIGINT) AS qty FROM lineitem""",
)
def q_add_columns(spark, d):
    return cols.add_columns(
        Tables(spark, d).lineitem,
        [{"name": "disc_price", "expression": "l_extendedprice * (1 - l_discount)"},
         {"name": "qty", "expression": "l_quantity", "type": "int64"}],
    )


@query(
    "coalesce_cols",
    """SELECT d.doc_id, COALESCE(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def q_coalesce(spark, d):
    t = Tables(spark, d)
    j = jn.join_left(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), "doc_id")
    return cols.coalesce_cols(j, "quality", "coalesce(quality, -1)")


@query("compare_columns", "SELECT *, l_tax > l_discount AS l_tax_gt_l_discount FROM lineitem")
def q_compare(spark, d):
    return cols.compare_columns(Tables(spark, d).lineitem, "l_tax", "l_discount", "gt")


@query("add_uuid")
def q_uuid(spark, d):
    return cols.add_uuid(Tables(spark, d).orders.select("o_orderkey"))


@query(
    "surrogate_key",
    "SELECT *, md5(concat_ws('||', CAST(o_custkey AS VARCHAR), o_orderstatus)) AS surrogate_key FROM orders",
)
def q_skey(spark, d):
    return cols.surrogate_key(Tables(spark, d).orders, ["o_custkey", "o_orderstatus"])


@query(
    "surrogate_key_sequence",
    """SELECT o_orderkey, o_custkey, o_totalprice,
              row_number() OVER (ORDER BY o_orderkey) AS surrogate_key
       FROM orders""",
)
def q_skey_seq(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return cols.surrogate_key(o, ["o_orderkey"], mode="sequence")


@query(
    "row_hash",
    """SELECT c_custkey, c_name, c_mktsegment,
              sha256(concat_ws('||', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)) AS _row_hash FROM customer""",
)
def q_row_hash(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment")
    return cols.row_hash(c, algorithm="sha256")


@query("audit_stamp", "SELECT *, 'tpch' AS _source, 'batch-1' AS _batch_id FROM orders")
def q_audit(spark, d):
    return cols.audit_stamp(Tables(spark, d).orders, loaded_at=False, source="tpch", batch_id="batch-1")


@query(
    "map_join",
    """SELECT l.l_orderkey AS orderkey, l.l_linenumber AS line, o.o_orderstatus AS status,
              p.p_brand AS brand, l.l_quantity * p.p_retailprice AS list_value
       FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
            INNER JOIN part p ON l.l_partkey = p.p_partkey
       WHERE o.o_orderstatus <> 'P'""",
)
def q_map_join(spark, d):
    t = Tables(spark, d)
    return cols.map_join(
        t.lineitem,
        {"orderkey": "main.l_orderkey", "line": "main.l_linenumber", "status": "lookup_1.o_orderstatus",
         "brand": "lookup_2.p_brand", "list_value": "main.l_quantity * lookup_2.p_retailprice"},
        lookups=[{"df": t.orders, "left_key": "l_orderkey", "right_key": "o_orderkey", "join_type": "left"},
                 {"df": t.part, "left_key": "l_partkey", "right_key": "p_partkey", "join_type": "inner"}],
        filter="lookup_1.o_orderstatus <> 'P'",
    )


@query(
    "fill_constant",
    """SELECT event_id, user_id, COALESCE(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 0.0) AS value
       FROM events""",
)
def q_fill_constant(spark, d):
    e = Tables(spark, d).events.select(
        "event_id", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    return cols.fill_constant(e, "value", 0.0)


@query("log_rows", "SELECT * FROM lineitem")
def q_log_rows(spark, d):
    out, _obs = cols.log_rows(Tables(spark, d).lineitem, "lineitem_rows")
    return out


# --------------------------------------------------------------------------
# 2.4 Row selection
# --------------------------------------------------------------------------

@query("sort_rows", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def q_sort(spark, d):
    return rows.sort_rows(Tables(spark, d).orders, [("o_totalprice", "desc"), ("o_orderkey", "asc")])


@query("limit_rows")
def q_limit(spark, d):
    return rows.limit_rows(Tables(spark, d).orders, 100)


@query("top_n", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def q_top_n(spark, d):
    return rows.top_n(Tables(spark, d).orders, 25, [("o_totalprice", "desc"), "o_orderkey"])


@query("skip_rows", "SELECT * FROM orders ORDER BY o_orderkey OFFSET 100")
def q_skip(spark, d):
    return rows.skip_rows(Tables(spark, d).orders, 100, ["o_orderkey"])


@query("sample_rows")
def q_sample_rows(spark, d):
    return rows.sample_rows(Tables(spark, d).orders, 100, seed=42)


@query("sample_percent")
def q_sample_pct(spark, d):
    return rows.sample_percent(Tables(spark, d).orders, 10, method="reservoir", seed=42)


@query("sample_percent_bernoulli")
def q_sample_bern(spark, d):
    return rows.sample_percent(Tables(spark, d).orders, 10, method="bernoulli", seed=42)


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def q_distinct(spark, d):
    return rows.distinct_rows(Tables(spark, d).lineitem.select("l_returnflag", "l_linestatus", "l_discount"))


@query(
    "distinct_on",
    """SELECT DISTINCT ON (l_orderkey) * FROM lineitem
       ORDER BY l_orderkey, l_extendedprice DESC NULLS LAST, l_partkey, l_suppkey, l_linenumber, l_quantity,
                l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate""",
)
def q_distinct_on(spark, d):
    return rows.distinct_on(Tables(spark, d).lineitem, "l_orderkey", [("l_extendedprice", "desc")])


@query(
    "rank_filter",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber) AS rn FROM lineitem) WHERE rn <= 2""",
)
def q_rank_filter(spark, d):
    return rows.rank_filter(Tables(spark, d).lineitem, "l_orderkey", "l_extendedprice desc, l_linenumber asc", n=2)


# --------------------------------------------------------------------------
# 2.5 Aggregation
# --------------------------------------------------------------------------

@query(
    "group_by",
    """SELECT l_returnflag, l_linestatus, CAST(SUM(l_quantity) AS DOUBLE) AS sum_qty,
              CAST(ROUND(SUM(CAST(l_extendedprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS sum_base_price,
              COUNT(*) AS count_all, MIN(l_discount) AS min_l_discount, MAX(l_tax) AS max_l_tax
       FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10""",
)
def q_group_by(spark, d):
    li = Tables(spark, d).lineitem.withColumn("l_extendedprice", F.col("l_extendedprice").cast("decimal(18,4)"))
    out = agg.group_by(
        li, ["l_returnflag", "l_linestatus"],
        [{"column": "l_quantity", "func": "sum", "output": "sum_qty"},
         {"column": "l_extendedprice", "func": "sum", "output": "sum_base_price"},
         {"column": "*", "func": "count"},
         {"column": "l_discount", "func": "min"}, {"column": "l_tax", "func": "max"}],
        having="count_all > 10",
    )
    return out.withColumn("sum_base_price", F.round("sum_base_price", 2).cast("double"))


@query(
    "rollup",
    """SELECT c_mktsegment, c_nationkey, CAST(ROUND(SUM(CAST(c_acctbal AS DECIMAL(18,4))), 2) AS DOUBLE) AS total,
              COUNT(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""",
)
def q_rollup(spark, d):
    c = Tables(spark, d).customer.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,4)"))
    out = agg.rollup(c, ["c_mktsegment", "c_nationkey"],
                     [{"column": "c_acctbal", "func": "sum", "output": "total"}, {"column": "*", "func": "count", "output": "n"}])
    return out.withColumn("total", F.round("total", 2).cast("double"))


@query(
    "cube",
    """SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)
def q_cube(spark, d):
    return agg.cube(Tables(spark, d).orders, ["o_orderstatus", "o_orderpriority"], [{"column": "*", "func": "count", "output": "n"}])


@query(
    "grouping_sets",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem
       GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""",
)
def q_gsets(spark, d):
    return agg.grouping_sets(Tables(spark, d).lineitem, [["l_returnflag"], ["l_linestatus"], []],
                             [{"column": "*", "func": "count", "output": "n"}])


@query("count_rows", "SELECT COUNT(*) AS row_count FROM lineitem")
def q_count(spark, d):
    return agg.count_rows(Tables(spark, d).lineitem)


@query("count_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def q_count_distinct(spark, d):
    return agg.count_distinct(Tables(spark, d).orders, "o_custkey", "o_orderstatus", "customers")


# Estimates are checked against the exact figures: the SQL states what must hold.
_DISTINCT_SQL = "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, TRUE AS near FROM orders GROUP BY o_orderstatus"
_MEDIAN_SQL = "SELECT l_returnflag, COUNT(*) AS n, TRUE AS near FROM lineitem GROUP BY l_returnflag"


def _distinct_check(orders, estimates, bound: float):
    """``estimates``: o_orderstatus, estimate. Near: within ``bound`` of the exact count."""
    exact = orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))
    return exact.join(estimates, "o_orderstatus").select(
        "o_orderstatus", "customers", (F.abs(F.col("estimate") / F.col("customers") - 1) <= bound).alias("near"))


def _median_check(lines, estimates, bound: float):
    """``estimates``: l_returnflag, estimate. Near: its rank is within ``bound`` of the middle."""
    held = lines.join(estimates, "l_returnflag").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("l_extendedprice") < F.col("estimate")).cast("double")).alias("below"),
        F.avg((F.col("l_extendedprice") <= F.col("estimate")).cast("double")).alias("upto"))
    return held.select("l_returnflag", "n", ((F.col("below") <= 0.5 + bound) & (F.col("upto") >= 0.5 - bound)).alias("near"))


@query("approx_distinct", _DISTINCT_SQL)
def q_approx_distinct(spark, d):
    orders = Tables(spark, d).orders
    return _distinct_check(orders, agg.approx_distinct(orders, "o_custkey", "o_orderstatus", "estimate"), 0.04)


@query("approx_quantile", _MEDIAN_SQL)
def q_approx_quantile(spark, d):
    lines = Tables(spark, d).lineitem
    found = agg.approx_quantile(lines, "l_extendedprice", 0.5, "l_returnflag")
    return _median_check(lines, found.withColumnRenamed("l_extendedprice_q50", "estimate"), 0.001)


@query("approx_distinct_merged", _DISTINCT_SQL)
def q_approx_distinct_merged(spark, d):
    """Sketches per status and day are stored, then merged per status."""
    from lakeloom.plans.io import scratch

    orders, path = Tables(spark, d).orders, scratch(spark, "hll")
    sketches.sketch_groups(orders, ["o_orderstatus", "o_orderdate"], distinct="o_custkey").write.parquet(path)
    merged = sketches.merge_groups(spark.read.parquet(path), "o_orderstatus")
    return _distinct_check(orders, merged.select("o_orderstatus", sketches.distinct_estimate("o_custkey").alias("estimate")), 0.08)


@query("approx_quantile_merged", _MEDIAN_SQL)
def q_approx_quantile_merged(spark, d):
    from lakeloom.plans.io import scratch

    lines, path = Tables(spark, d).lineitem, scratch(spark, "kll")
    sketches.sketch_groups(lines, ["l_returnflag", "l_linestatus", "l_linenumber"], quantiles="l_extendedprice").write.parquet(path)
    merged = sketches.merge_groups(spark.read.parquet(path), "l_returnflag")
    return _median_check(lines, merged.select("l_returnflag", sketches.quantile_estimate("l_extendedprice", 0.5).alias("estimate")), 0.03)


@query(
    "collect_list",
    """SELECT o_custkey, array_to_string(list(o_orderstatus ORDER BY o_orderstatus), ',') AS items
       FROM orders GROUP BY o_custkey""",
)
def q_collect_list(spark, d):
    out = agg.collect_list(Tables(spark, d).orders, "o_orderstatus", "o_custkey")
    return out.withColumn("items", F.array_join("items", ","))


@query(
    "json_array_agg",
    """SELECT conv_id, CAST(to_json(list(role ORDER BY role)) AS VARCHAR) AS role_array
       FROM conversations GROUP BY conv_id""",
)
def q_json_array_agg(spark, d):
    return agg.json_array_agg(Tables(spark, d).conversations, "role", "conv_id")


@query(
    "denormalize",
    """SELECT o_custkey,
              string_agg(o_orderstatus, ', ' ORDER BY o_orderstatus, o_orderpriority) AS o_orderstatus,
              string_agg(o_orderpriority, ', ' ORDER BY o_orderstatus, o_orderpriority) AS o_orderpriority
       FROM orders GROUP BY o_custkey""",
)
def q_denormalize(spark, d):
    return agg.denormalize(Tables(spark, d).orders, "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query(
    "survivor",
    """SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn, arg_max(text, turn) AS text
       FROM conversations GROUP BY conv_id""",
)
def q_survivor(spark, d):
    c = Tables(spark, d).conversations.select("conv_id", "role", "turn", "text")
    return agg.survivor(c, "conv_id", "most_recent", "turn")


# --------------------------------------------------------------------------
# 2.6 Joins and set operations
# --------------------------------------------------------------------------

@query("join_inner", "SELECT orders.*, c_name, c_nationkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def q_join_inner(spark, d):
    t = Tables(spark, d)
    return jn.join_inner(t.orders, t.customer, "o_custkey", "c_custkey")


@query(
    "join_left",
    """SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def q_join_left(spark, d):
    t = Tables(spark, d)  # labels cover only some documents
    return jn.join_left(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id")


@query(
    "join_right",
    """SELECT COALESCE(l.doc_id, d.doc_id) AS doc_id, l.quality, l.toxic, d.lang
       FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id""",
)
def q_join_right(spark, d):
    t = Tables(spark, d)
    return jn.join_right(t.labels, t.documents.select(F.col("doc_id").alias("d_id"), "lang"), "doc_id", "d_id")


@query(
    "join_full",
    """SELECT COALESCE(s.s_suppkey, c.c_custkey) AS s_suppkey, s.s_name, c.c_name
       FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey""",
)
def q_join_full(spark, d):
    t = Tables(spark, d)
    return jn.join_full(t.supplier.select("s_suppkey", "s_name"), t.customer.select("c_custkey", "c_name"), "s_suppkey", "c_custkey")


@query(
    "lookup",
    "SELECT l.*, p.p_name, p.p_brand FROM lineitem l LEFT JOIN (SELECT p_partkey AS l_partkey, p_name, p_brand FROM part) p USING (l_partkey)",
)
def q_lookup(spark, d):
    t = Tables(spark, d)
    return jn.lookup(t.lineitem, t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")


@query("join_cross", "SELECT * FROM customer CROSS JOIN region")
def q_cross(spark, d):
    # a growing table against a fixed five-row one: output stays 5x the input
    t = Tables(spark, d)
    return jn.join_cross(t.customer, t.region)


@query("join_semi", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_semi(spark, d):
    t = Tables(spark, d)
    return jn.join_semi(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id", "doc_id")


@query("join_anti", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_anti(spark, d):
    t = Tables(spark, d)
    return jn.join_anti(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id", "doc_id")


@query(
    "union_all",
    """SELECT o_orderkey AS k, o_orderstatus AS status, NULL::DOUBLE AS amount FROM orders
       UNION ALL BY NAME SELECT l_orderkey AS k, l_extendedprice AS amount FROM lineitem""",
)
def q_union_all(spark, d):
    t = Tables(spark, d)
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    b = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("amount"))
    return jn.union_all(a, b)


@query(
    "union_distinct",
    """SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey AS nationkey FROM supplier""",
)
def q_union_distinct(spark, d):
    t = Tables(spark, d)
    return jn.union_distinct(t.customer.select(F.col("c_nationkey").alias("nationkey")),
                             t.supplier.select(F.col("s_nationkey").alias("nationkey")))


@query(
    "merge_streams",
    """SELECT c_custkey AS id, c_name AS name FROM customer
       UNION ALL SELECT s_suppkey, s_name FROM supplier""",
)
def q_merge_streams(spark, d):
    t = Tables(spark, d)
    return jn.merge_streams(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
                            t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query(
    "intersect_rows",
    "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
)
def q_intersect(spark, d):
    o = Tables(spark, d).orders
    return jn.intersect_rows(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")),
                             o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("custkey")))


@query(
    "except_rows",
    "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
)
def q_except(spark, d):
    t = Tables(spark, d)
    return jn.except_rows(t.documents.select("doc_id"), t.labels.select("doc_id"))


@query("ref_integrity", "SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def q_ref_pass(spark, d):
    t = Tables(spark, d)
    return jn.ref_integrity(t.documents.select("doc_id", "source"), t.labels, "doc_id", "doc_id").passed


@query("ref_integrity_reject", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def q_ref_reject(spark, d):
    t = Tables(spark, d)
    return jn.ref_integrity(t.documents.select("doc_id", "source"), t.labels, "doc_id", "doc_id").rejected


# The target is the source without status P, so one row per key holds both sides.
RECONCILE_SQL = """
WITH sides AS (
  SELECT COUNT(*) AS s, COUNT(*) FILTER (o_orderstatus <> 'P') AS t, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS s_amt,
         SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus <> 'P') AS t_amt
  FROM orders GROUP BY o_custkey),
wide AS (
  SELECT SUM(s)::DOUBLE AS source_rows, SUM(t)::DOUBLE AS target_rows, COALESCE(SUM(s) FILTER (t = 0), 0)::DOUBLE AS rows_only_in_source,
         COALESCE(SUM(t) FILTER (s = 0), 0)::DOUBLE AS rows_only_in_target, SUM(s * t)::DOUBLE AS keys_matched,
         SUM(s_amt)::DOUBLE AS amt_source_sum, SUM(t_amt)::DOUBLE AS amt_target_sum,
         SUM(s_amt)::DOUBLE - SUM(t_amt)::DOUBLE AS amt_difference
  FROM sides)
UNPIVOT wide ON COLUMNS(*) INTO NAME metric VALUE value
"""


@query("reconcile", RECONCILE_SQL)
def q_reconcile(spark, d):
    o = Tables(spark, d).orders
    s = o.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("amt"))
    t = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("amt"))
    return jn.reconcile(s, t, "k", "amt")


# --------------------------------------------------------------------------
# 2.7 Windows
# --------------------------------------------------------------------------

@query(
    "row_number",
    """SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS row_number
       FROM orders""",
)
def q_row_number(spark, d):
    return win.rank_rows(Tables(spark, d).orders, "row_number", "o_custkey", ["o_orderdate", "o_orderkey"])


@query(
    "row_number_global",
    "SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS row_number FROM orders",
)
def q_row_number_global(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_totalprice")
    return win.rank_rows(o, "row_number", None, ["o_totalprice", "o_orderkey"])


@query("rank", "SELECT *, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS rank FROM lineitem")
def q_rank(spark, d):
    return win.rank_rows(Tables(spark, d).lineitem, "rank", "l_orderkey", "l_quantity")


@query(
    "rank_global",
    "SELECT o_orderkey, o_orderpriority, CAST(rank() OVER (ORDER BY o_orderpriority) AS BIGINT) AS rank FROM orders",
)
def q_rank_global(spark, d):
    return win.rank_rows(Tables(spark, d).orders.select("o_orderkey", "o_orderpriority"), "rank", None, "o_orderpriority")


@query("dense_rank", "SELECT *, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS dense_rank FROM customer")
def q_dense_rank(spark, d):
    return win.rank_rows(Tables(spark, d).customer, "dense_rank", "c_nationkey", "c_mktsegment")


@query(
    "dense_rank_global",
    "SELECT l_orderkey, l_linenumber, l_quantity, CAST(dense_rank() OVER (ORDER BY l_quantity) AS BIGINT) AS dense_rank FROM lineitem",
)
def q_dense_rank_global(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return win.rank_rows(li, "dense_rank", None, "l_quantity")


@query("ntile", "SELECT *, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS ntile FROM customer")
def q_ntile(spark, d):
    return win.rank_rows(Tables(spark, d).customer, "ntile", "c_nationkey", ["c_acctbal", "c_custkey"], ntile_buckets=4)


@query("ntile_global", "SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS ntile FROM customer")
def q_ntile_global(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_acctbal")
    return win.rank_rows(c, "ntile", None, ["c_acctbal", "c_custkey"], ntile_buckets=7).drop("c_acctbal")


@query("lead", "SELECT *, lead(turn, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS lead FROM conversations")
def q_lead(spark, d):
    return win.lead_lag(Tables(spark, d).conversations, "lead", "turn", 1, "conv_id", "turn")


@query("lag", "SELECT event_id, ts, user_id, lag(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag FROM events")
def q_lag(spark, d):
    e = Tables(spark, d).events.select("event_id", "ts", "user_id", "event_type")
    return win.lead_lag(e, "lag", "event_type", 2, "user_id", ["ts", "event_id"]).drop("event_type")


@query("lag_global", "SELECT event_id, ts, lag(value, 1) OVER (ORDER BY ts, event_id) AS lag FROM events")
def q_lag_global(spark, d):
    e = Tables(spark, d).events.select("event_id", "ts", "value")
    return win.lead_lag(e, "lag", "value", 1, None, ["ts", "event_id"]).drop("value")


@query(
    "first_value",
    """SELECT *, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_value FROM orders""",
)
def q_first_value(spark, d):
    return win.first_last_value(Tables(spark, d).orders, "first_value", "o_totalprice", "o_custkey", ["o_orderdate", "o_orderkey"])


@query(
    "last_value",
    """SELECT *, last_value(role) OVER (PARTITION BY conv_id ORDER BY turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value FROM conversations""",
)
def q_last_value(spark, d):
    return win.first_last_value(Tables(spark, d).conversations, "last_value", "role", "conv_id", "turn")


@query(
    "window_aggregate",
    """SELECT *, CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey), 2) AS DOUBLE) AS sum_o_totalprice
       FROM orders""",
)
def q_window_agg(spark, d):
    o = Tables(spark, d).orders
    dec = o.withColumn("__p", F.col("o_totalprice").cast("decimal(18,4)"))
    out = win.window_aggregate(dec, "sum", "__p", "o_custkey", "sum_o_totalprice")
    return out.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2).cast("double")).drop("__p")


@query(
    "cumulative",
    """SELECT *, CAST(SUM(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS BIGINT) AS turn_running_sum FROM conversations""",
)
def q_cumulative(spark, d):
    return win.cumulative(Tables(spark, d).conversations, "turn", "turn", "sum", "conv_id")


@query(
    "cumulative_global",
    """SELECT o_orderkey, CAST(SUM(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
           AS o_custkey_running_sum FROM orders""",
)
def q_cumulative_global(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey")
    return win.cumulative(o, "o_custkey", "o_orderkey", "sum").drop("o_custkey")


_EV_NULLS = "CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END"


def _events_with_gaps(spark, d):
    e = Tables(spark, d).events
    return e.select("event_id", "ts", "user_id", F.when(~F.col("event_type").isin("error", "signup"), F.col("value")).alias("value"))


@query(
    "fill_forward",
    f"""SELECT event_id, ts, user_id, last({_EV_NULLS} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""",
)
def q_ffill(spark, d):
    return win.fill_forward(_events_with_gaps(spark, d), "value", ["ts", "event_id"], "user_id")


@query(
    "fill_backward",
    f"""SELECT event_id, ts, user_id, first({_EV_NULLS} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM events""",
)
def q_bfill(spark, d):
    return win.fill_backward(_events_with_gaps(spark, d), "value", ["ts", "event_id"], "user_id")


@query(
    "fill_forward_global",
    f"""SELECT event_id, ts, user_id, last({_EV_NULLS} IGNORE NULLS) OVER (ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""",
)
def q_ffill_global(spark, d):
    return win.fill_forward(_events_with_gaps(spark, d), "value", ["ts", "event_id"])


@query(
    "fill_backward_global",
    f"""SELECT event_id, ts, user_id, first({_EV_NULLS} IGNORE NULLS) OVER (ORDER BY ts, event_id
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM events""",
)
def q_bfill_global(spark, d):
    return win.fill_backward(_events_with_gaps(spark, d), "value", ["ts", "event_id"])


def session_sql(key: str | None, gap: str, extra: str = "") -> str:
    """A session begins at a time with no event of the key in the gap before it;
    an event belongs to the last session begun by its time."""
    by, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    same = f"e.{key} = b.{key} AND " if key else ""
    return f"""
WITH moments AS (SELECT DISTINCT {by}ts FROM events),
begun AS (
  SELECT {by}ts, row_number() OVER ({part}ORDER BY ts) AS no
  FROM (FROM moments SELECT *, ts - lag(ts) OVER ({part}ORDER BY ts) AS pause)
  WHERE pause IS NULL OR pause > INTERVAL {gap})
SELECT e.event_id, e.ts, {f"e.{key}, " if key else ""}b.no AS session_id,
       row_number() OVER (PARTITION BY {f"e.{key}, " if key else ""}b.no ORDER BY e.ts) AS session_seq
FROM events e ASOF JOIN begun b ON {same}e.ts >= b.ts
"""


SESSIONIZE_SQL = session_sql("user_id", "30 MINUTE")


@query("sessionize", SESSIONIZE_SQL)
def q_sessionize(spark, d):
    e = Tables(spark, d).events.select("event_id", "ts", "user_id")
    return win.sessionize(e, "user_id", "ts", 30, "minutes")


@query(
    "zscore",
    """SELECT c_custkey, c_acctbal,
              ROUND((c_acctbal - AVG(c_acctbal) OVER ()) / NULLIF(STDDEV_SAMP(c_acctbal) OVER (), 0), 6) AS c_acctbal_zscore
       FROM customer""",
)
def q_zscore(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_acctbal")
    return win.zscore(c, "c_acctbal").withColumn("c_acctbal_zscore", F.round("c_acctbal_zscore", 6))


OUTLIER_IQR = """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, quantile_cont(l_extendedprice, 0.25) OVER () AS q1, quantile_cont(l_extendedprice, 0.75) OVER () AS q3 FROM lineitem)
WHERE {neg} COALESCE(l_extendedprice IS NULL OR l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1), TRUE)
"""


@query("outlier", OUTLIER_IQR.format(neg=""))
def q_outlier(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return win.outlier(li, "l_extendedprice", "iqr").passed


@query(
    "outlier_reject",
    """SELECT doc_id, n_chars FROM documents, (SELECT quantile_cont(n_chars, [0.25, 0.75]) AS q FROM documents)
       WHERE n_chars > q[2] + 1.5 * (q[2] - q[1]) OR n_chars < q[1] - 1.5 * (q[2] - q[1])""",
)
def q_outlier_reject(spark, d):
    return win.outlier(Tables(spark, d).documents.select("doc_id", "n_chars"), "n_chars", "iqr").rejected


@query(
    "outlier_zscore",
    """SELECT c_custkey, c_acctbal FROM (SELECT *, AVG(c_acctbal) OVER () AS mu, STDDEV_POP(c_acctbal) OVER () AS sd FROM customer)
       WHERE COALESCE(c_acctbal IS NULL OR sd = 0 OR abs((c_acctbal - mu) / sd) <= 1.5, TRUE)""",
)
def q_outlier_z(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_acctbal")
    return win.outlier(c, "c_acctbal", "zscore", 1.5).passed
