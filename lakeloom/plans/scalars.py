"""Queries for scalar functions (§2.8) and reshaping (§2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import datetimes as dtf
from lakeloom.functions import nested as nf
from lakeloom.functions import numeric as nu
from lakeloom.functions import strings as st
from lakeloom.operators import shape
from lakeloom.plans.registry import Tables, query

# ---------------------------------------------------------------- strings


@query("regex_replace", r"SELECT page_id, regexp_replace(url, '^https?://([^/]+).*$', '\1') AS site FROM pages")
def q_regex_replace(spark, d):
    p = Tables(spark, d).pages.select("page_id", "url")
    return st.regex_replace(p, "url", r"^https?://([^/]+).*$", r"\1", output="site").drop("url")


@query("regex_extract", """SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k FROM events""")
def q_regex_extract(spark, d):
    e = Tables(spark, d).events.select("event_id", "props")
    return st.regex_extract(e, "props", r'"k": ([0-9]+)', 1, output="k").drop("props")


@query("regex_match", "SELECT page_id, regexp_matches(url, '^https://[a-z]+\\.') AS secure FROM pages")
def q_regex_match(spark, d):
    p = Tables(spark, d).pages.select("page_id", "url")
    return st.regex_match(p, "url", r"^https://[a-z]+\.", output="secure").drop("url")


@query("trim", "SELECT conv_id, turn, trim(text) AS text FROM conversations")
def q_trim(spark, d):
    return st.trim(Tables(spark, d).conversations.select("conv_id", "turn", "text"), "text")


@query("case_change", "SELECT c_custkey, lower(c_mktsegment) AS seg, upper(c_name) AS c_name FROM customer")
def q_case(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment")
    c = st.case_change(c, "c_mktsegment", "lower", output="seg")
    return st.case_change(c, "c_name", "upper").drop("c_mktsegment")


# SQL engine has no initcap: title case spelled out (first letter of each
# space-separated word upper-cased, the rest lower-cased).
@query(
    "case_change_title",
    """SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '),
                                                  lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') AS p_name FROM part""",
)
def q_case_title(spark, d):
    return st.case_change(Tables(spark, d).part.select("p_partkey", "p_name"), "p_name", "title")


@query("length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS text_len FROM documents")
def q_length(spark, d):
    return st.length(Tables(spark, d).documents.select("doc_id", "text"), "text", output="text_len").drop("text")


@query("substring", "SELECT p_partkey, substring(p_name, 3, 5) AS p_name FROM part")
def q_substring(spark, d):
    return st.substring(Tables(spark, d).part.select("p_partkey", "p_name"), "p_name", 3, 5)


@query("concat_suffix", "SELECT c_custkey, concat(c_mktsegment, '_EU') AS c_mktsegment FROM customer")
def q_concat(spark, d):
    return st.concat_suffix(Tables(spark, d).customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "_EU")


@query("split", "SELECT p_partkey, CAST(to_json(string_split(p_name, ' ')) AS VARCHAR) AS words FROM part")
def q_split(spark, d):
    p = st.split(Tables(spark, d).part.select("p_partkey", "p_name"), "p_name", " ", output="words")
    return p.select("p_partkey", F.to_json("words").alias("words"))


@query("format_string", "SELECT c_custkey, printf('ID-%06d (100%%!)', c_custkey) AS label FROM customer")
def q_format(spark, d):
    c = Tables(spark, d).customer.select("c_custkey")
    return st.format_string(c, "c_custkey", "ID-%06d (100%!)", output="label")


@query("text_replace", "SELECT p_partkey, replace(p_name, 'widget', 'gadget') AS p_name FROM part")
def q_text_replace(spark, d):
    return st.text_replace(Tables(spark, d).part.select("p_partkey", "p_name"), "p_name", "widget", "gadget")


@query("slug", "SELECT page_id, url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS url_slug FROM pages")
def q_slug(spark, d):
    return st.slug(Tables(spark, d).pages.select("page_id", "url"), "url")


@query("strip_html", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS html FROM pages")
def q_strip_html(spark, d):
    return st.strip_html(Tables(spark, d).pages.select("page_id", "html"), "html")


@query("text_reverse", "SELECT c_custkey, c_name, reverse(c_name) AS c_name_reversed FROM customer")
def q_reverse(spark, d):
    return st.text_reverse(Tables(spark, d).customer.select("c_custkey", "c_name"), "c_name")


@query("text_repeat", "SELECT c_custkey, c_mktsegment, repeat(c_mktsegment, 3) AS c_mktsegment_repeated FROM customer")
def q_repeat(spark, d):
    return st.text_repeat(Tables(spark, d).customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", 3)


@query(
    "text_match",
    """SELECT p_partkey, p_name, contains(p_name, 'ring') AS p_name_contains, starts_with(p_name, 'red') AS p_name_starts_with,
              ends_with(p_name, 'bolt') AS p_name_ends_with FROM part""",
)
def q_text_match(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_name")
    p = st.text_match(p, "p_name", "ring", "contains")
    p = st.text_match(p, "p_name", "red", "starts_with")
    return st.text_match(p, "p_name", "bolt", "ends_with")


@query("pad", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, rpad(c_mktsegment, 5, '.') AS seg FROM customer")
def q_pad(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_mktsegment")
    c = st.pad(c, "c_custkey", 8, "0", "left", output="padded")
    return st.pad(c, "c_mktsegment", 5, ".", "right", output="seg").drop("c_mktsegment")


@query(
    "base64_codec",
    """SELECT doc_id, to_base64(encode(text)) AS text_encode, decode(from_base64(to_base64(encode(text)))) = text AS roundtrip
       FROM documents""",
)
def q_base64(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    enc = st.base64_codec(docs, "text", "encode")
    dec = st.base64_codec(enc, "text_encode", "decode", output="back")
    return dec.select("doc_id", "text_encode", (F.col("back") == F.col("text")).alias("roundtrip"))


@query("hash_column", "SELECT c_custkey, md5(c_name) AS c_name_hash, sha256(c_mktsegment) AS seg_hash FROM customer")
def q_hash(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment")
    c = st.hash_column(c, "c_name", "md5")
    return st.hash_column(c, "c_mktsegment", "sha256", output="seg_hash").drop("c_name", "c_mktsegment")


@query(
    "text_similarity",
    """SELECT p_partkey, CAST(levenshtein(p_name, lower(p_type)) AS BIGINT) AS lev,
              ROUND(jaccard(p_name, lower(p_type)), 9) AS jac,
              ROUND(jaro_winkler_similarity(p_name, lower(p_type)), 9) AS jw,
              CAST(damerau_levenshtein(p_name, lower(p_type)) AS BIGINT) AS dam
       FROM part""",
)
def q_text_similarity(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_name", F.lower("p_type").alias("t"))
    p = st.text_similarity(p, "p_name", "t", "levenshtein", "lev")
    p = st.text_similarity(p, "p_name", "t", "jaccard", "jac")
    p = st.text_similarity(p, "p_name", "t", "jaro_winkler", "jw")
    p = st.text_similarity(p, "p_name", "t", "damerau_levenshtein", "dam")
    return p.select("p_partkey", "lev", F.round("jac", 9).alias("jac"), F.round("jw", 9).alias("jw"), "dam")


_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*)://)?([^:/?#]*)(?::([0-9]+))?(/[^?#]*)?(?:\?([^#]*))?(?:#(.*))?$"


@query(
    "url_parse",
    f"""SELECT page_id, regexp_extract(url, '{_URL}', 1) AS url_scheme, regexp_extract(url, '{_URL}', 2) AS url_host,
              regexp_extract(url, '{_URL}', 4) AS url_path, regexp_extract(url, '{_URL}', 5) AS url_query,
              regexp_extract(url, '{_URL}', 6) AS url_fragment FROM pages""",
)
def q_url_parse(spark, d):
    p = Tables(spark, d).pages.select("page_id", "url")
    for k in ("scheme", "host", "path", "query", "fragment"):
        p = st.url_parse(p, "url", k)
    return p.drop("url")


def _ips(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_nationkey")
    return c.select("c_custkey", F.format_string("10.%d.%d.%d/%d", F.col("c_nationkey"), F.pmod("c_custkey", F.lit(256)),
                                                  F.pmod(F.col("c_custkey") * 7, F.lit(256)), 8 + F.pmod("c_custkey", F.lit(23))).alias("addr"))


def _dotted(x: str) -> str:
    return " || '.' || ".join(f"CAST(({x} >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0))


_IP_SQL = f"""
WITH a AS (SELECT c_custkey, printf('10.%d.%d.%d/%d', c_nationkey, c_custkey % 256, (c_custkey * 7) % 256, 8 + c_custkey % 23) AS addr
           FROM customer),
p AS (SELECT c_custkey, addr, split_part(addr, '/', 1) AS host, CAST(split_part(addr, '/', 2) AS INTEGER) AS len FROM a),
n AS (SELECT *, CAST(split_part(host, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(host, '.', 2) AS BIGINT) * 65536
                + CAST(split_part(host, '.', 3) AS BIGINT) * 256 + CAST(split_part(host, '.', 4) AS BIGINT) AS ip,
                4294967296 - CAST(pow(2, 32 - len) AS BIGINT) AS mask FROM p)
SELECT c_custkey, addr, host AS addr_host, 4 AS addr_family, len AS addr_masklen, {_dotted('mask')} AS addr_netmask,
       {_dotted('(ip & mask)')} || '/' || CAST(len AS VARCHAR) AS addr_network,
       {_dotted('(ip | (4294967295 - mask))')} || '/' || CAST(len AS VARCHAR) AS addr_broadcast
FROM n
"""


@query("ip_parse", _IP_SQL)
def q_ip_parse(spark, d):
    ips = _ips(spark, d)
    for k in ("host", "family", "masklen", "netmask", "network", "broadcast"):
        ips = st.ip_parse(ips, "addr", k)
    return ips


_PII = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(COALESCE(text, ''),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED-EMAIL]', 'g'),
  '\b(?:\d[ -]*?){13,19}\b', '[REDACTED-CREDIT-CARD]', 'g'),
  '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED-SSN]', 'g'),
  '(?:\+?\d{1,3}[ -])?(?:\(\d{3}\)[ -]?|\d{3}[ -])\d{3}[ -]\d{4}\b', '[REDACTED-PHONE]', 'g')"""


@query("pii_redact", f"SELECT doc_id, {_PII} AS redacted FROM documents")
def q_pii(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    return st.pii_redact(docs, "text", "redacted").drop("text")


@query("prompt_render", "SELECT conv_id, turn, concat('[', role, '] ', text, ' {unclosed') AS prompt FROM conversations")
def q_prompt(spark, d):
    c = Tables(spark, d).conversations.select("conv_id", "turn", "role", "text")
    return st.prompt_render(c, "[{role}] {text} {unclosed", "prompt").select("conv_id", "turn", "prompt")


@query(
    "label_normalize",
    """SELECT conv_id, turn, CASE lower(trim(role)) WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                                  ELSE 'UNKNOWN' END AS role FROM conversations""",
)
def q_label_norm(spark, d):
    c = Tables(spark, d).conversations.select("conv_id", "turn", "role")
    return st.label_normalize(c, "role", "User, Assistant")


# -------------------------------------------------------------- date/time


@query(
    "dt_parse",
    "SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS parsed FROM orders",
)
def q_dt_parse(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("txt"))
    return dtf.dt_parse(o, "txt", "%d/%m/%Y", output="parsed").drop("txt")


@query("dt_format", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM events")
def q_dt_format(spark, d):
    return dtf.dt_format(Tables(spark, d).events.select("event_id", "ts"), "ts", "%Y-%m-%d %H:%M")


@query(
    "dt_extract",
    """SELECT event_id, CAST(date_part('dow', ts) AS BIGINT) AS dow, CAST(date_part('hour', ts) AS BIGINT) AS hour,
              CAST(date_part('month', ts) AS BIGINT) AS month, CAST(date_part('doy', ts) AS BIGINT) AS doy FROM events""",
)
def q_dt_extract(spark, d):
    e = Tables(spark, d).events.select("event_id", "ts")
    for u in ("dow", "hour", "month", "doy"):
        e = dtf.dt_extract(e, "ts", u, output=u)
    return e.drop("ts")


@query(
    "dt_trunc",
    "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week FROM events",
)
def q_dt_trunc(spark, d):
    e = Tables(spark, d).events.select("event_id", "ts")
    e = dtf.dt_trunc(e, "ts", "hour", output="hour")
    return dtf.dt_trunc(e, "ts", "week", output="week").drop("ts")


@query("dt_tz", "SELECT event_id, ts, timezone('UTC', ts AT TIME ZONE 'America/New_York') AS ts_utc FROM events")
def q_dt_tz(spark, d):
    return dtf.dt_tz(Tables(spark, d).events.select("event_id", "ts"), "ts", "America/New_York", output="ts_utc")


@query(
    "dt_add",
    """SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS next_month, o_orderdate - INTERVAL 3 DAY AS minus3,
              o_orderdate + INTERVAL 2 HOUR AS plus2h FROM orders""",
)
def q_dt_add(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderdate")
    o = dtf.dt_add(o, "o_orderdate", 1, "month", output="next_month")
    o = dtf.dt_add(o, "o_orderdate", -3, "day", output="minus3")
    return dtf.dt_add(o, "o_orderdate", 2, "hours", output="plus2h").drop("o_orderdate")


@query(
    "dt_diff",
    """SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) AS days,
              date_diff('month', o_orderdate, l_shipdate) AS months, date_diff('year', o_orderdate, l_shipdate) AS years
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def q_dt_diff(spark, d):
    t = Tables(spark, d)
    j = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    j = dtf.dt_diff(j, "o_orderdate", "l_shipdate", "day", "days")
    j = dtf.dt_diff(j, "o_orderdate", "l_shipdate", "month", "months")
    return dtf.dt_diff(j, "o_orderdate", "l_shipdate", "year", "years").drop("o_orderdate", "l_shipdate")


@query("dt_now")
def q_dt_now(spark, d):
    return dtf.dt_now(Tables(spark, d).orders.select("o_orderkey"))


@query(
    "dt_epoch",
    """SELECT event_id, epoch_us(ts) / 1000000.0 AS ts_epoch,
              make_timestamp(CAST(round(epoch_us(ts) / 1000000.0 * 1000000) AS BIGINT)) AS back FROM events""",
)
def q_dt_epoch(spark, d):
    e = dtf.dt_epoch(Tables(spark, d).events.select("event_id", "ts"), "ts", "to")
    return dtf.dt_epoch(e, "ts_epoch", "from", output="back").drop("ts")


@query("time_bin", "SELECT event_id, time_bucket(INTERVAL '5 minutes', ts) AS ts_bin FROM events")
def q_time_bin(spark, d):
    return dtf.time_bin(Tables(spark, d).events.select("event_id", "ts"), "ts", "minute", 5).drop("ts")


# ---------------------------------------------------------------- numeric


@query(
    "num_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 4, 1) AS q_round, abs(l_discount - 0.05) AS d_abs,
              ROUND(sqrt(l_extendedprice), 6) AS p_sqrt, ROUND(power(l_tax, 2), 12) AS t_pow,
              l_linenumber % 3 AS ln_mod, ROUND(ln(l_extendedprice), 9) AS p_ln, ROUND(log(10, l_extendedprice), 9) AS p_log10
       FROM lineitem""",
)
def q_num(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount",
                                          "l_extendedprice", "l_tax")
    li = li.withColumn("q", F.col("l_quantity") / 4).withColumn("dd", F.col("l_discount") - 0.05)
    li = nu.num_round(li, "q", 1, output="q_round")
    li = nu.num_abs(li, "dd", output="d_abs")
    li = nu.num_sqrt(li, "l_extendedprice", output="p_sqrt")
    li = nu.num_power(li, "l_tax", 2, output="t_pow")
    li = nu.num_mod(li, "l_linenumber", 3, output="ln_mod")
    li = nu.num_log(li, "l_extendedprice", output="p_ln")
    li = nu.num_log(li, "l_extendedprice", 10, output="p_log10")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "q_round", "d_abs", F.round("p_sqrt", 6).alias("p_sqrt"),
                     F.round("t_pow", 12).alias("t_pow"), "ln_mod", F.round("p_ln", 9).alias("p_ln"),
                     F.round("p_log10", 9).alias("p_log10"))


@query(
    "num_clamp",
    "SELECT c_custkey, least(greatest(CAST(c_acctbal AS DOUBLE), 0.0), 5000.0) AS c_acctbal, CAST(sign(c_acctbal) AS INTEGER) AS c_acctbal_sign FROM customer",
)
def q_clamp(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_acctbal")
    c = nu.num_sign(c, "c_acctbal")
    return nu.num_clamp(c, "c_acctbal", 0, 5000)


@query(
    "bucketize",
    """SELECT p_partkey, p_retailprice,
              CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2000 THEN 11
                   ELSE CAST(floor((p_retailprice - 900) / 110.0) AS INTEGER) + 1 END AS p_retailprice_bucket,
              CASE WHEN p_size IS NULL THEN NULL WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium'
                   ELSE 'large' END AS size_class,
              CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 30 THEN '10-30' ELSE '>=30' END AS size_auto
       FROM part""",
)
def q_bucketize(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_retailprice", "p_size")
    p = nu.bucketize(p, "p_retailprice", low=900, high=2000, buckets=10)
    p = nu.bucketize(p, "p_size", bounds=[10, 30], labels=["small", "medium", "large"], output="size_class")
    return nu.bucketize(p, "p_size", bounds="10,30", output="size_auto").drop("p_size")


# ------------------------------------------------------------ json/arrays


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS k_raw FROM events")
def q_json_path(spark, d):
    e = Tables(spark, d).events.select("event_id", "props")
    e = nf.json_path(e, "props", "$.k", output="k")
    return nf.json_path(e, "props", "k", output="k_raw", keep_quotes=True).drop("props")


@query("json_parse", "SELECT event_id, props, CAST(json(props) AS VARCHAR) AS text FROM events")
def q_json_parse(spark, d):
    e = nf.json_parse(Tables(spark, d).events.select("event_id", "props"), "props", output="v")
    return nf.json_stringify(e, "v", output="text").drop("v")


@query(
    "json_flatten",
    "SELECT c_custkey, c_name, c_nationkey AS nation, c_mktsegment AS segment FROM customer",
)
def q_json_flatten(spark, d):
    c = Tables(spark, d).customer.select(
        "c_custkey", "c_name", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("info"))
    return nf.json_flatten(c, "info")


@query(
    "json_merge",
    """SELECT event_id, CAST(json_merge_patch(props, '{"type": "' || event_type || '", "k": null}') AS VARCHAR) AS merged FROM events""",
)
def q_json_merge(spark, d):
    e = Tables(spark, d).events.select("event_id", "props", F.concat(F.lit('{"type": "'), "event_type", F.lit('", "k": null}')).alias("patch"))
    return nf.json_merge(e, "props", "patch").select("event_id", "merged")


@query("explode", "SELECT unnest(string_split(p_name, ' ')) AS w, p_partkey FROM part")
def q_explode(spark, d):
    p = Tables(spark, d).part.select("p_partkey", F.split("p_name", " ").alias("w"))
    return nf.explode(p, "w")


@query(
    "array_functions",
    """SELECT p_partkey, string_split(p_name, ' ')[2] AS second, string_split(p_name, ' ')[-1] AS last,
              string_split(p_name, ' ')[5] AS fifth,
              CAST(len(list_distinct(string_split(p_name || ' ' || p_name, ' '))) AS BIGINT) AS n_distinct,
              COALESCE(list_contains(string_split(p_name, ' '), 'bolt'), FALSE) AS words_contains,
              CAST(len(string_split(p_name, ' ')) AS BIGINT) AS words_length FROM part""",
)
def q_arrays(spark, d):
    p = Tables(spark, d).part.select("p_partkey", F.split("p_name", " ").alias("words"),
                                     F.split(F.concat_ws(" ", "p_name", "p_name"), " ").alias("dup"))
    p = nf.arr_element(p, "words", 2, output="second")
    p = nf.arr_element(p, "words", -1, output="last")
    p = nf.arr_element(p, "words", 5, output="fifth")
    p = nf.arr_distinct(p, "dup", output="d")
    p = nf.arr_contains(p, "words", "bolt")
    p = nf.arr_length(p, "words")
    return p.select("p_partkey", "second", "last", "fifth", F.size("d").cast("bigint").alias("n_distinct"),
                    "words_contains", "words_length")


# ------------------------------------------------------------------ shape


@query(
    "pivot",
    """SELECT o_orderpriority, COUNT(*) FILTER (o_orderstatus = 'F') AS "F", COUNT(*) FILTER (o_orderstatus = 'O') AS "O",
              COUNT(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""",
)
def q_pivot(spark, d):
    o = Tables(spark, d).orders.select("o_orderpriority", "o_orderstatus", "o_orderkey")
    return shape.pivot(o, "o_orderstatus", "o_orderkey", "count", "o_orderpriority")


@query(
    "unpivot",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders)
       SELECT * FROM o UNPIVOT INCLUDE NULLS (value FOR name IN (o_orderstatus, o_orderpriority))""",
)
def q_unpivot(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return shape.unpivot(o, ["o_orderstatus", "o_orderpriority"])


@query("normalize", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part")
def q_normalize(spark, d):
    return shape.normalize(Tables(spark, d).part.select("p_partkey", "p_name"), "p_name", " ")


_TRANSPOSE_SQL = """
WITH s AS (SELECT l_returnflag, COUNT(*) AS lines, CAST(SUM(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY l_returnflag),
r AS (SELECT *, row_number() OVER (ORDER BY l_returnflag) AS rn FROM s)
SELECT 'l_returnflag' AS column_name, {a} FROM r
UNION ALL SELECT 'lines', {b} FROM r
UNION ALL SELECT 'qty', {c} FROM r
""".format(
    a=", ".join(f"max(CASE WHEN rn = {i} THEN l_returnflag END) AS r{i}" for i in range(1, 4)),
    b=", ".join(f"max(CASE WHEN rn = {i} THEN CAST(lines AS VARCHAR) END) AS r{i}" for i in range(1, 4)),
    c=", ".join(f"max(CASE WHEN rn = {i} THEN CAST(qty AS VARCHAR) END) AS r{i}" for i in range(1, 4)),
)


@query("transpose", _TRANSPOSE_SQL)
def q_transpose(spark, d):
    # rows become columns, so the input is a per-flag summary of lineitem
    li = Tables(spark, d).lineitem
    stats = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("bigint").alias("qty"))
    return shape.transpose(stats, "l_returnflag")
