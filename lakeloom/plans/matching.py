"""Queries for fuzzy matching, graph clustering, search, vectors, text
chunking and geometry (§2.6 spatial join, §2.10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import stemming
from lakeloom.operators import geo, graph, search, similarity, text
from lakeloom.plans.registry import Tables, query

# ------------------------------------------------------------ fuzzy matching

_T = 0.9


#: The row that comes later by (key, id) is the one that is matched.
_LATER = "(lower(x.p_name), x.p_partkey) < (lower(y.p_name), y.p_partkey)"


@query(
    "record_match",
    f"""SELECT x.p_partkey, x.p_name, lower(y.p_name) AS matched_key,
               round(jaro_winkler_similarity(lower(x.p_name), lower(y.p_name)), 4) AS match_score
        FROM part x JOIN part y ON {_LATER} WHERE jaro_winkler_similarity(lower(x.p_name), lower(y.p_name)) >= {_T}""",
)
def q_record_match(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_name")
    return similarity.record_match(p, "p_name", "jaro-winkler", _T)


@query(
    "record_match_levenshtein",
    f"""SELECT x.p_partkey, x.p_name, lower(y.p_name) AS matched_key, round(score, 4) AS match_score
        FROM part x JOIN part y ON {_LATER},
             LATERAL (SELECT 1.0 - levenshtein(lower(x.p_name), lower(y.p_name))::DOUBLE / GREATEST(length(x.p_name), length(y.p_name), 1) AS score)
        WHERE score >= 0.75""",
)
def q_record_match_lev(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_name")
    return similarity.record_match(p, "p_name", "levenshtein", 0.75)


@query(
    "record_link",
    """SELECT small.p_name AS left_key, named.p_name || ' ' || named.p_brand AS right_key, round(score, 4) AS score
       FROM part small, part named,
            LATERAL (SELECT jaro_winkler_similarity(lower(small.p_name), lower(named.p_name || ' ' || named.p_brand)) AS score)
       WHERE small.p_size > 25 AND named.p_size <= 25 AND score >= 0.85""",
)
def q_record_link(spark, d):
    p = Tables(spark, d).part
    return similarity.record_link(p.where("p_size > 25"), p.where("p_size <= 25"), "p_name", ["p_name", "p_brand"],
                                  "jaro-winkler", 0.85)


@query(
    "fuzzy_dedupe",
    f"""SELECT y.p_partkey, y.p_name
        FROM part y LEFT JOIN part x ON {_LATER} AND jaro_winkler_similarity(lower(x.p_name), lower(y.p_name)) >= {_T}
        GROUP BY y.p_partkey, y.p_name HAVING COUNT(x.p_partkey) = 0""",
)
def q_fuzzy_dedupe(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_name")
    return similarity.fuzzy_dedupe(p, "p_name", "jaro-winkler", _T)


# ---------------------------------------------------------------- clusters

def _order_chain(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.lag("o_orderkey").over(w).alias("id_a"), F.col("o_orderkey").alias("id_b"))


# The edges chain each customer's orders, so a customer with two orders or more is a component.
@query(
    "match_groups",
    """SELECT o_orderkey::VARCHAR AS id, MIN(o_orderkey::VARCHAR) OVER (PARTITION BY o_custkey) AS cluster_id
       FROM orders QUALIFY COUNT(*) OVER (PARTITION BY o_custkey) > 1""",
)
def q_match_groups(spark, d):
    return graph.match_groups(_order_chain(spark, d), "id_a", "id_b")


# ------------------------------------------------------------------ search

# The oracle stems in SQL: vowels are marked 1 and consonants 0 in a second string, on
# which the published conditions (measure, vowel in the rest, doubled and short ends) are
# patterns. A step is one CASE over its suffixes, longest first.

def _stem_sql(words: str) -> str:
    """A query of (word, stem) for the distinct words of the relation ``words(word)``."""
    shape = "regexp_replace(regexp_replace(replace(translate(regexp_replace({0}, '^y', 'b'), 'aeiou', '11111'), '1yy', '101'), '([^1y])y', '\\11', 'g'), '[^1]', '0', 'g')"

    def rest(w, suffix):
        return f"left({w}, length({w}) - {len(suffix)})"

    def measure(w):
        return f"len(regexp_extract_all({shape.format(w)}, '10'))"

    def swap(w, table, least):
        cases = " ".join(f"WHEN {w} LIKE '%{a}' THEN CASE WHEN {measure(rest(w, a))} > {least} THEN {rest(w, a)} || '{b}' ELSE {w} END"
                         for a, b in sorted(table, key=lambda r: -len(r[0])))
        return f"CASE {cases} ELSE {w} END"

    def short(w):
        return f"({shape.format(w)} LIKE '%010' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"

    def doubled(w):
        return f"(length({w}) > 1 AND right({w}, 1) = left(right({w}, 2), 1) AND {shape.format(w)} LIKE '%0')"

    ions = [(x, "") for x in stemming.STEP_4 if x != "ion"] + [("sion", "s"), ("tion", "t")]
    steps = [
        "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%ss' THEN w"
        " WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {measure(rest('w', 'eed'))} > 0 THEN left(w, length(w) - 1) ELSE w END"
        f" WHEN w LIKE '%ed' AND {shape.format(rest('w', 'ed'))} LIKE '%1%' THEN {rest('w', 'ed')} || '#'"
        f" WHEN w LIKE '%ing' AND {shape.format(rest('w', 'ing'))} LIKE '%1%' THEN {rest('w', 'ing')} || '#' ELSE w END",
        "CASE WHEN w NOT LIKE '%#' THEN w WHEN regexp_matches(w, '(at|bl|iz)#$') THEN replace(w, '#', 'e')"
        f" WHEN {doubled(rest('w', '#'))} AND left(right(w, 2), 1) NOT IN ('l', 's', 'z') THEN left(w, length(w) - 2)"
        f" WHEN {measure(rest('w', '#'))} = 1 AND {short(rest('w', '#'))} THEN replace(w, '#', 'e') ELSE replace(w, '#', '') END",
        f"CASE WHEN w LIKE '%y' AND {shape.format(rest('w', 'y'))} LIKE '%1%' THEN {rest('w', 'y')} || 'i' ELSE w END",
        swap("w", stemming.STEP_2, 0),
        swap("w", stemming.STEP_3, 0),
        "CASE " + " ".join(
            f"WHEN w LIKE '%{a}' THEN CASE WHEN {measure(rest('w', a[-3:] if a.endswith('ion') else a))} > 1"
            f" THEN {rest('w', a)} || '{b}' ELSE w END" for a, b in sorted(ions, key=lambda r: -len(r[0].removeprefix(r[1]))))
        + " ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({measure(rest('w', 'e'))} > 1 OR ({measure(rest('w', 'e'))} = 1 AND NOT {short(rest('w', 'e'))}))"
        f" THEN {rest('w', 'e')} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {measure(rest('w', 'l'))} > 1 THEN left(w, length(w) - 1) ELSE w END",
    ]
    inner = f"SELECT word, word AS w FROM (SELECT DISTINCT word FROM {words})"
    for step in steps:
        inner = f"SELECT word, CASE WHEN length(word) < 3 THEN w ELSE {step} END AS w FROM ({inner})"
    return f"SELECT word, w AS stem FROM ({inner})"


def _bm25_sql(table: str, id_col: str, text_col: str, q: str) -> str:
    asked = ", ".join(f"('{t}')" for t in q.lower().split())
    stop = ", ".join(f"'{w}'" for w in stemming.STOP_WORDS)
    return f"""
WITH t AS (SELECT id, unnest(toks) AS word FROM (
       SELECT {id_col} AS id, list_filter(regexp_split_to_array(strip_accents(lower({text_col})), '[^a-z]+'), lambda x: x <> '') AS toks FROM {table})),
kept AS (SELECT * FROM t WHERE word NOT IN ({stop})),
asked(word) AS (VALUES {asked}),
stems AS MATERIALIZED ({_stem_sql("(SELECT word FROM kept UNION ALL SELECT word FROM asked)")}),
len AS (SELECT {table}.{id_col} AS id, COUNT(kept.word) AS n FROM {table} LEFT JOIN kept ON kept.id = {table}.{id_col} GROUP BY ALL),
c AS (SELECT COUNT(*) AS n, AVG(n) AS mean FROM len),
tf AS (SELECT id, stem, COUNT(*) AS tf FROM kept JOIN stems USING (word)
       WHERE stem IN (SELECT stem FROM asked JOIN stems USING (word)) GROUP BY id, stem),
df AS (SELECT stem, COUNT(*) AS df FROM tf GROUP BY stem)
SELECT tf.id AS {id_col}, round(SUM(log10((c.n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len.n / mean)))), 6) AS score
FROM tf JOIN df USING (stem) JOIN len ON len.id = tf.id CROSS JOIN c GROUP BY tf.id"""


@query("text_search", _bm25_sql("documents", "doc_id", "text", "the stone with inning"))
def q_text_search(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    out = search.text_search(docs, "doc_id", "text", "the stone with inning")
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "text_search_topk",
    _bm25_sql("documents", "doc_id", "text", "ouen thorreou ndernt") + " ORDER BY score DESC, doc_id LIMIT 10",
)
def q_text_search_topk(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    out = search.text_search(docs, "doc_id", "text", "ouen thorreou ndernt", top_k=10)
    return out.select("doc_id", F.round("score", 6).alias("score"))


#: Part names and types are English words: ring, bolt, ECONOMY.
@query("text_search_stems", _bm25_sql("part", "p_partkey", "p_name || ' ' || p_type", "rings bolting of economies"))
def q_text_search_stems(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_name", "p_type")
    out = search.text_search(p, "p_partkey", ["p_name", "p_type"], "rings bolting of economies")
    return out.select("p_partkey", F.round("score", 6).alias("score"))


def _target(spark, d):
    # The query vector is the first embedding of the table (64 floats).
    row = Tables(spark, d).embeddings.orderBy("vec_id").select("embedding").limit(1).collect()
    return [float(x) for x in row[0][0]]


_TARGET_SQL = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(
    "vector_search",
    f"""SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_TARGET_SQL}), 6) AS similarity_score
        FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_TARGET_SQL}) DESC LIMIT 10""",
)
def q_vector_search(spark, d):
    e = Tables(spark, d).embeddings
    out = search.vector_search(e, "embedding", _target(spark, d), 64, "cosine", top_k=10)
    return out.select("vec_id", "label", F.round("similarity_score", 6).alias("similarity_score"))


@query(
    "vector_search_l2",
    f"""SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_TARGET_SQL}), 6) AS similarity_score,
               round(list_inner_product(embedding::DOUBLE[], {_TARGET_SQL}), 6) AS ip FROM embeddings""",
)
def q_vector_l2(spark, d):
    e = Tables(spark, d).embeddings
    tgt = _target(spark, d)
    out = search.vector_search(e, "embedding", tgt, 64, "l2")
    out = search.vector_search(out, "embedding", tgt, 64, "inner_product", output="ip")
    return out.select("vec_id", F.round("similarity_score", 6).alias("similarity_score"), F.round("ip", 6).alias("ip"))


# The oracle walks the rows in id order with a recursive CTE, carrying the
# list of kept ids: the literal greedy definition.
_SEM_DEDUPE_SQL = """
WITH RECURSIVE o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings),
p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b
        ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4),
nb AS (SELECT j, list(i) AS earlier FROM p GROUP BY j),
walk(rn, kept) AS (
  SELECT 0, []::BIGINT[]
  UNION ALL
  SELECT w.rn + 1,
         CASE WHEN len(list_intersect(w.kept, COALESCE(nb.earlier, []::BIGINT[]))) > 0 THEN w.kept
              ELSE list_append(w.kept, o.vec_id) END
  FROM walk w JOIN o ON o.rn = w.rn + 1 LEFT JOIN nb ON nb.j = o.vec_id)
SELECT vec_id, label FROM embeddings WHERE list_contains((SELECT kept FROM walk ORDER BY rn DESC LIMIT 1), vec_id)
"""


@query("semantic_dedupe", _SEM_DEDUPE_SQL)
def q_semantic_dedupe(spark, d):
    # 0.4: the test embeddings have no pair above 0.6, so a lower threshold
    # is what exercises the greedy rounds.
    return search.semantic_dedupe(Tables(spark, d).embeddings, "vec_id", "embedding", 0.4).select("vec_id", "label")


# -------------------------------------------------------------------- text

_CHUNK_SQL = """
WITH d AS (SELECT doc_id, text, CASE WHEN length(text) <= 200 THEN 0 ELSE CAST(ceil((length(text) - 200) / 180.0) AS BIGINT) END AS last
           FROM documents)
SELECT doc_id, substring(text, CAST(k * 180 + 1 AS BIGINT), 200) AS chunk, CAST(k AS BIGINT) AS chunk_index,
       CAST(last + 1 AS BIGINT) AS chunk_count
FROM d, generate_series(0, d.last) AS g(k)
"""


@query("chunk_text", _CHUNK_SQL)
def q_chunk(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    return text.chunk_text(docs, "text", 200, 20, "explode").drop("text")


# --------------------------------------------------------------------- geo

def _points(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_nationkey")
    return c.select("c_custkey", F.format_string("POINT(%d %d)", F.pmod("c_custkey", F.lit(97)), F.col("c_nationkey")).alias("geom"))


_PT_SQL = "(SELECT c_custkey, c_custkey % 97 AS x, c_nationkey AS y FROM customer)"


@query("geo_distance", f"SELECT c_custkey, round(sqrt(power(x - 50, 2) + power(y - 12, 2)), 9) AS distance FROM {_PT_SQL}")
def q_geo_distance(spark, d):
    out = geo.geo_distance(_points(spark, d), "geom", "POINT(50 12)")
    return out.select("c_custkey", F.round("distance", 9).alias("distance"))


@query("geo_within_distance", f"SELECT c_custkey, sqrt(power(x - 50, 2) + power(y - 12, 2)) <= 20 AS within FROM {_PT_SQL}")
def q_geo_within(spark, d):
    return geo.geo_within_distance(_points(spark, d), "geom", "POINT(50 12)", 20).select("c_custkey", "within")


@query(
    "geo_intersects",
    f"SELECT c_custkey, (x BETWEEN 10.5 AND 60.5) AND (y BETWEEN 0.5 AND 12.5) AS intersects FROM {_PT_SQL}",
)
def q_geo_intersects(spark, d):
    out = geo.geo_intersects(_points(spark, d), "geom", "POLYGON((10.5 0.5, 60.5 0.5, 60.5 12.5, 10.5 12.5, 10.5 0.5))")
    return out.select("c_custkey", "intersects")


def _regions(spark, d):
    r = Tables(spark, d).region
    x0 = F.col("r_regionkey") * 20
    return r.select("r_regionkey", "r_name", F.format_string(
        "POLYGON((%d.5 0.5, %d.5 0.5, %d.5 24.5, %d.5 24.5, %d.5 0.5))", x0, x0 + 15, x0 + 15, x0, x0).alias("area"))


@query(
    "join_spatial",
    f"""SELECT p.c_custkey, 'POINT(' || p.x || ' ' || p.y || ')' AS geom, r.r_regionkey, r.r_name,
               printf('POLYGON((%d.5 0.5, %d.5 0.5, %d.5 24.5, %d.5 24.5, %d.5 0.5))', r.r_regionkey * 20, r.r_regionkey * 20 + 15,
                      r.r_regionkey * 20 + 15, r.r_regionkey * 20, r.r_regionkey * 20) AS area
        FROM {_PT_SQL} p JOIN region r ON p.x BETWEEN r.r_regionkey * 20 + 0.5 AND r.r_regionkey * 20 + 15.5
                                      AND p.y BETWEEN 0.5 AND 24.5""",
)
def q_join_spatial(spark, d):
    return geo.join_spatial(_points(spark, d), _regions(spark, d), "geom", "area", "within")


# A level line per customer from (x, y) to (x + 3, y); a region is the strip of x between
# 20 r + 0.5 and 20 r + 15.5 for y between 0.5 and 24.5, so the line meets it if both
# ranges overlap. Lines of odd keys are drawn as thin rectangles.
_LINE_SQL = f"""SELECT p.c_custkey, r.r_regionkey FROM {_PT_SQL} p JOIN region r
  ON p.x <= r.r_regionkey * 20 + 15.5 AND p.x + 3 >= r.r_regionkey * 20 + 0.5 AND p.y + (p.c_custkey % 2) * 0.25 >= 0.5 AND p.y <= 24.5"""


def _lines(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", F.pmod("c_custkey", F.lit(97)).alias("x"), F.col("c_nationkey").alias("y"))
    line = F.format_string("LINESTRING(%d %d, %d %d)", "x", "y", F.col("x") + 3, "y")
    box = F.format_string("POLYGON((%d %d, %d %d, %d %d.25, %d %d.25, %d %d))", "x", "y", F.col("x") + 3, "y", F.col("x") + 3, "y", "x", "y", "x", "y")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, line).otherwise(box).alias("geom"))


@query("join_spatial_shapes", _LINE_SQL)
def q_join_spatial_shapes(spark, d):
    """Lines and polygons on the left."""
    out = geo.join_spatial(_lines(spark, d), _regions(spark, d), "geom", "area", "intersects")
    return out.select("c_custkey", "r_regionkey")


@query(
    "geo_intersects_shapes",
    f"SELECT c_custkey, x <= 60.5 AND x + 3 >= 10.5 AND y + (c_custkey % 2) * 0.25 >= 0.5 AND y <= 12.5 AS intersects FROM {_PT_SQL}",
)
def q_geo_intersects_shapes(spark, d):
    out = geo.geo_intersects(_lines(spark, d), "geom", "POLYGON((10.5 0.5, 60.5 0.5, 60.5 12.5, 10.5 12.5, 10.5 0.5))")
    return out.select("c_custkey", "intersects")
