"""Keyword (BM25) and vector search, and embedding near-duplicate removal."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.core import col_list
from lakeloom.functions.stemming import STOP_WORDS, stem, stem_udf
from lakeloom.operators import metric_index

# Okapi BM25 parameters.
BM25_K1 = 1.2
BM25_B = 0.75
TOKEN_SPLIT = "[^a-z]+"
# Lower-case Latin letters with diacritics and their base
# letters (accents are stripped before splitting, as the keyword index does).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"


def _strip_accents_py(s: str) -> str:
    return s.translate(str.maketrans(ACCENTED, UNACCENTED))


def tokenize_query(query: str) -> list[str]:
    """Lower-case, strip accents, split at anything that is not a-z,
    distinct terms."""
    seen, out = set(), []
    for tok in re.split(TOKEN_SPLIT, _strip_accents_py(query.lower())):
        if tok and tok not in seen:
            seen.add(tok)
            out.append(tok)
    return out


def _folded(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(f"[{ACCENTED}]"), F.translate(low, ACCENTED, UNACCENTED)).otherwise(low)


def _word_pattern(words: list[str], ending: str = "") -> str:
    """Whole runs of letters that are (with ``ending`` ``[a-z]*``: begin with) one of ``words``."""
    return f"(?<![a-z])(?:{'|'.join(sorted(words))}){ending}(?![a-z])"


def _variants(text: Column, df: DataFrame, stems: list[str]) -> dict[str, list[str]]:
    """The corpus words of each stem. Stemming keeps a word's beginning, so only words
    that begin like a stem are stemmed; a stem has at most as many words as there are
    chains of suffixes, which bounds what reaches the driver."""
    begins = list({s[:max(1, len(s) - 2)] for s in stems})
    words = df.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_word_pattern(begins, "[a-z]*")), F.lit(0)))).alias("word"))
    found = words.distinct().withColumn("stem", stem_udf("word")).where(F.col("stem").isin(stems)).collect()
    out: dict[str, list[str]] = {s: [] for s in stems}
    for r in found:
        out[r["stem"]].append(r["word"])
    return out


def text_search(df: DataFrame, id_column: str, text_columns, query: str, top_k: int | None = None,
                output: str = "score", stop_words=STOP_WORDS, stemming: bool = True) -> DataFrame:
    """Okapi BM25 (k1 1.2, b 0.75, idf = log10((N − df + 0.5)/(df + 0.5) + 1)) of each
    row against ``query``; only rows holding a query term are returned, best first when
    ``top_k`` is set.

    Text is lower-cased and accent-stripped and split at non-letters; ``stop_words`` are
    left out of it, and words are compared by their Porter stems, so ``dog`` finds
    ``dogs`` and ``the`` counts nowhere.

    The corpus is read three times, each time with a light expression and without a
    shuffle of rows: the distinct words that begin like a query stem are stemmed; one
    row of statistics (rows, mean length, rows per term) is summed; rows that hold a
    term's word are scored from that row."""
    tokens = tokenize_query(query)
    terms = list(dict.fromkeys(stem(t) for t in tokens)) if stemming else tokens
    if not terms:
        raise ValueError("text_search: the query has no terms")
    text = _folded(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in col_list(text_columns)]))
    stop = set(stop_words or ())
    words = _variants(text, df, terms) if stemming else {t: [t] for t in terms}
    words = {t: sorted(set(w) - stop) for t, w in words.items()}
    words = {t: w for t, w in words.items() if w}
    if not words:
        return df.where(F.lit(False)).withColumn(output, F.lit(None).cast("double"))
    kept = F.filter(F.split(F.col("__w_text"), TOKEN_SPLIT), lambda t: (t != "") & ~t.isin(list(stop)) if stop else t != "")
    base = df.withColumn("__w_text", text)
    counts = [F.size(F.regexp_extract_all("__w_text", F.lit(_word_pattern(w)), F.lit(0))) for w in words.values()]
    stats = base.agg(F.count(F.lit(1)).alias("__w_n"), F.avg(F.size(kept)).alias("__w_mean"),
                     *[F.count_if(F.col("__w_text").rlike(_word_pattern(w))).alias(f"__w_df{i}") for i, w in enumerate(words.values())])
    every = [x for w in words.values() for x in w]
    hits = base.where(F.col("__w_text").rlike(_word_pattern(every))).crossJoin(F.broadcast(stats))  # one row
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.size(kept) / F.col("__w_mean"))
    score = F.lit(0.0)
    for i, tf in enumerate(counts):
        df_i = F.col(f"__w_df{i}")
        idf = F.log10((F.col("__w_n") - df_i + 0.5) / (df_i + 0.5) + 1)
        score = score + idf * (tf * (BM25_K1 + 1) / (tf + F.col("__w_norm")))
    out = hits.withColumn("__w_norm", norm).withColumn(output, score).select(*[F.col(f"`{c}`") for c in df.columns], output)
    if top_k:
        out = out.orderBy(F.col(output).desc(), F.col(f"`{id_column}`")).limit(int(top_k))
    return out


# ---------------------------------------------------------------------------
# Vectors
# ---------------------------------------------------------------------------

def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def vector_score(v: Column, target: Column, metric: str) -> Column:
    if metric == "cosine":
        return _dot(v, target) / (_norm(v) * _norm(target))
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(v, target, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
                                  F.lit(0.0), lambda acc, x: acc + x))
    if metric == "inner_product":
        return _dot(v, target)
    raise ValueError(f"unknown distance metric {metric!r}")


def vector_search(df: DataFrame, vector_column: str, target_vector: list[float], dimension: int | None = None,
                  distance_metric: str = "cosine", top_k: int | None = None, output: str = "similarity_score") -> DataFrame:
    """Score every row against ``target_vector``; with ``top_k`` keep the
    best k (l2 ascending, others descending) as a distributed top-k."""
    dim = dimension or len(target_vector)
    if len(target_vector) != dim:
        raise ValueError(f"vector_search: target has {len(target_vector)} values, dimension is {dim}")
    target = F.array(*[F.lit(float(x)) for x in target_vector])
    out = df.withColumn(output, vector_score(F.col(vector_column), target, distance_metric))
    if top_k:
        order = F.col(output).asc_nulls_last() if distance_metric == "l2" else F.col(output).desc_nulls_last()
        out = out.orderBy(order).limit(int(top_k))
    return out


def _usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x): vectors of finite numbers, not all zero."""
    x = F.transform(F.col(vector_column), lambda e: e.cast("double"))
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(x, lambda e: e != 0)
    return df.where(usable).select(F.col(id_column).cast("bigint").alias("id"), x.alias("x"))


def cosine_pairs(df: DataFrame, id_column: str, vector_column: str, threshold: float) -> DataFrame:
    """All pairs ``(i, j)`` with ``i < j`` and cosine ≥ threshold, exactly.

    Equal vectors are searched once. The search is a hierarchy of cells over the unit
    vectors (``metric_index``); vectors of different lengths never pair. A missing,
    empty or zero vector, or one holding a null, NaN or infinity, pairs with nothing."""
    rows = _usable(df, id_column, vector_column)
    names = rows.groupBy("x").agg(F.min("id").alias("rep"))
    members = rows.join(names, "x").select("id", "rep").checkpoint(eager=True)
    found = metric_index.near_pairs(names.select(F.col("rep").alias("id"), "x"), float(threshold))
    a = members.select(F.col("id").alias("a"), F.col("rep").alias("i"))
    b = members.select(F.col("id").alias("b"), F.col("rep").alias("j"))
    pairs = found.join(a, "i").join(b, "j").select("a", "b", "score")
    if threshold <= 1:
        same = a.join(b, F.col("i") == F.col("j")).where("a < b").select("a", "b", F.lit(1.0).alias("score"))
        pairs = pairs.unionByName(same)
    return pairs.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "score")


def semantic_dedupe(df: DataFrame, id_column: str, embedding_column: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Greedy in ``id`` order: keep a row unless an earlier KEPT row has
    cosine ≥ threshold. Rows with a missing or zero embedding, or one that
    holds NaN or infinity, are kept.

    The greedy result is the lexicographically-first independent set of the
    similarity graph; it is computed in rounds over the edge list: a node without an
    earlier neighbour is kept, its later neighbours are dropped, and the edges of either
    are done with, so every round shuffles fewer edges (similar pairs). Of equal vectors
    only the first can be kept, so the graph holds one of them."""
    rows = _usable(df, id_column, embedding_column)
    names = rows.groupBy("x").agg(F.min("id").alias("id"))
    copies = rows.join(names.withColumnRenamed("id", "rep"), "x").where("id <> rep").select(F.col("id").alias("__drop"))
    found = metric_index.near_pairs(names, float(threshold))
    edges = found.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).checkpoint(eager=True)
    dropped = edges.select(F.col("j").alias("__drop")).limit(0)
    while edges.limit(1).count():  # the smallest node has no earlier neighbour
        first = edges.select("i").join(edges.select(F.col("j").alias("i")), "i", "left_anti").distinct()
        gone = edges.join(first, "i").select(F.col("j").alias("__drop")).distinct().checkpoint(eager=True)
        dropped = dropped.unionByName(gone)
        edges = edges.join(gone.withColumnRenamed("__drop", "j"), "j", "left_anti") \
            .join(gone.withColumnRenamed("__drop", "i"), "i", "left_anti").select("i", "j").checkpoint(eager=True)
    if threshold <= 1:
        dropped = dropped.unionByName(copies)
    return df.join(dropped, df[id_column] == dropped["__drop"], "left_anti")
