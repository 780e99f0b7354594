"""Ranked lexical search of stated items against all documents, as dense products.

Items come in groups bounded by count and bytes. A group's distinct terms are its
compact vocabulary; documents are reduced to the counts of those terms, in one pass, and
that table is stored. Document frequencies, document count and the sum of lengths are
sums over it. In the second pass a tile of documents becomes a matrix of impacts (terms
times documents), cut into tiles of terms, and each is multiplied by the weights (items
times terms) in float64. A tile has so few terms that no sum can reach 2^53, so every
product is exact whatever the order of its additions; tiles add up in 64-bit integers.

Each task keeps an item's ``k`` best so far by (score, smaller doc_id); a later tile
enters with every score not below the k-th, so ties at the border are decided by id.
The tasks' lists are merged in two steps.

Terms are compared by 64-bit hashes of their bytes.

Defined results: null or empty text has no terms; a document without terms counts
nowhere; a null doc_id comes last among equal scores; repeated rows are documents of
their own; rows sharing an item_id (null included) are one item with the terms of all;
an item without terms, or with no document, has no rows; empty tables give no rows;
extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .registry import query, table
from .textbytes import ALNUM, LOWER, text_slices, word_hashes, words

ITEMS, ITEM_BYTES = 512, 32_000_000  # a group of items: at most so many on average
TERMS, DOCUMENTS = 4_096, 512  # a tile
TOP = 50
EXACT = 1 << 53
IMPACT = 10**6  # no impact reaches it
COUNTS = "ids binary, none binary, n binary, doc binary, term binary, tf binary"
FOUND = "item int, doc_id long, score long"


def terms_of(texts: pa.Array):
    """Yield (first row, hash of every term, first term of every text)."""
    for row, off, data in text_slices(texts):
        low = LOWER[data]
        start, end, first = words(off, low, ALNUM)
        yield row, word_hashes(low, start, end), first


class Group:
    """A group's items: vocabulary (sorted hashes) and, per item, its terms."""

    def __init__(self, rows: list[tuple]):
        self.item_ids = list(dict.fromkeys(r[0] for r in rows))
        index = {name: i for i, name in enumerate(self.item_ids)}
        pairs = []
        for row, h, first in terms_of(pa.array([r[1] for r in rows], pa.large_string())):
            owner = np.array([index[r[0]] for r in rows[row:row + len(first) - 1]], np.int64)
            pairs.append((h, np.repeat(owner, np.diff(first))))
        h, owner = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.vocabulary, term = np.unique(h, return_inverse=True)
        pair = np.unique(term * max(len(self.item_ids), 1) + owner)
        self.term, self.item = pair // max(len(self.item_ids), 1), pair % max(len(self.item_ids), 1)


def count_terms(vocabulary: np.ndarray):
    """A row per slice of texts: ids, lengths, and the counts of the vocabulary's terms."""

    def run(batches):
        for batch in batches:
            ids, none = batch.column("doc_id"), np.asarray(batch.column("doc_id").is_null())
            ids = ids.fill_null(0).to_numpy()
            for row, h, first in terms_of(batch.column("text")):
                n = np.diff(first)
                place = np.searchsorted(vocabulary, h)
                place[place == len(vocabulary)] = 0
                hit = vocabulary[place] == h
                pair, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * len(vocabulary) + place[hit], return_counts=True)
                some = np.flatnonzero(n)
                new = np.full(len(n), -1)
                new[some] = np.arange(len(some))
                columns = (ids[row + some], none[row + some], n[some], new[pair // len(vocabulary)], pair % len(vocabulary), tf)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([c.astype(t).tobytes()], pa.binary()) for c, t in zip(columns, KINDS)],
                                                     names=[c.split()[0] for c in COUNTS.split(", ")])

    return run


KINDS = ("<i8", "u1", "<i8", "<u4", "<u4", "<i8")


def read_rows(batches):
    for batch in batches:
        for row in zip(*batch.columns):
            yield [np.frombuffer(x.as_buffer(), t) for x, t in zip(row, KINDS)]


def sum_counts(size: int):
    """A task's share of (term, documents); -1: documents, -2: their terms."""

    def run(batches):
        df, documents, length = np.zeros(size, np.int64), 0, 0
        for _, _, n, _, term, _ in read_rows(batches):
            df += np.bincount(term, minlength=size)
            documents, length = documents + len(n), length + int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [documents, length]))],
                                         names=["term", "n"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class WeightTiles:
    """Weights of a group (items times terms), cut so that no sum of products in a tile
    reaches 2^53; made dense when they are read, and kept while they are few."""

    KEEP_BYTES = 64_000_000

    def __init__(self, term, item, weights: np.ndarray, items: int):
        heaviest = int(weights.max(initial=1))
        self.terms = int(max(1, min(TERMS, (EXACT - 1) // (max(heaviest, 1) * IMPACT))))
        self.term, self.item, self.weights, self.items = term, item, weights, items
        self.starts = range(0, len(weights), self.terms)
        self.kept = {} if len(weights) * items * 8 <= self.KEEP_BYTES else None

    def dense(self, start: int) -> np.ndarray:
        if self.kept is not None and start in self.kept:
            return self.kept[start]
        a, b = np.searchsorted(self.term, [start, start + self.terms])
        out = np.zeros((self.items, min(self.terms, len(self.weights) - start)))
        out[self.item[a:b], self.term[a:b] - start] = self.weights[self.term[a:b]]
        if self.kept is not None:
            self.kept[start] = out
        return out

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int) -> np.ndarray:
        """Items times documents."""
        order = np.argsort(term, kind="stable")
        doc, term, impact = doc[order], term[order], impact[order]
        out = np.zeros((self.items, documents), np.int64)
        for start in self.starts:
            a, b = np.searchsorted(term, [start, start + self.terms])
            if a == b:
                continue
            weights = self.dense(start)
            impacts = np.zeros((weights.shape[1], documents))
            impacts[term[a:b] - start, doc[a:b]] = impact[a:b]
            out += (weights @ impacts).astype(np.int64)
        return out


class Best:
    """Each item's k best documents: score falling, then id rising, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.border = k, np.ones(items, np.int64)  # scores above 0 only
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.border[:, None])
        if not len(item):
            return
        score = np.concatenate([self.score, scores[item, doc]])
        item = np.concatenate([self.item, item])
        none, ids = np.concatenate([self.none, none[doc]]), np.concatenate([self.doc, ids[doc]])
        order = np.lexsort((ids, none, -score, item))
        first = np.searchsorted(item[order], item[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.item, self.score, self.doc, self.none = item[order], score[order], ids[order], none[order]
        last = np.flatnonzero(np.append(self.item[1:] != self.item[:-1], True))
        full = np.bincount(self.item, minlength=len(self.border))[self.item[last]] == self.k
        self.border[self.item[last[full]]] = self.score[last[full]]


def score_documents(group: Group, weights: np.ndarray, documents: int, length: int, k: int):
    def run(batches):
        tiles = WeightTiles(group.term, group.item, weights, len(group.item_ids))
        best = Best(len(group.item_ids), k)
        waiting: list = []

        def flush():
            ids, none, n, doc, term, tf = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            for a in range(0, len(ids), DOCUMENTS):
                lo, hi = np.searchsorted(doc, [a, a + DOCUMENTS])
                size = n[a:a + DOCUMENTS]
                m = 100 - 50 + (50 * size * documents) // length
                at = doc[lo:hi] - a
                impact = (10**9 * tf[lo:hi]) // (1000 * tf[lo:hi] + 20 * m[at])
                best.add(tiles.scores(at, term[lo:hi], impact, len(size)), ids[a:a + DOCUMENTS], none[a:a + DOCUMENTS])

        held = 0
        for ids, none, n, doc, term, tf in read_rows(batches):
            waiting.append((ids, none.astype(bool), n, doc.astype(np.int64) + held, term.astype(np.int64), tf))
            held += len(ids)
            if held >= DOCUMENTS:
                flush()
                held = 0
        if waiting:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.none),
                                          pa.array(best.score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_group(docs: DataFrame, rows: list[tuple], k: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) of one group's items."""
    spark = docs.sparkSession
    group = Group(rows)
    size = len(group.vocabulary)
    if not size:
        return None
    counts = staged(docs.mapInArrow(count_terms(group.vocabulary), COUNTS), "term_counts")
    # one row per term of the group and two more
    sums = dict(map(tuple, counts.mapInArrow(sum_counts(size), "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    documents, length = sums.pop(-1, 0), sums.pop(-2, 0)
    if not documents:
        return None
    weights = np.array([weight(documents, sums.get(t, 0)) for t in range(size)], np.int64)
    found = counts.mapInArrow(score_documents(group, weights, documents, length, k), FOUND)
    found = ranked(found.withColumn("part", F.spark_partition_id() % 64), ["item", "part"], k)
    names = spark.createDataFrame(list(enumerate(group.item_ids)), "item int, item_id long")  # at most a group's items
    return ranked(found.drop("rank", "part"), ["item"], k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` highest-scoring documents of every item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, total = items.agg(F.count_distinct("item_id"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-n // ITEMS), -(-(total or 0) // ITEM_BYTES))
    items = items.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        rows = items.where(F.col("group") == g).select("item_id", "text").collect()
        found = search_group(docs, [tuple(r) for r in rows], k)
        if found is not None:
            out = out.unionByName(found)
    return out


SQL = r"""
WITH t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS r FROM documents)),
c AS (SELECT r, doc_id, term, COUNT(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT r, COUNT(*) AS n FROM t GROUP BY r),
a AS (SELECT COUNT(*) AS nn, CAST(SUM(n) AS BIGINT) AS ll FROM l),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * COUNT(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM c, a GROUP BY term, nn),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (
  SELECT item_id, c.r, c.doc_id,
         CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM i JOIN c ON i.term = c.term JOIN w ON w.term = c.term JOIN l ON l.r = c.r, a GROUP BY item_id, c.r, c.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 50
"""


@query("op12_ranked_search", SQL)
def op12_ranked_search(spark, d):
    return ranked_search(table(spark, d, "documents"), table(spark, d, "benchmark"))
