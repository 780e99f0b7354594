"""Approximate nearest neighbours by vantage-point trees, one tree per shard.

Vectors are dealt to shards of about ``shard_rows`` by a hash of their id. A task
builds a shard's tree over its distinct vectors (a vantage point, the distances to
it, a median split, and each child's range of distances) and takes a block of
queries down together. With ``factor`` f and a query's k-th best distance so far t,
a child whose range of distances [lo, hi] is further than f * t from the query's
distance to the vantage point is left out: f = 1 is the triangle inequality and
restores exact search, smaller f prunes more and may miss neighbours. Distances are
those of unit vectors, so nearest means largest cosine. The candidates that remain
are scored again on the original vectors, and a query's best of all shards are
merged.

Defined results: rows whose id is null, or whose vector is null, zero or holds null
or non-finite components, take no part; vectors of different lengths are never
compared; of rows sharing an id the smallest vector counts; equal scores are ranked
by id; an empty table gives no rows; extra columns are not read. Of copies of one
vector a shard returns only the smallest ids that can be among the k nearest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .registry import query, table
from .vectors import matrix, one_vector_per_id, pair_cosines, unit

K = 5
LEAF = 128
SHARD_ROWS = 8192
QUERY_BLOCK = 2048
PLACES = 1 << 18  # of all queries searched together
FACTOR = 0.8
SLACK = 1e-7  # of distances: sqrt(2 - 2 cos) near 0 carries about half the digits


class VantageTree:
    """Nodes are (vantage row, [(lo, hi, child), (lo, hi, child)]) or a leaf's rows."""

    def __init__(self, points: np.ndarray, seed: int = 3):
        self.points = points
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        at = int(self.rng.integers(len(rows)))
        vantage, rows = rows[at], np.delete(rows, at)
        d = distances(self.points[vantage][None, :], self.points[rows])[0]
        order = np.argsort(d, kind="stable")
        rows, d = rows[order], d[order]
        half = len(rows) // 2
        return int(vantage), [(d[0], d[half - 1], self._build(rows[:half])), (d[half], d[-1], self._build(rows[half:]))]

    def search(self, queries: np.ndarray, k: int, factor: float):
        """Rows and distances of the k nearest of each query found, nearest first
        (row -1: fewer)."""
        self.found = np.full((len(queries), k), -1)
        self.best = np.full((len(queries), k), np.inf)
        self.visited = 0
        self.queries, self.factor = queries, factor
        self._visit(self.root, np.arange(len(queries)))
        return self.found, self.best

    def _offer(self, active: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        self.visited += d.size
        better = (d < self.best[active, -1:]).any(axis=1)
        active, d = active[better], d[better]
        k = self.best.shape[1]
        all_d = np.concatenate([self.best[active], d], axis=1)
        all_r = np.concatenate([self.found[active], np.broadcast_to(rows, d.shape)], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :k]
        self.best[active] = np.take_along_axis(all_d, order, 1)
        self.found[active] = np.take_along_axis(all_r, order, 1)

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self._offer(active, node, distances(self.queries[active], self.points[node]))
            return
        vantage, children = node
        d = distances(self.queries[active], self.points[vantage][None, :])
        self._offer(active, np.array([vantage]), d)
        d = d[:, 0]
        gaps = [np.maximum(np.maximum(lo - d, d - hi), 0.0) for lo, hi, _ in children]
        nearer = gaps[0] <= gaps[1]
        for group, order in ((nearer, (0, 1)), (~nearer, (1, 0))):
            for child in order:
                reach = gaps[child] <= self.factor * self.best[active, -1] + SLACK
                self._visit(children[child][2], active[group & reach])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def search_shard(k: int, factor: float):
    def run(key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(data) or not len(asked):
            return out
        data = data.sort_values("id")
        ids, raw = data["id"].to_numpy(), matrix(data["v"])
        q_ids, q_raw = asked["q_id"].to_numpy(), matrix(asked["q_v"])
        # copies of one vector are one point; its k + 1 smallest ids can matter
        distinct, inverse = np.unique(raw, axis=0, return_inverse=True)
        order = np.argsort(inverse.reshape(-1), kind="stable")
        first = np.searchsorted(inverse.reshape(-1)[order], np.arange(len(distinct) + 1))
        tree, q_unit = VantageTree(unit(distinct)), unit(q_raw)
        parts = []

        def score(asked_rows: np.ndarray, found: np.ndarray) -> None:
            """Add the k best of each query among the points found."""
            pairs = [(q, ids[i], p) for q, points in zip(asked_rows, found) for p in points if p >= 0
                     for i in order[first[p]:min(first[p + 1], first[p] + k + 1)] if ids[i] != q_ids[q]]
            if not pairs:
                return
            q, v, p = (np.array(x) for x in zip(*pairs))
            cosine = pair_cosines(q_raw[q], distinct[p])
            best = np.lexsort((v, -cosine, q))
            q, v, cosine = q[best], v[best], cosine[best]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            parts.append(pd.DataFrame({"query_id": q_ids[q[keep]], "vec_id": v[keep], "score": cosine[keep]}))

        # a few spare places: the last digits of the tree's distances differ from the
        # scores. Where the last place still ties with the k-th beside the query itself,
        # the query is asked again with more places.
        places, open_ = k + 4, np.arange(len(q_ids))
        while len(open_):
            again, step = [], max(1, PLACES // places)
            for rows in (open_[at:at + step] for at in range(0, len(open_), step)):
                found, best = tree.search(q_unit[rows], places, factor)
                tied = (best[:, -1] <= best[:, k] + SLACK) & np.isfinite(best[:, -1]) & (places < len(distinct))
                score(rows[~tied], found[~tied])
                again.append(rows[tied])
            places, open_ = min(4 * places, len(distinct)), np.concatenate(again)
        return pd.concat(parts, ignore_index=True) if parts else out

    return run


def nearest(table_: DataFrame, is_query, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``table_`` (vec_id, embedding);
    ``is_query`` is a condition on the column ``id``."""
    vectors = staged(one_vector_per_id(table_), "vectors").withColumn("dim", F.size("v"))
    # one row per length of vector: how many shards and query blocks it needs
    sizes = staged(vectors.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"),
        F.ceil(F.count(F.when(is_query, 1)) / query_block).cast("int").alias("blocks")).where("blocks > 0"), "sizes")
    vectors = vectors.join(sizes, "dim")
    data = (vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
            .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))))
    asked = (vectors.where(is_query).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks")).cast("int"))
             .withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))))
    keys = ["dim", "shard", "block"]
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in keys), F.col("id").alias("q_id"), F.col("v").alias("q_v"))
    found = (data.select(*keys, "id", "v").groupBy(*keys).cogroup(asked.groupBy(*(f"q_{c}" for c in keys)))
             .applyInPandas(search_shard(k, factor), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 5
"""


@query("op9_vptree_search", SQL)
def op9_vptree_search(spark, d):
    return nearest(table(spark, d, "embeddings"), F.col("id") % 50 == 0)
