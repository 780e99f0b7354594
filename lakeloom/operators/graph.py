"""Connected components over an edge list (match pairs → cluster ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large_star(e: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest of its neighbours
    and itself. ``e`` holds each edge once (u > v)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def match_groups(df: DataFrame, left_key: str = "id_a", right_key: str = "id_b") -> DataFrame:
    """``id, cluster_id``: every node's cluster id is the smallest member id
    (compared as text). Edges with a NULL end are dropped.

    Alternating large-star / small-star rounds (each a grouped min plus an
    equi-join over the edge list, no per-component collection) turn every
    component into a star around its smallest node in a logarithmic number
    of rounds; a round that leaves the edge set unchanged ends the loop. Each
    round is checkpointed, so lineage stays short and a lost executor
    recomputes at most a round."""
    a, b = F.col(left_key).cast("string"), F.col(right_key).cast("string")
    raw = df.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    raw = raw.distinct().checkpoint(eager=True)
    e = raw.where("u <> v")

    def signature(x: DataFrame):
        r = x.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        return r["n"], r["h"]

    before = signature(e)
    while before[0]:
        e = _small_star(_large_star(e)).checkpoint(eager=True)
        after = signature(e)
        if after == before:
            break
        before = after
    centre = e.select(F.col("u").alias("id"), F.col("v").alias("cluster_id"))
    alone = raw.select(F.col("v").alias("id"), F.col("v").alias("cluster_id"))  # centres, and nodes with only a self loop
    return centre.unionByName(alone.join(centre.select("id"), "id", "left_anti").distinct())
