"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected by random rotations to ``TABLES`` spaces of eight
dimensions and decoded to the nearest E8 lattice point there. A vector lies in its
own cell of each table and probes the ``PROBES`` cells whose points are next nearest.
Two vectors become candidates if one of them probes a cell of the other; the cosine
decides. At the threshold 0.95 the defaults find more than 99.9 % of the pairs of
64 dimensions (tests measure it), more above it.

Large groups are never expanded into pairs. In ``ROUNDS`` rounds the vectors of one
cell join the ball of the cell's smallest id if that keeps the ball's radius within
half the threshold angle: members of a ball are then linked to each other by the
triangle inequality. Cells are met by balls, not by vectors, and candidate balls are
decided together where the angle between their centres and their radii leave no
doubt; only the rest is compared member by member. Links are counted, and components
are those of the linked balls.

Defined results: vectors that are null, zero or hold null or non-finite components
link with nothing, and vectors of different lengths never link; of rows sharing an id
the smallest usable vector counts, and each row is returned; a null id has no links,
a null component and is kept; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, staged
from .lattice import cell_keys, decode, probes, rotations
from .registry import query, table
from .vectors import one_vector_per_id, unit

THRESHOLD = 0.95
TABLES = 8
PROBES = 12
WIDTH = 0.85
ROUNDS = 4
SLACK = 1e-7  # radians kept between a sure link and the threshold
SIGNS = 64


def hash_batches(tables: int, n_probes: int, width: float, seed: int):
    """(id, v) -> id, v scaled exactly to at most 1, sign bits, and for each table
    the key of the own cell followed by those of the probed cells."""
    known: dict[int, tuple] = {}

    def plan(dim):
        if dim not in known:
            per = -(-dim // 8)
            spaces = rotations(dim, -(-tables // per), seed)[:tables]
            rng = np.random.default_rng(seed + 1)
            known[dim] = (spaces, rng.uniform(0, 1, (tables, 8)), rng.normal(size=(dim, SIGNS)))
        return known[dim]

    def run(batches):
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            n = len(vectors)
            scaled: list = [None] * n
            signs, keys = np.zeros(n, np.int64), np.zeros((n, tables * (1 + n_probes)), np.int64)
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = np.array([vectors[i] for i in rows], np.float64)
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
                spaces, offsets, planes = plan(int(dim))
                u = unit(x)
                signs[rows] = ((u @ planes >= 0).astype(np.uint64) << np.arange(SIGNS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
                for t in range(tables):
                    y = u @ spaces[t] / width + offsets[t]
                    home = decode(y)
                    around = np.concatenate([home[:, None, :], probes(y, home, n_probes)], axis=1)
                    at = t * (1 + n_probes)
                    keys[rows, at:at + 1 + n_probes] = cell_keys(around, int(dim) * tables + t).view(np.int64)
                for i, r in enumerate(rows):
                    scaled[r] = x[i]
            width_ = keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scaled, pa.list_(pa.float64())), pa.array(signs),
                 pa.ListArray.from_arrays(np.arange(0, n * width_ + 1, width_, dtype=np.int32), keys.reshape(-1))],
                names=["id", "v", "signs", "keys"])

    return run


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, aa, b, bb):
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(F.col(aa) * F.col(bb))))


def build_balls(vectors: DataFrame, half: float, per_table: int) -> DataFrame:
    """(id, ball): which ball each vector joined; a ball is named by its centre."""
    centres = vectors.select("id", "v", "vv", "keys", F.lit(0.0).alias("radius"))
    member = vectors.select("id", F.col("id").alias("ball"))
    for r in range(ROUNDS):
        cells = centres.withColumn("cell", F.col("keys")[r * per_table])
        first = cells.groupBy("cell").agg(F.min(F.struct("id", "v", "vv")).alias("c"))
        first = first.select(F.col("cell").alias("c_cell"), F.col("c.id").alias("c_id"), F.col("c.v").alias("c_v"), F.col("c.vv").alias("c_vv"))
        reach = F.acos(cosine("v", "vv", "c_v", "c_vv")) + F.col("radius")
        moves = (cells.join(first, F.col("cell") == F.col("c_cell")).where("id <> c_id")
                 .select("id", F.col("c_id").alias("to"), reach.alias("reach")).where(F.col("reach") <= half))
        moves = staged(moves, "moves")
        grown = moves.groupBy("to").agg(F.max("reach").alias("grown")).withColumnRenamed("to", "id")
        centres = staged(centres.join(moves.select("id"), "id", "left_anti").join(grown, "id", "left")
                         .withColumn("radius", F.greatest("radius", F.coalesce("grown", F.lit(0.0)))).drop("grown"), "centres")
        member = staged(member.join(moves.select(F.col("id").alias("ball"), "to"), "ball", "left")
                        .select("id", F.coalesce("to", "ball").alias("ball")), "members")
    return member


def near_duplicates(table_: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, n_probes: int = PROBES,
                    width: float = WIDTH, seed: int = 29) -> DataFrame:
    """A row per usable vector: id, n_links, component_id."""
    limit = math.acos(threshold)
    per_table = 1 + n_probes
    vectors = one_vector_per_id(table_).mapInArrow(hash_batches(tables, n_probes, width, seed),
                                                   "id long, v array<double>, signs long, keys array<long>")
    vectors = staged(vectors.withColumn("vv", dot("v", "v")), "hashed")
    member = build_balls(vectors, limit / 2 - SLACK, per_table)
    held = vectors.join(member, "id")
    centre = vectors.select(F.col("id").alias("ball"), F.col("v").alias("c_v"), F.col("vv").alias("c_vv"), F.col("signs").alias("c_signs"))
    held = staged(held.join(centre, "ball").withColumn("theta", F.acos(cosine("v", "vv", "c_v", "c_vv"))).drop("signs"), "held")
    balls = staged(held.groupBy("ball").agg(F.max("theta").alias("radius"), F.count(F.lit(1)).alias("size"))
                   .join(centre, "ball"), "balls")

    # Which balls meet in a cell; sign bits drop most of the chance meetings: the
    # bits in which vectors at angle a differ are binomial with share a / pi.
    rows = (held.select("ball", F.posexplode("keys").alias("place", "key"))
            .groupBy("key", "ball").agg(F.min(F.col("place") % per_table).alias("place")))
    rows = rows.join(balls.select("ball", "radius", "c_signs"), "ball")
    home = rows.where("place = 0").select("key", F.col("ball").alias("b"), F.col("radius").alias("b_radius"), F.col("c_signs").alias("b_signs"))
    share = F.least(F.lit(0.5), (F.lit(limit) + F.col("radius") + F.col("b_radius")) / math.pi)
    bits = SIGNS * share + 6 * F.sqrt(SIGNS * share * (1 - share))
    met = (rows.join(home, "key").where((F.col("ball") != F.col("b")) & (F.bit_count(F.col("c_signs").bitwiseXOR(F.col("b_signs"))) <= bits))
           .select(F.least("ball", "b").alias("a"), F.greatest("ball", "b").alias("b")).distinct())
    met = staged(met, "met")

    def side(name, *more):
        return balls.select(F.col("ball").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("radius", "size", "c_v", "c_vv", *more)))

    slack = F.when(F.col("a_radius") + F.col("b_radius") > 0, F.lit(SLACK)).otherwise(F.lit(0.0))
    pairs = (met.join(side("a"), "a").join(side("b"), "b")
             .withColumn("cos", cosine("a_c_v", "a_c_vv", "b_c_v", "b_c_vv"))
             .withColumn("sure", F.when((F.col("a_size") == 1) & (F.col("b_size") == 1), F.col("cos") >= threshold)
                         .otherwise(F.acos("cos") + F.col("a_radius") + F.col("b_radius") <= limit - slack))
             .where(F.col("sure") | ((F.col("a_size") + F.col("b_size") > 2)
                                     & (F.acos("cos") - F.col("a_radius") - F.col("b_radius") <= limit + slack))))
    pairs = staged(pairs.select("a", "b", "sure", "a_size", "b_size", "b_radius", "b_c_v", "b_c_vv"), "pairs")

    # Doubtful pairs of balls: every member of a against the ball b, then against its members.
    one = (pairs.where("not sure").drop("sure", "a_size")
           .join(held.select(F.col("ball").alias("a"), F.col("id").alias("x"), F.col("v").alias("x_v"), F.col("vv").alias("x_vv")), "a")
           .withColumn("cos", cosine("x_v", "x_vv", "b_c_v", "b_c_vv"))
           .withColumn("sure", F.when(F.col("b_size") == 1, F.col("cos") >= threshold)
                       .otherwise(F.acos("cos") + F.col("b_radius") <= limit - SLACK))
           .where(F.col("sure") | ((F.col("b_size") > 1) & (F.acos("cos") - F.col("b_radius") <= limit + SLACK)))
           .select("a", "b", "x", "x_v", "x_vv", "sure", "b_size"))
    one = staged(one, "one")
    two = (one.where("not sure")
           .join(held.select(F.col("ball").alias("b"), F.col("id").alias("y"), F.col("v").alias("y_v"), F.col("vv").alias("y_vv")), "b")
           .where(cosine("x_v", "x_vv", "y_v", "y_vv") >= threshold).select("a", "b", "x", "y"))
    two = staged(two, "two")

    by_ball = (pairs.where("sure").select(F.col("a").alias("ball"), F.col("b_size").alias("n"))
               .unionByName(pairs.where("sure").select(F.col("b").alias("ball"), F.col("a_size").alias("n")))
               .unionByName(one.where("sure").select(F.col("b").alias("ball"), F.lit(1).cast("long").alias("n")))
               .groupBy("ball").agg(F.sum("n").alias("ball_links")))
    by_id = (one.where("sure").select(F.col("x").alias("id"), F.col("b_size").alias("n"))
             .unionByName(two.select(F.col("x").alias("id"), F.lit(1).cast("long").alias("n")))
             .unionByName(two.select(F.col("y").alias("id"), F.lit(1).cast("long").alias("n")))
             .groupBy("id").agg(F.sum("n").alias("own_links")))
    edges = pairs.where("sure").select("a", "b").unionByName(one.where("sure").select("a", "b")).unionByName(two.select("a", "b"))
    component = connected_components(edges).select(F.col("id").alias("ball"), F.col("component_id").alias("joined"))
    smallest = held.groupBy("ball").agg(F.min("id").alias("least"))
    ball = (balls.select("ball", "size").join(by_ball, "ball", "left").join(component, "ball", "left").join(smallest, "ball")
            .withColumn("joined", F.coalesce("joined", "ball")))
    named = ball.groupBy("joined").agg(F.min("least").alias("component_id"))
    ball = staged(ball.join(named, "joined").drop("joined", "least"), "ball_results")
    return (member.join(ball, "ball").join(by_id, "id", "left")
            .select("id", "component_id", (F.col("size") - 1 + F.coalesce("ball_links", F.lit(0)) + F.coalesce("own_links", F.lit(0))).alias("n_links")))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
      ON x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
d AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a)
SELECT v.vec_id, (SELECT COUNT(*) FROM d WHERE d.a = v.vec_id) AS n_links,
       LEAST(v.vec_id, COALESCE((SELECT MIN(b) FROM r WHERE r.a = v.vec_id), v.vec_id)) AS component_id,
       NOT EXISTS (SELECT 1 FROM r WHERE r.a = v.vec_id AND r.b < v.vec_id) AS kept
FROM v
"""


@query("op3_lattice_dedup", SQL)
def op3_lattice_dedup(spark, d):
    given = table(spark, d, "embeddings")
    found = near_duplicates(given)
    return (given.select("vec_id").join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"),
                    F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept")))
