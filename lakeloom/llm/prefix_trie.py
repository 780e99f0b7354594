"""The prefix trie of conversations, as node tables with minimal-perfect-hash slots.

A conversation c is rebuilt: the first h turns of conversation c - c % 5 (h is the
CRC-32 of c in decimal, modulo 9), then its own turns after its first h. Turns become
128-bit digests, a prefix the exclusive or of its turns' digests with their places, so
prefixes of all conversations are one running window. Equal digests are checked: all
rows of a node must have the same parent and, by a third hash, the same last turn.

Spark counts the nodes (partial sums before the shuffle, so a common prefix is no hot
key). What is summed over subtrees is done in shards. A node's load is the number of
turns that its members have from it on, which bounds its subtree and falls along every
path; nodes of at most ``shard_nodes`` load form the first band, those of at most
``ratio`` times as much the second, and so on. A band's parts (subtrees cut off by the
next band) are dealt to shards whole. A shard gives each of its digests a slot, scatters
the counts into flat arrays, looks every parent's slot up and adds children to parents
from the deepest level upwards. The tops of its parts send their sums to the parents in
later bands; the last sums are the root's. A common first turn is thus split into many
shards, and a part of a later band has at most ``ratio`` nodes a level.

The ids that end at a node are hashed as a sorted stream; nothing is gathered.

Defined results: rows of equal turn come in the order of role, then text; null role or
text is empty, a null turn comes first; rows without conv_id belong to no conversation
and are left out; repeated rows are repeated turns; an empty table gives no rows; extra
columns are not read; c % 5 of a negative c has its sign, as in SQL.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .perfect_hash import SlotTable
from .registry import query, table
from .textbytes import mix64

SHARD_NODES = 200_000
RATIO = 1_000
_U = np.uint64
SUMS = ["children", "leaves", "saved"]
DONE = "d long, x1 long, x2 long, px1 long, px2 long, children long, leaves long, saved long, top boolean"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(c, d, len, t1, t2, t3, bytes) of every rebuilt turn, and a row of d = 0 per conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()) \
        .select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("k", F.row_number().over(order)).select(
        "c", "k", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2"),
        F.xxhash64(F.lit(2), F.length("role"), F.concat("role", "text")).alias("t3"), F.octet_length("text").cast("long").alias("bytes"))
    turns = staged(turns, "turns")
    sizes = turns.groupBy("c").agg(F.max("k").alias("n"))
    borrowed = (F.crc32(F.col("c").cast("string").cast("binary")) % 9).cast("int")
    convs = sizes.select("c", "n", borrowed.alias("h"), (F.col("c") - F.col("c") % 5).alias("s"))
    convs = convs.join(sizes.select(F.col("c").alias("s"), F.col("n").alias("ns")), "s", "left") \
        .withColumn("b", F.least("h", F.coalesce("ns", F.lit(0)))) \
        .withColumn("len", F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = staged(convs.select("c", "s", "h", "b", F.col("len").cast("long").alias("len")), "rebuilt_sizes")
    turn = ["t1", "t2", "t3", "bytes"]
    first = convs.where("b > 0").select("c", "s", "b", "len").join(turns.withColumnRenamed("c", "s"), "s").where("k <= b") \
        .select("c", F.col("k").cast("long").alias("d"), "len", *turn)
    own = turns.join(convs, "c").where("k > h").select("c", (F.col("b") + F.col("k") - F.col("h")).cast("long").alias("d"), "len", *turn)
    none = [F.lit(0).cast("long").alias(x) for x in turn]
    return convs.select("c", F.lit(0).cast("long").alias("d"), "len", *none).unionByName(first).unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, len, x1, x2, px1, px2, t3, bytes): every conversation's prefixes and their parents."""
    path = Window.partitionBy("c").orderBy("d")
    for x, t in (("x1", "t1"), ("x2", "t2")):
        placed = F.when(F.col("d") > 0, F.xxhash64("d", t)).otherwise(F.lit(0))
        turns = turns.withColumn("own", placed).withColumn(x, F.bit_xor("own").over(path)).withColumn("p" + x, F.col(x).bitwiseXOR(F.col("own")))
    return turns.select("c", "d", "len", "x1", "x2", "px1", "px2", "t3", "bytes")


def counted(rows: DataFrame) -> DataFrame:
    """One row per node: members, the smallest of them, load; digests are checked."""
    same = ["px1", "px2", "t3", "bytes"]
    nodes = rows.groupBy("d", "x1", "x2").agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("rep"), F.sum(F.col("len") - F.col("d") + 1).alias("load"),
        *[F.min(s).alias(s) for s in same], *[F.max(s).alias("max_" + s) for s in same])
    differ = F.lit(False)
    for s in same:
        differ = differ | (F.col(s) != F.col("max_" + s))
    checked = F.when(differ, F.raise_error(F.lit("two prefixes have one digest")).cast("long")).otherwise(F.col("n"))
    return nodes.select("d", "x1", "x2", checked.alias("n"), "rep", "load", "bytes")


def key_of(d: np.ndarray, x1: np.ndarray, x2: np.ndarray):
    return x1.view(_U) ^ mix64(d.astype(_U)), x2.view(_U)


def add_up(given: pa.Table) -> pa.Table:
    """A shard: slots, parents' slots, and sums from the deepest nodes upwards."""
    col = {c: given.column(c).to_numpy() for c in ("d", "x1", "x2", "px1", "px2", "n", "bytes", *SUMS)}
    slots = SlotTable(*key_of(col["d"], col["x1"], col["x2"]))
    parent_of = slots.find(*key_of(col["d"] - 1, col["px1"], col["px2"]))
    place = slots.slots
    size = len(place)
    flat = {c: np.zeros(size, np.int64) for c in SUMS}
    depth, parent = np.empty(size, np.int64), np.empty(size, np.int64)
    depth[place], parent[place] = col["d"], parent_of
    for c in SUMS:
        flat[c][place] = col[c]  # what earlier bands sent
    inner = parent >= 0
    flat["children"] += np.bincount(parent[inner], minlength=size)
    flat["saved"][place] += (col["n"] - 1) * col["bytes"]
    flat["leaves"] += flat["children"] == 0
    order = np.argsort(-depth, kind="stable")
    order = order[inner[order]]
    cut = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cut) if len(order) else ():
        for c in ("leaves", "saved"):
            np.add.at(flat[c], parent[level], flat[c][level])
    out = {c: given.column(c) for c in ("d", "x1", "x2", "px1", "px2")}
    out |= {c: pa.array(flat[c][place]) for c in SUMS}
    return pa.table(out | {"top": pa.array(parent_of < 0)})


def subtree_sums(nodes: DataFrame, shard_nodes: int) -> DataFrame:
    """``nodes`` with band and part: (d, x1, x2, children, leaves, saved) of all of them."""
    shards = max(1, -(-nodes.count() // shard_nodes))
    bands = nodes.agg(F.max("band")).first()[0]
    done, sent = None, None
    for band in range((-1 if bands is None else bands) + 1):
        part = nodes.where(F.col("band") == band)
        if sent is None:
            part = part.select("*", *[F.lit(0).cast("long").alias(c) for c in SUMS])
        else:
            part = part.join(sent, ["d", "x1", "x2"], "left").fillna(0, SUMS)
        part = part.select("d", "x1", "x2", "px1", "px2", "n", "bytes", *SUMS, F.pmod(F.xxhash64("part1", "part2"), F.lit(shards)).alias("shard"))
        part = staged(part.groupBy("shard").applyInArrow(add_up, DONE), "subtrees")
        tops = part.where("top").groupBy((F.col("d") - 1).alias("d"), F.col("px1").alias("x1"), F.col("px2").alias("x2")) \
            .agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        sent = tops if sent is None else staged(
            sent.unionByName(tops).groupBy("d", "x1", "x2").agg(*[F.sum(c).alias(c) for c in SUMS]), "sent")
        part = part.select("d", "x1", "x2", *SUMS)
        done = part if done is None else done.unionByName(part)
    return done


def hash_ends(batches):
    """Sorted (d, x1, x2, c): the SHA-256 of each node's ids, joined by commas, as a stream."""
    now, digest, out = None, None, []
    names = ["d", "x1", "x2", "ends"]

    def flush():
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=names)

    for batch in batches:
        for d, x1, x2, c in zip(*(batch.column(n).to_pylist() for n in ("d", "x1", "x2", "c"))):
            if (d, x1, x2) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (d, x1, x2), hashlib.sha256(str(c).encode())
            else:
                digest.update(f",{c}".encode())
        if len(out) > 4096:
            yield flush()
    if now is not None:
        out.append((*now, digest.hexdigest()))
        yield flush()


def prefix_trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES, ratio: int = RATIO) -> DataFrame:
    """The contract's row per node."""
    rows = staged(prefixes(rebuilt(conversations)), "prefixes")
    nodes = staged(counted(rows), "nodes")
    key = ["d", "x1", "x2"]
    band = F.greatest(F.ceil(F.log(F.col("load") / F.lit(float(shard_nodes))) / F.log(F.lit(float(ratio)))), F.lit(0)).cast("int")
    path = Window.partitionBy("c").orderBy("d")
    top = Window.partitionBy("c", "band").orderBy("d")
    placed = rows.drop("bytes", "t3", "len").join(nodes.withColumn("band", band), key) \
        .withColumn("parent", F.lag("rep").over(path)) \
        .withColumn("part1", F.first("x1").over(top)).withColumn("part2", F.first("x2").over(top)) \
        .where("c = rep").drop("c", "load")
    placed = staged(placed, "placed")
    sums = subtree_sums(placed, shard_nodes)
    if sums is None:
        sums = placed.select(*key, *[F.lit(0).cast("long").alias(c) for c in SUMS])
    ends = rows.where("d = len").select(*key, "c").repartition(*key).sortWithinPartitions(*key, "c") \
        .mapInArrow(hash_ends, "d long, x1 long, x2 long, ends string")
    out = placed.join(sums, key).join(ends, key, "left")
    return out.select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"),
                      F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS k,
         length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '') AS u, strlen(COALESCE(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(u ORDER BY k) AS l, list(bytes ORDER BY k) AS m,
             list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
                           lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                         lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS crc
      FROM t GROUP BY c),
h AS (SELECT *, CAST(xor(crc, 4294967295) % 9 AS BIGINT) AS h FROM o),
r AS (SELECT h.c, list_concat(COALESCE(list_slice(s.l, 1, h.h), []), list_slice(h.l, h.h + 1, len(h.l))) AS l,
             list_concat(COALESCE(list_slice(s.m, 1, h.h), []), list_slice(h.m, h.h + 1, len(h.m))) AS m
      FROM h LEFT JOIN h AS s ON s.c = h.c - h.c % 5),
p AS (SELECT c, d, list_slice(l, 1, d) AS key, len(l) AS n, CASE WHEN d > 0 THEN m[d] ELSE 0 END AS bytes
      FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM r)),
v AS (SELECT d, key, MIN(c) AS conv_id, COUNT(*) AS n_convs, (COUNT(*) - 1) * ANY_VALUE(bytes) AS saved, BOOL_AND(n = d) AS leaf,
             sha256(COALESCE(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
      FROM p GROUP BY d, key),
x AS (SELECT v.d AS below, leaf, saved, e, list_slice(key, 1, e) AS key FROM (SELECT *, unnest(range(d + 1)) AS e FROM v) AS v),
s AS (SELECT e AS d, key, COUNT(*) FILTER (WHERE below = e + 1) AS n_children, COUNT(*) FILTER (WHERE leaf) AS n_leaves,
             CAST(SUM(saved) AS BIGINT) AS saved_tokens FROM x GROUP BY e, key)
SELECT v.conv_id, v.d AS depth, w.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s ON s.d = v.d AND s.key = v.key LEFT JOIN v AS w ON w.d = v.d - 1 AND w.key = list_slice(v.key, 1, v.d - 1)
"""


@query("op13_prefix_trie", SQL)
def op13_prefix_trie(spark, d):
    return prefix_trie(table(spark, d, "conversations"))
