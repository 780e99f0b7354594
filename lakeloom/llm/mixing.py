"""Mixing sources to target weights by a multivariate-hypergeometric splitting
tree, in DataFrame functions only.

Every document has a size in words. The words of a source lie on a line in a
hashed document order; the line is cut into blocks of ``block_words`` words (a
block may begin and end inside a document). A source's target gives its exact
quota of blocks over at most two passes, and one partial block or the source's
short last block for the rest, so the words taken equal the rounded target.

The quotas of all sources form the root of a binary tree. A node hands half of
its blocks to its left child: the counts per source are drawn from the
multivariate hypergeometric distribution, source by source, by inverting the
exact probabilities (only counts beyond 8 standard deviations are left out,
below double precision). After ``depth`` levels (as many as leave about
``SHARD_BLOCKS`` blocks a shard) each leaf is an output shard with its quota per
source. Shards then draw disjoint ranges of a permutation of each source's blocks
(their rank by a hash), and each shard orders its pieces by a hash.

Targets: sources by code point, null last, weigh ``weights`` cyclically and share
``share`` times all words; a target stops at ``max_passes`` (2) times its
source's size and the excess is shared again by weight (water filling).

Defined results: null or empty text has size 0 and takes nothing; a null source
is a source of its own; equal rows are separate documents that may be taken
differently, but reruns give the same rows; an empty table gives no rows; extra
columns are not read. The word line is summed over hash buckets of about 1,024
documents, so no source is ordered in one task; the only unpartitioned windows
and the tree's root hold one row or entry per source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, uniform
from .registry import query, table

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DOCS = 1024
SHARD_BLOCKS = 4096


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, passes: int = 2) -> DataFrame:
    """``(source, n_docs, source_size, rank, target)``, a row for each source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * passes)
    every = Window.partitionBy()
    total, all_w = F.sum("source_size").over(every) * F.lit(share), F.sum("w").over(every)
    # Sources reach their cap in the order of cap / weight.
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    caps, ws = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = (per.withColumn("total", total).withColumn("all_w", all_w)
           .withColumn("capped", F.col("cap") * (F.col("all_w") - ws) <= F.col("w") * (F.col("total") - caps)))
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("w") * left / free))
    return per.select("source", "n_docs", "source_size", "rank", target.alias("target"))


def bind(value, use):
    """``use(value)`` with the value computed once: higher-order functions would
    otherwise compute it again wherever it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(n_all, n_marked, n_drawn, u):
    """Number of marked among ``n_drawn`` of ``n_all`` without replacement, by
    inversion of ``u``: the probabilities follow from their ratio."""
    a, k, n = (x.cast("double") for x in (n_all, n_marked, n_drawn))
    mean = n * k / a
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / a) * (a - n) / F.greatest(F.lit(1.0), a - 1)))
    low = F.greatest(F.lit(0.0), n + k - a, F.floor(mean - 8 * sd - 8).cast("double")).cast("long")
    high = F.least(k, n, F.ceil(mean + 8 * sd + 8).cast("double")).cast("long")
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("at"))

    def following(p, w, x):
        x = x.cast("double")
        return w * (p["k"] - x) * (p["n"] - x) / ((x + 1) * (p["a"] - p["k"] - p["n"] + x + 1))

    def step(p, s, x, at):
        return F.struct(following(p, s["w"], x).alias("w"), (s["sum"] + s["w"]).alias("sum"), at.alias("at"))

    def invert(p):
        total = F.aggregate(p["span"], start, lambda s, x: step(p, s, x, s["at"]))["sum"]
        return bind(total * p["u"], lambda goal: F.aggregate(
            p["span"], start, lambda s, x: step(p, s, x, F.when(s["sum"] <= goal, x).otherwise(s["at"])))["at"])

    given = F.struct(F.sequence(low, high).alias("span"), a.alias("a"), k.alias("k"), n.alias("n"), u.alias("u"))
    return F.when(n_all <= 0, F.lit(0).cast("long")).otherwise(bind(given, invert))


def split_quotas(targets: DataFrame, depth: int, seed: int) -> DataFrame:
    """``(rank, ends)``: for each source the cumulative quotas of the 2**depth
    leaves, from ``targets`` (rank, quota)."""
    item = "struct<rank:bigint,q:bigint>"
    node = targets.groupBy().agg(F.sort_array(F.collect_list(
        F.struct(F.col("rank").cast("long").alias("rank"), F.col("quota").alias("q")))).alias("quotas"))
    node = node.withColumn("node", F.lit(0).cast("long"))
    for level in range(depth):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, x: s + x["q"])
        node = node.withColumn("total", total)

        at_level = F.lit(level)

        def draw(s, x):
            drawn = hypergeometric(s["all"], x["q"], s["n"], uniform(F.lit(seed), at_level, F.col("node"), x["rank"]))
            return bind(drawn, lambda got: F.struct(
                (s["all"] - x["q"]).alias("all"), (s["n"] - got).alias("n"),
                F.concat(s["out"], F.array(F.struct(x["rank"].alias("rank"), got.alias("q")))).alias("out")))

        left = F.aggregate("quotas", F.struct(F.col("total").alias("all"), F.expr("total div 2").alias("n"),
                                              F.array().cast(f"array<{item}>").alias("out")), draw)["out"]
        node = node.withColumn("left", left)
        right = F.zip_with("quotas", "left", lambda x, y: F.struct(x["rank"].alias("rank"), (x["q"] - y["q"]).alias("q")))
        node = (node.withColumn("right", right)
                .select(F.posexplode(F.array("left", "right")).alias("side", "quotas"), "node")
                .select("quotas", (F.col("node") * 2 + F.col("side")).alias("node")))
    leaves = node.select("node", F.explode("quotas").alias("x")).select("node", "x.rank", "x.q")
    leaves = leaves.withColumn("end", F.sum("q").over(Window.partitionBy("rank").orderBy("node")))
    return leaves.groupBy("rank").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


def mix(rows: DataFrame, block_words: int = 4096, depth: int | None = None, seed: int = 17,
        weights=(5, 2, 1), share: float = 1.5):
    """``rows``: a stored table (rid, key, source, size), key a hash that orders
    the documents of a source. Returns (pieces, targets). A piece is ``words``
    words of document ``rid`` from word ``start`` in pass ``pass``, at place
    ``ordering`` of shard ``shard``; shard, pass and start are unique together
    with rid."""
    w = F.lit(block_words).cast("long")
    targets = source_targets(rows, weights, share)
    targets = (targets.withColumn("blocks", F.expr(f"source_size div {block_words}"))
               .withColumn("quota", F.least(F.floor(F.col("target") / w), F.col("blocks") * 2))
               .withColumn("rest", F.round("target").cast("long") - F.col("quota") * w))
    targets = staged(targets, "targets")
    if depth is None:
        drawn = targets.agg(F.sum("quota")).first()[0] or 0
        depth = max(4, math.ceil(math.log2(max(1, drawn / SHARD_BLOCKS))))
    dims = staged(targets.join(split_quotas(targets, depth, seed), "rank"), "quotas")

    # Start of each document on its source's line: buckets in hash order, then inside the bucket.
    d = rows.join(targets.select(F.col("source").alias("s"), "rank", "n_docs"), F.col("source").eqNullSafe(F.col("s")))
    n_buckets = F.ceil(F.col("n_docs") / BUCKET_DOCS)
    d = d.withColumn("bucket", F.floor(uniform(F.lit(seed), "key") * n_buckets)).select("rid", "key", "rank", "bucket", "size")
    sums = d.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("rank", "bucket").orderBy(F.xxhash64(F.lit(seed), "key"), "rid")
    d = (d.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
         .join(sums, ["rank", "bucket"])
         .select("rid", "rank", "size", (F.col("ahead") + F.col("upto") - F.col("size")).alias("at")).where("size > 0"))

    # Document pieces by block, then the copies of the block that were drawn.
    p = d.withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")))
    p = (p.withColumn("from", F.greatest("at", F.col("block") * w))
         .withColumn("to", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * w))
         .join(dims.select("rank", "blocks", "quota", "rest", "source_size", "ends"), "rank"))
    # A block's place is its rank by a hash among the source's blocks: buckets in hash order, then inside the bucket.
    b = p.where(F.col("block") < F.col("blocks")).select("rank", "block", "blocks").distinct()
    b = b.withColumn("slot", F.floor(uniform(F.lit(seed + 1), "rank", "block") * F.ceil(F.col("blocks") / BUCKET_DOCS)))
    held = b.groupBy("rank", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("rank").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("rank", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    among = Window.partitionBy("rank", "slot").orderBy(uniform(F.lit(seed + 1), "rank", "block"), "block")
    places = b.withColumn("nth", F.row_number().over(among)).join(held, ["rank", "slot"]) \
        .select("rank", "block", (F.col("before") + F.col("nth") - 1).alias("place"))
    p = p.join(places, ["rank", "block"], "left")
    place = F.col("place")
    tail = F.col("block") >= F.col("blocks")
    tail_words = F.col("source_size") - F.col("blocks") * w
    spare = F.when(F.col("quota") == F.col("blocks") * 2, F.col("rest")).otherwise(F.lit(0))
    p = p.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    p = p.withColumn("draw", F.when(tail, F.lit(None).cast("long")).otherwise(place + F.col("pass") * F.col("blocks")))
    block_taken = (F.when(tail, F.greatest(F.lit(0), F.least(tail_words, spare - F.col("pass") * tail_words)))
                   .when(F.col("draw") < F.col("quota"), w)
                   .when(F.col("draw") == F.col("quota"), F.col("rest")).otherwise(F.lit(0)))
    p = p.withColumn("words", F.least(F.col("to"), F.col("block") * w + block_taken) - F.col("from")).where("words > 0")
    drawn_shard = F.size(F.filter("ends", lambda e: e <= F.col("draw")))
    shard = F.when(F.col("draw") < F.col("quota"), drawn_shard).otherwise(
        F.pmod(F.xxhash64(F.lit(seed), "rank", "pass"), F.lit(1 << depth)))
    p = p.select("rid", "pass", (F.col("from") - F.col("at")).alias("start"), "words", shard.cast("int").alias("shard"))
    return p.withColumn("ordering", F.xxhash64(F.lit(seed), "shard", "rid", "pass", "start")), targets


def document_rows(docs: DataFrame) -> DataFrame:
    """Stored (rid, key, doc_id, source, size) of every row of ``docs``."""
    key = F.xxhash64("doc_id", "source", "text")
    return staged(docs.select(F.monotonically_increasing_id().alias("rid"), key.alias("key"), "doc_id", "source",
                              word_count(F.col("text")).alias("size")), "sizes")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixture, a row for each document and pass with the
    words that were taken (cut out of the text with the space around them) and
    ``n_chars`` anew, shard after shard in the shard's own order. A document
    taken whole keeps its text as it is."""
    stored = staged(docs.withColumn("__rid", F.monotonically_increasing_id()), "mix_docs")
    rows = staged(stored.select(F.col("__rid").alias("rid"), F.xxhash64("doc_id", "source", "text").alias("key"), "source",
                                word_count(F.col("text")).alias("size")), "sizes")
    pieces, _ = mix(rows)
    taken = pieces.groupBy("rid", "pass").agg(
        F.sort_array(F.collect_list(F.struct("start", "words"))).alias("__cuts"), F.sum("words").alias("__words"),
        F.min(F.struct("ordering", "shard")).alias("__at"))
    taken = taken.join(rows.select("rid", F.col("size").alias("__size")), "rid").withColumnRenamed("rid", "__rid").drop("pass")
    # every match is a word with the space around it: together they are the text
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.transform("__cuts", lambda c: F.array_join(
        F.slice(words, (c["start"] + 1).cast("int"), c["words"].cast("int")), "")), "")
    out = stored.join(taken, "__rid").withColumn(
        "text", F.when(F.col("__words") == F.col("__size"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    out = out.repartition(F.col("__at.shard")).sortWithinPartitions("__at.shard", "__at.ordering")
    return out.select(*docs.columns)


@query("op2_mix_sources")
def op2_mix_sources(spark, d):
    rows = document_rows(table(spark, d, "documents").select("doc_id", "source", "text"))
    pieces, targets = mix(rows.select("rid", "key", "source", "size"))
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"), F.countDistinct("shard").alias("n_shards"))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return (rows.join(t, F.col("source").eqNullSafe(F.col("s"))).join(taken, "rid", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    F.coalesce("n_shards", F.lit(0)).cast("int").alias("n_shards")))
