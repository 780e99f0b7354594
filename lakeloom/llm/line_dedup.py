"""Exact line deduplication over levelled sorted runs of line hashes.

A line's key is the line without spaces, tabs, \\n, \\v, \\f, \\r at both ends
and with A-Z lower-cased. A key of at least ``min_chars`` code points that is
held by two or more documents keeps its lines only in the smallest ``doc_id``
holding it (all of them there); every other line stays.

Documents arrive in batches of ascending ``doc_id``. The index is a set of
sorted runs of (key hash, owner): each new batch reduces its lines to distinct
keys, merge-anti-joins them against every run (an equal key is already owned by
a smaller document) and adds what is left as a run of its own. ``fanout`` runs
of one level are compacted into one run of the next, so a batch meets
``O(fanout * log(batches))`` runs. Runs are bucketed and sorted by hash in the
shared folder, so the anti-joins move only the batch.

Defined results: null or empty text is one empty line; a null ``doc_id`` sorts
after all others, and rows sharing a ``doc_id`` are one document; repeated rows
give repeated result rows; an empty table gives no rows. Extra columns are not
read. Key hashes are 128 bits wide.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: F401
from pyspark.sql import functions as F

from .common import scratch, staged
from .registry import query, table

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = (1 << 63) - 1  # a null doc_id sorts last


class SortedRuns:
    """Levelled runs of (h1, h2, owner), each bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _write(self, keys: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (keys.repartition(self.buckets, "h1", "h2").write.format("parquet")
         .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", scratch(self.spark, "run")).saveAsTable(name))
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, keys: DataFrame) -> None:
        """Anti-join one batch's distinct keys (h1, h2, owner) with every run
        and add the rest as a run."""
        for run in self.runs():
            keys = keys.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._push(self._write(keys), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:  # compaction: runs of a level hold disjoint keys
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)
            self.levels[level] = []
            self._push(self._write(merged), level + 1)


def line_key(line):
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with all its columns plus ``__lines`` (array of all lines) and
    ``__dropped`` (positions of the dropped lines, null if none)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    parts = [i / batches for i in range(1, batches)]
    cuts = parts and docs.select(F.col(id_col).cast("long").alias("d")).stat.approxQuantile("d", parts, 0.01)
    batch = sum(((doc > F.lit(min(int(c), NO_ID))).cast("int") for c in cuts), F.lit(0))

    lines = docs.select(doc.alias("d"), F.xxhash64(text).alias("th"), batch.alias("b"),
                        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = (lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
             .select("d", "th", "b", "pos", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.lit("second"), "key").alias("h2")))
    lines = staged(lines, "lines", partition_by="b")

    index = SortedRuns(spark, fanout)
    for b in range(len(cuts) + 1):
        index.add(lines.where(F.col("b") == b).groupBy("h1", "h2").agg(F.min("d").alias("owner")))
    kept = None
    for run in index.runs():
        kept = run if kept is None else kept.unionByName(run)
    dropped = (lines.join(kept.select("h1", "h2", F.col("owner").alias("d")), ["h1", "h2", "d"], "left_anti")
               .groupBy(F.col("d").alias("__d"), F.col("th").alias("__th"))
               .agg(F.collect_set("pos").alias("__dropped")))
    return (docs.withColumn("__d", doc).withColumn("__th", F.xxhash64(text))
            .join(dropped, ["__d", "__th"], "left").drop("__d", "__th")
            .withColumn("__lines", F.split(text, "\n", -1)))


def kept_text(lines="__lines", dropped="__dropped"):
    """The lines that stay, joined by \\n."""
    rest = F.expr(f"transform(array_except(sequence(0, size({lines}) - 1), {dropped}), i -> {lines}[i])")
    return F.array_join(F.when(F.col(dropped).isNull(), F.col(lines)).otherwise(rest), "\n")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ``docs`` with repeated lines gone and ``n_chars`` anew."""
    out = dedup_lines(docs).withColumn("text", kept_text())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = """
WITH l AS (
  SELECT doc_id, n, i, s[i] AS line,
         translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, s, len(s) AS n, unnest(range(1, len(s) + 1)) AS i
        FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS s FROM documents))),
m AS (SELECT k, MIN(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
f AS (SELECT l.doc_id, l.n, l.i, l.line, COALESCE(m.owner < l.doc_id, FALSE) AS gone
      FROM l LEFT JOIN m ON l.k = m.k)
SELECT doc_id, n AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id, n
"""


@query("op10_line_dedup", SQL)
def op10_line_dedup(spark, d):
    out = dedup_lines(table(spark, d, "documents"))
    return out.select("doc_id", F.size("__lines").cast("long").alias("n_lines"),
                      F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped")).cast("long").alias("n_dropped"),
                      F.sha2(kept_text().cast("binary"), 256).alias("kept_sha256"))
