"""Shared pieces of the training-data operators: staged tables in the
session's shared folder, connected components over an edge table."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.core import checkpoint_dir


_watchers: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    for made in _watchers:
        made.append(path)
    return path


@contextmanager
def watching():
    """The list of scratch paths that are made meanwhile."""
    made: list[str] = []
    _watchers.append(made)
    try:
        yield made
    finally:
        _watchers.remove(made)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Jobs run inside hand their rows to Python in batches of at most ``size``."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any more."""
    files = df.inputFiles()
    if files:
        at = files[0].index("/llm/") + len("/llm/")  # scratch() names the folder
        delete_path(df.sparkSession, files[0][:files[0].index("/", at)])


def uniform(*parts) -> "F.Column":
    """Deterministic pseudo-random double in [0, 1) from the given columns."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` for every node of ``edges(a, b)``; the component
    id is its smallest node. Alternates large-star and small-star steps (a
    grouped minimum and an equi-join each) until the edge set is stable; every
    round is staged in the shared folder, and the driver sees two numbers a
    round. An empty edge table gives an empty result; self loops and repeated
    edges are allowed."""
    spark = edges.sparkSession

    def sign(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return (both.where("v > u").join(low, "u")
                .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .where("u <> v").distinct(), "edges")
    before = sign(e)
    while before[0]:
        e = staged(small_star(large_star(e)), "edges")
        after = sign(e)
        if after == before:
            break
        before = after
    # every component is now a star around its smallest node
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct())
