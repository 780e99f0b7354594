"""File sinks, partition guard, dead letters, checkpoints, fan-out and
per-key split writes."""

from __future__ import annotations

import concurrent.futures as cf
import datetime as _dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.core import col_list


def partition_guard(df: DataFrame, partition_by, max_partitions: int = 10000) -> None:
    """Refuse a partitioned write that would create more than
    ``max_partitions`` directories (0 = off). One approximate distinct
    count over the partition columns, before anything is written."""
    cols = col_list(partition_by)
    if not cols or not max_partitions:
        return
    n = df.agg(F.approx_count_distinct(F.struct(*[F.col(c) for c in cols]))).collect()[0][0]
    if n > max_partitions:
        raise ValueError(f"partitionBy {cols} would write about {n} partitions (limit {max_partitions})")


def _writer(df: DataFrame, mode: str, partition_by):
    cols = col_list(partition_by)
    w = df.write.mode(mode)
    if cols:
        # overwrite only the partitions present in this output
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*cols)
    return w


def write_csv(df: DataFrame, path: str, write_header: bool = True, delimiter: str = ",", null_value: str = "",
              partition_by=None, mode: str = "overwrite", max_partitions: int = 10000) -> None:
    partition_guard(df, partition_by, max_partitions)
    (_writer(df, mode, partition_by).option("header", write_header).option("sep", delimiter)
     .option("nullValue", null_value).csv(path))


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", row_group_size: int | None = None,
                  partition_by=None, mode: str = "overwrite", max_partitions: int = 10000) -> None:
    partition_guard(df, partition_by, max_partitions)
    w = _writer(df, mode, partition_by).option("compression", compression.lower())
    if row_group_size:
        w = w.option("parquet.block.size", str(int(row_group_size)))
    w.parquet(path)


def write_json(df: DataFrame, path: str, format: str = "newline_delimited", mode: str = "overwrite") -> None:
    """NDJSON; ``format='array'`` writes one JSON array document. A single
    file has a single writer task, but rows stream through it line by line
    (numbered over range partitions, sorted with spilling) instead of being
    gathered into one in-memory value."""
    if format == "array":
        from lakeloom.core import global_row_number

        rows = df.select(F.to_json(F.struct("*")).alias("j"))
        numbered = global_row_number(rows, ["j"], "__rn")
        lines = numbered.select("__rn", F.concat(F.when(F.col("__rn") == 1, F.lit("[")).otherwise(F.lit(",")), "j").alias("value"))
        tail = df.sparkSession.createDataFrame([(2**62, "]")], "__rn bigint, value string")
        head = df.sparkSession.createDataFrame([(0, "[")], "__rn bigint, value string")
        body = lines.unionByName(tail)
        # an empty input still yields a valid "[" "]" document
        empty = df.limit(1).count() == 0
        out = head.unionByName(tail) if empty else body
        out.coalesce(1).sortWithinPartitions("__rn").select("value").write.mode(mode).text(path)
    else:
        df.write.mode(mode).json(path)


def write_xml(df: DataFrame, path: str, root_element: str = "rows", row_element: str = "row", mode: str = "overwrite") -> None:
    df.write.mode(mode).format("xml").option("rootTag", root_element).option("rowTag", row_element).save(path)


def write_avro(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).format("avro").save(path)


def write_iceberg(df: DataFrame, table: str, mode: str = "overwrite") -> None:
    """Table-format write through the DataFrameWriterV2 API (needs the
    Iceberg runtime jar and a configured catalog)."""
    w = df.writeTo(table).using("iceberg")
    if mode == "overwrite":
        w.createOrReplace()
    else:
        w.append()


def write_delta(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).format("delta").save(path)


def write_cloud(df: DataFrame, store: str, path: str | None = None, bucket: str | None = None, key: str | None = None,
                **options) -> None:
    """Pick the writer by extension on an object-store URI."""
    from lakeloom.sources.readers import resolve_uri

    uri = resolve_uri(store, path, bucket, key)
    low = uri.lower()
    if low.endswith(".csv"):
        write_csv(df, uri, **options)
    elif low.endswith((".json", ".jsonl", ".ndjson")):
        write_json(df, uri, **options)
    else:
        write_parquet(df, uri, **options)


def write_kafka(df: DataFrame, bootstrap: str, topic: str, key_column: str | None = None) -> None:
    kafka_payload(df, key_column).write.format("kafka").option("kafka.bootstrap.servers", bootstrap) \
        .option("topic", topic).save()


def kafka_payload(df: DataFrame, key_column: str | None = None) -> DataFrame:
    """One JSON message per row (``value``) with an optional ``key``."""
    cols = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")]
    if key_column:
        cols.insert(0, F.col(key_column).cast("string").alias("key"))
    return df.select(*cols)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", properties: dict | None = None,
               batchsize: int = 10000) -> None:
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batchsize)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.mode(mode).save()


def dead_letter(df: DataFrame, destination: str, format: str = "json") -> None:
    """Terminal sink for rejected rows, stamped ``__rejected_at``."""
    stamped = df.withColumn("__rejected_at", F.current_timestamp().cast("timestamp_ntz"))
    stamped.write.mode("append").format(format).save(destination)


def write_with_dead_letter(df: DataFrame, declared: dict[str, str], write_clean, dead_letter_path: str,
                           dead_letter_format: str = "parquet") -> DataFrame:
    """Rows whose values cast to the declared types are cast and handed to
    ``write_clean(frame)``; rows with a value that does not cast go, raw,
    to the dead-letter path. The input is persisted once for both writes."""
    from lakeloom.operators.columns import spark_type

    bad = F.lit(False)
    typed = {}
    for c, t in declared.items():
        v = F.col(f"`{c}`").try_cast(spark_type(t))
        typed[c] = v
        bad = bad | (F.col(f"`{c}`").isNotNull() & v.isNull())
    flagged = df.withColumn("__bad", bad).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        clean = flagged.where(~F.col("__bad")).drop("__bad").withColumns(typed)
        write_clean(clean)
        dead_letter(flagged.where("__bad").drop("__bad"), dead_letter_path, dead_letter_format)
        return clean
    finally:
        flagged.unpersist()


def checkpoint_table(df: DataFrame, path: str) -> DataFrame:
    """Write a durable parquet copy and continue from it (cuts lineage; a
    lost executor re-reads the files instead of recomputing)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def fan_out(df: DataFrame, branches: list, max_concurrency: int = 0) -> list:
    """Run independent branch functions ``fn(frame)`` over one persisted
    snapshot concurrently (one SparkSession, several jobs); any branch
    failure fails the whole call."""
    snap = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        workers = max_concurrency or len(branches) or 1
        with cf.ThreadPoolExecutor(max_workers=workers) as pool:
            futures = [pool.submit(b, snap) for b in branches]
            return [f.result() for f in futures]
    finally:
        snap.unpersist()


def split_write(df: DataFrame, key: str, path: str, format: str = "csv", **options) -> None:
    """One output per key value as one job (``partitionBy``), not a loop of
    filtered jobs."""
    w = df.write.mode("overwrite").partitionBy(key).format(format)
    if format == "csv":
        w = w.option("header", options.pop("header", True))
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)


# ---------------------------------------------------------------------------
# PII guard
# ---------------------------------------------------------------------------

def tag_pii(df: DataFrame, columns) -> DataFrame:
    """Mark columns as personal data in the schema metadata (it follows the
    column through select/filter/join and is dropped by hashing)."""
    cols = set(col_list(columns))
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"pii": True}) if c in cols else F.col(f"`{c}`") for c in df.columns])


def pii_guard(df: DataFrame, require_columns=None, allow_pii: bool = False) -> DataFrame:
    """Refuse to write PII-tagged columns unless allowed; required columns
    must exist. Checked on the schema only (no job)."""
    missing = [c for c in col_list(require_columns) if c not in df.columns]
    if missing:
        raise ValueError(f"pii_guard: required columns missing: {missing}")
    tagged = [f.name for f in df.schema.fields if f.metadata.get("pii")]
    if tagged and not allow_pii:
        raise ValueError(f"pii_guard: columns tagged as PII reach the sink unmasked: {tagged}")
    return df


def now_utc() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
