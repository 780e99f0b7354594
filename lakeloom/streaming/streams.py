"""Structured Streaming variants of the batch operators.

Sources are file streams (or any ``readStream``); progress and state live
in the checkpoint location, which gives exactly-once file sinks and lets a
restarted query resume where it stopped. ``trigger(availableNow=True)``
drains what is there and stops — the streaming form of an incremental
load."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import DateType, DoubleType, FloatType, IntegralType, StringType, StructType, TimestampNTZType, TimestampType

from lakeloom.core import col_list


def stream_files(spark: SparkSession, path: str, schema: StructType, format: str = "parquet",
                 max_files_per_trigger: int | None = None, base_path: str | None = None) -> DataFrame:
    r = spark.readStream.format(format).schema(schema)
    if base_path:
        r = r.option("basePath", base_path)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(path)


def stream_incremental(spark: SparkSession, source_path: str, schema: StructType, sink_path: str, checkpoint: str,
                       format: str = "parquet"):
    """Load only files not yet processed (tracked in ``checkpoint``), write
    them to ``sink_path`` and stop when caught up."""
    q = (stream_files(spark, source_path, schema, format).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).option("path", sink_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def event_time(df: DataFrame, ts_column: str) -> DataFrame:
    """Watermarks need an instant (TIMESTAMP); naive timestamps are read as
    UTC wall-clock."""
    if dict(df.dtypes)[ts_column] == "timestamp_ntz":
        return df.withColumn(ts_column, F.col(ts_column).cast("timestamp"))
    return df


def stream_time_bin(events: DataFrame, ts_column: str, keys=None, window: str = "5 minutes", slide: str | None = None,
                    watermark: str = "10 minutes", value_column: str | None = None) -> DataFrame:
    """Tumbling (or sliding) window counts/sums per key with a watermark;
    append mode emits each window once it can no longer change."""
    w = F.window(F.col(ts_column), window, slide) if slide else F.window(F.col(ts_column), window)
    aggs = [F.count(F.lit(1)).alias("events")]
    if value_column:
        aggs.append(F.sum(value_column).alias(f"sum_{value_column}"))
    return (event_time(events, ts_column).withWatermark(ts_column, watermark).groupBy(w.alias("window"), *col_list(keys)).agg(*aggs)
            .select(F.col("window.start").cast("timestamp_ntz").alias("bin_start"),
                    F.col("window.end").cast("timestamp_ntz").alias("bin_end"), *col_list(keys),
                    *[a for a in ["events"] + ([f"sum_{value_column}"] if value_column else [])]))


def stream_sessionize(events: DataFrame, ts_column: str, keys, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions per key: a session closes after ``gap`` without events (an
    event exactly ``gap`` later stays in the session)."""
    s = F.session_window(F.col(ts_column), gap)
    return (event_time(events, ts_column).withWatermark(ts_column, watermark).groupBy(*col_list(keys), s.alias("session"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select(*col_list(keys), F.col("session.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("session.end").cast("timestamp_ntz").alias("session_end"), "events"))


def stream_dedupe(events: DataFrame, keys, ts_column: str, watermark: str = "1 hour") -> DataFrame:
    """Drop repeated keys seen within the watermark delay (bounded state)."""
    return event_time(events, ts_column).withWatermark(ts_column, watermark).dropDuplicatesWithinWatermark(col_list(keys))


def _order_key(df: DataFrame, column: str):
    """The order column as a value that state can hold: a number or a text."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, TimestampType):
        return F.unix_micros(c), "long"
    if isinstance(kind, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")), "long"
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("long"), "long"
    if isinstance(kind, IntegralType):
        return c.cast("long"), "long"
    if isinstance(kind, (FloatType, DoubleType)):
        return c.cast("double"), "double"
    if isinstance(kind, StringType):
        return c, "string"
    raise ValueError(f"stream_upsert: {column} is no order ({kind.simpleString()})")


def _newest(expire_ms: int | None):
    """Per key: the newest change so far is kept as state; a batch that brings a newer one
    emits it, older ones are dropped."""

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else None
        best, row = known, None
        for frame in frames:
            for at, tie, i in zip(frame["__order"], frame["__tie"], range(len(frame))):
                at = at.item() if hasattr(at, "item") else at
                if at == at and (best is None or (at, int(tie)) > tuple(best)):
                    best, row = (at, int(tie)), frame.iloc[[i]]
        if row is not None:
            state.update(best)
            if expire_ms:
                state.setTimeoutDuration(expire_ms)
            yield row
        elif known is not None and expire_ms:
            state.setTimeoutDuration(expire_ms)

    return run


def _newest_of_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the newest change so far as the state of a streaming aggregate, without a
    Python call per key. ``__seen`` is the time of the micro-batch, one for all its rows
    (a replay has it again): what an earlier batch brought is not emitted anew, and of equal
    changes the earlier one stays."""
    if isinstance(rows.schema["__order"].dataType, DoubleType):
        rows = rows.where(~F.isnan("__order"))
    rest = [c for c in rows.columns if c not in keys]
    seen = rows.withColumn("__seen", F.current_timestamp())
    order = F.struct("__order", "__tie", -F.unix_micros("__seen"))
    best = seen.groupBy(*keys).agg(F.max_by(F.struct(*rest, "__seen"), order).alias("__best"))
    best = best.where(F.col("__best")["__seen"] == F.current_timestamp())
    return best.select(*[F.col(c) if c in keys else F.col("__best")[c].alias(c) for c in rows.columns])


def stream_upsert(changes: DataFrame, log_path: str, checkpoint: str, keys, order_column: str, expire_hours: float | None = None,
                  trigger_once: bool = True):
    """Follow a change stream and store, per micro-batch, the changes that are the newest
    of their key so far.

    The newest change of every key, by (order value, row hash), is keyed state in the
    checkpoint (with ``expire_hours`` only those two values are), so a change that comes late, in whatever batch, is dropped; rows without an order value or
    key are dropped too. ``expire_hours`` bounds the state of a running stream (not of one
    that is drained) to keys changed that recently; a late change of another key is then
    stored, and loses when the log is read. Batches lie
    under the query's own id from its checkpoint: a replay overwrites its batch, and other
    streams on the same log lose nothing. ``upserted`` gives the current rows,
    ``compact_changes`` folds the log."""
    if expire_hours and trigger_once:
        raise ValueError("stream_upsert: expire_hours needs a running stream (trigger_once=False)")
    ks = col_list(keys)
    order, kind = _order_key(changes, order_column)
    rows = changes.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*ks, order_column]])) \
        .withColumn("__order", order).withColumn("__tie", F.xxhash64(*changes.columns))
    if expire_hours:  # a timeout needs a state of one's own
        found = rows.groupBy(*ks).applyInPandasWithState(
            _newest(int(expire_hours * 3_600_000)), rows.schema, f"o {kind}, t long", "update", GroupStateTimeout.ProcessingTimeTimeout)
    else:
        found = _newest_of_batch(rows, ks)

    def store(batch: DataFrame, batch_id: int) -> None:
        with_id = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
        batch.write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/stream={json.loads(with_id)['id']}/batch={batch_id}")

    return _drain(found.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint), trigger_once)


def _folded(log: DataFrame, keys: list[str]) -> DataFrame:
    """The newest stored change of every key: a grouped maximum."""
    rest = [c for c in log.columns if c not in (*keys, "stream", "batch")]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__order", "__tie")).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def upserted(target: DataFrame | None, log_path: str, keys, spark: SparkSession, delete_column: str | None = None,
             delete_value: str = "delete") -> DataFrame:
    """``target`` with the stored changes applied, the newest change of a key."""
    from lakeloom.sources import tables

    log = _folded(spark.read.parquet(log_path), col_list(keys)).drop("__order", "__tie")
    return tables.upsert_rows(target, log, keys, delete_column, delete_value)


def compact_changes(spark: SparkSession, log_path: str, keys) -> None:
    """Fold the log: one row per key in a folder of its own, written before the folders it
    replaces are deleted. Reading takes the newest change per key, so a run that stops in
    between leaves the result as it is; batches that arrive meanwhile stay."""
    root = log_path.rstrip("/")
    log = spark.read.parquet(root)
    done = [(r[0], r[1]) for r in log.select("stream", "batch").distinct().collect()]  # one row per stored batch
    _folded(log, col_list(keys)).write.parquet(f"{root}/stream=folded-{uuid.uuid4().hex}/batch=0")
    for stream, batch in done:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/stream={stream}/batch={batch}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stream_changes(spark: SparkSession, snapshot_path: str, keys, sink_path: str, checkpoint: str, trigger_once: bool = True):
    """A change feed that resumes: the snapshots' files are a file stream, so the checkpoint
    knows which snapshots are done. Each new one is compared with the snapshot before it and
    its changes are stored under its time; a replay or a rewritten snapshot overwrites them."""
    from lakeloom.sources import tables

    schema = spark.read.parquet(snapshot_path).schema

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        times = sorted(r[0] for r in batch.select(tables.SNAPSHOT).distinct().collect())  # one row per new snapshot
        every = tables.snapshots(session, snapshot_path)
        for time in times:
            at = F.lit(time).cast("timestamp_ntz")
            before = every.where(F.col(tables.SNAPSHOT) < at).agg(F.max(tables.SNAPSHOT)).first()[0]
            new = every.where(F.col(tables.SNAPSHOT) == at).drop(tables.SNAPSHOT)
            old = new.limit(0) if before is None else tables.read_as_of(session, snapshot_path, before)
            stamp = F.date_format(at, "yyyyMMddHHmmssSSSSSS")
            name = session.range(1).select(stamp).first()[0]
            tables.change_feed(old, new, keys).withColumn("changed_at", at).write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/at={name}")

    stream = spark.readStream.schema(schema).parquet(snapshot_path).select(tables.SNAPSHOT)
    return _drain(stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), trigger_once)


def _drain(writer, trigger_once: bool):
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    q = writer.start()
    if trigger_once:
        q.awaitTermination()
    return q


def stream_quality_split(events: DataFrame, predicate, passed_path: str, rejected_path: str, checkpoint: str,
                         trigger_once: bool = True):
    """Write passing and rejected rows of each micro-batch from ONE persisted
    batch, to a folder per batch id: a replay overwrites instead of adding."""
    p = F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False))

    def split(batch: DataFrame, batch_id: int) -> None:
        b = batch.withColumn("__ok", p).persist()
        try:
            for path, rows in ((passed_path, b.where("__ok")), (rejected_path, b.where("NOT __ok"))):
                rows.drop("__ok").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
        finally:
            b.unpersist()

    return _drain(events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint), trigger_once)


def stream_enrich(events: DataFrame, dim: DataFrame, left_key, right_key=None, how: str = "left") -> DataFrame:
    """Stream–static join to a dimension (AQE does not re-plan streams, so
    the dimension is broadcast only when it is marked small by the caller
    through Spark's size estimate)."""
    lk, rk = col_list(left_key), col_list(right_key) or col_list(left_key)
    cond = None
    for a, b in zip(lk, rk):
        c = events[a] == dim[b]
        cond = c if cond is None else cond & c
    return events.join(dim, cond, how)


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain a streaming frame into Parquet files (append mode, exactly once) and
    return them as a batch frame."""
    _drain(df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint), True)
    return df.sparkSession.read.schema(df.schema).parquet(path)
