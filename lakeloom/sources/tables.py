"""Table modes, point-in-time reads and change feeds as DataFrame operations
over plain Parquet.

``upsert_rows``, ``merge_rows`` and ``change_feed`` work on frames: what they
return can be written with any Spark writer, or handed to ``MERGE INTO`` where a
table format is on the classpath. Snapshots are one Parquet dataset partitioned by
the time of the snapshot."""

from __future__ import annotations

import datetime as _dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.core import checkpoint_dir, col_list

SNAPSHOT = "snapshot_time"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Only a missing path counts as no data; any other error is raised."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _check_keys(source: DataFrame, keys: list[str], on_duplicate: str, order_column: str | None) -> DataFrame:
    """Duplicate source keys: ``error`` raises, ``last`` keeps the row with
    the greatest ``order_column`` per key, ``all`` keeps every row."""
    if on_duplicate == "all":
        return source
    if on_duplicate == "last":
        if not order_column:
            raise ValueError("on_duplicate='last' needs an order column")
        w = Window.partitionBy(*keys).orderBy(F.col(order_column).desc_nulls_last())
        return source.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    dup = source.groupBy(*keys).count().where("count > 1").limit(1).count()
    if dup:
        raise ValueError(f"source has duplicate keys on {keys}; pass on_duplicate='last' with an order column")
    return source


def _live(source: DataFrame, delete_column: str | None, delete_value: str) -> DataFrame:
    """Source rows that are not flagged for delete, without the flag."""
    if not delete_column:
        return source
    flag = F.col(delete_column)
    return source.where(flag.isNull() | (flag.cast("string") != delete_value)).drop(delete_column)


def upsert_rows(target: DataFrame | None, source: DataFrame, conflict_columns, delete_column: str | None = None,
                delete_value: str = "delete", on_duplicate: str = "all", order_column: str | None = None) -> DataFrame:
    """Rows of the upserted table: target rows whose key is not in the source,
    plus source rows not flagged for delete (flag column dropped). Without a
    target (first load) only the latter."""
    keys = col_list(conflict_columns)
    if not keys:
        raise ValueError("upsert: conflict columns are required")
    src = _check_keys(source, keys, on_duplicate, order_column)
    live = _live(src, delete_column, delete_value)
    if target is None:
        return live
    kept = target.join(src.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(live, allowMissingColumns=True).select(*target.columns)


def merge_rows(target: DataFrame | None, source: DataFrame, conflict_columns, delete_column: str | None = None,
               delete_value: str = "delete") -> DataFrame:
    """MERGE INTO semantics in one full outer join: matched rows take the
    source's value for every column the source carries (others keep the
    target's), unmatched source rows are inserted, matched rows flagged for
    delete are removed, flagged unmatched rows are skipped. Without a target
    (first load) the unflagged source rows."""
    keys = col_list(conflict_columns)
    if not keys:
        raise ValueError("merge: conflict columns are required")
    _check_keys(source, keys, "error", None)
    if target is None:
        return _live(source, delete_column, delete_value)
    t, s = target.alias("t"), source.alias("s")
    cond = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    j = t.join(s.withColumn("__src", F.lit(True)), cond, "full")
    in_t, in_s = F.col(f"t.{keys[0]}").isNotNull(), F.col("__src").isNotNull()
    flagged = (F.col(f"s.{delete_column}").cast("string") == delete_value) if delete_column else F.lit(False)
    flagged = F.coalesce(flagged, F.lit(False))
    out = j.where(~(in_s & flagged))
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c))
        elif c in source.columns:
            cols.append(F.when(in_s, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.col(f"t.{c}").alias(c))
    return out.select(*cols)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``overwrite``, ``append``, or ``truncate``: overwrite that keeps the
    columns and types the table has."""
    if mode == "truncate" and path_exists(df.sparkSession, path):
        df = df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in df.sparkSession.read.parquet(path).dtypes])
    elif mode not in ("overwrite", "append", "truncate"):
        raise ValueError(f"write_table: unknown mode {mode!r} (overwrite | append | truncate)")
    df.write.mode("append" if mode == "append" else "overwrite").parquet(path)


def _rewrite(spark: SparkSession, path: str, change) -> None:
    """Replace the table at ``path`` by ``change(current or None)``. The new rows
    are stored in the shared folder first, because the table is read by them."""
    new = change(spark.read.parquet(path) if path_exists(spark, path) else None)
    stored = f"{checkpoint_dir(spark).rstrip('/')}/rewrite-{uuid.uuid4().hex}"
    new.write.parquet(stored)
    spark.read.schema(new.schema).parquet(stored).write.mode("overwrite").parquet(path)


def upsert_table(df: DataFrame, path: str, conflict_columns, delete_column: str | None = None, **kw) -> None:
    _rewrite(df.sparkSession, path, lambda t: upsert_rows(t, df, conflict_columns, delete_column, **kw))


def merge_table(df: DataFrame, path: str, conflict_columns, delete_column: str | None = None, **kw) -> None:
    _rewrite(df.sparkSession, path, lambda t: merge_rows(t, df, conflict_columns, delete_column, **kw))


def write_snapshot(df: DataFrame, path: str, when: _dt.datetime) -> None:
    """Store the rows of ``df`` as the snapshot of ``when``; repeated, it replaces it."""
    stamp = F.lit(when.isoformat(sep=" ")).alias(SNAPSHOT)
    df.select("*", stamp).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SNAPSHOT).parquet(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots with their time (a TIMESTAMP_NTZ partition column)."""
    df = spark.read.parquet(path)
    return df.withColumn(SNAPSHOT, F.col(SNAPSHOT).cast("timestamp_ntz"))


def _newest(all_rows: DataFrame, as_of: _dt.datetime | None) -> _dt.datetime | None:
    until = all_rows if as_of is None else all_rows.where(F.col(SNAPSHOT) <= F.lit(as_of).cast("timestamp_ntz"))
    return until.agg(F.max(SNAPSHOT)).first()[0]  # one value


def read_as_of(spark: SparkSession, path: str, as_of_timestamp: _dt.datetime | None = None) -> DataFrame:
    """The newest snapshot not after the given time (or of all)."""
    rows = snapshots(spark, path)
    when = _newest(rows, as_of_timestamp)
    return rows.where(F.col(SNAPSHOT) == F.lit(when).cast("timestamp_ntz")).drop(SNAPSHOT)


def change_feed(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Row-level changes between two snapshots: insert / delete /
    update_preimage / update_postimage in ``change_type`` (NULL-safe keys,
    an update is exploded into its pre and post image)."""
    ks = col_list(keys)
    cols = [c for c in new.columns]
    o, n = old.alias("o"), new.alias("n")
    cond = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ks])
    j = o.withColumn("__o", F.lit(True)).alias("o").join(n.withColumn("__n", F.lit(True)).alias("n"), cond, "full")
    old_row = F.struct(*[F.col(f"o.{c}").alias(c) for c in cols])
    new_row = F.struct(*[F.col(f"n.{c}").alias(c) for c in cols])
    in_o, in_n = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in cols])
    acts = (F.when(in_o & in_n, F.array(F.struct(F.lit("update_preimage").alias("t"), old_row.alias("r")),
                                        F.struct(F.lit("update_postimage").alias("t"), new_row.alias("r"))))
            .when(in_n, F.array(F.struct(F.lit("insert").alias("t"), new_row.alias("r"))))
            .otherwise(F.array(F.struct(F.lit("delete").alias("t"), old_row.alias("r")))))
    changed = j.where(~(in_o & in_n & same))
    return changed.select(F.explode(acts).alias("a")).select("a.r.*", F.col("a.t").alias("change_type"))


def read_changes(spark: SparkSession, path: str, keys, since: _dt.datetime, until: _dt.datetime | None = None) -> DataFrame:
    """Changes between the snapshots of two times."""
    return change_feed(read_as_of(spark, path, since), read_as_of(spark, path, until), keys)


def read_changes_incremental(spark: SparkSession, path: str, keys, last: _dt.datetime | None,
                             inserts_only: bool = False) -> tuple[DataFrame, _dt.datetime | None]:
    """(changes since the snapshot of ``last``, time of the newest snapshot). The
    caller keeps the time once its sink has committed; with no newer snapshot the
    feed is empty, with ``last`` None every row is an insert."""
    rows = snapshots(spark, path)
    now = _newest(rows, None)
    new = read_as_of(spark, path, now)
    old = new.limit(0) if last is None else read_as_of(spark, path, last)
    feed = change_feed(old, new, keys)
    return (feed.where("change_type = 'insert'") if inserts_only else feed), now
