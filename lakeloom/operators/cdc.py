"""Change detection, slowly changing dimensions and incremental loads.

Each operator is at most one shuffle join on the natural key between the
new snapshot and the previous one; AQE splits skewed key partitions."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.core import col_list
from lakeloom.sources.tables import path_exists


def _and(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs)


def _or(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs)


def _keys(df, prev, keys, a="c", b="p") -> Column:
    return _and([F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys])


def cdc_diff(current: DataFrame, previous: DataFrame, natural_key, compare_columns, reject_unchanged: bool = True) -> DataFrame:
    """Keys, current columns and ``change_type`` ∈ inserted / deleted /
    updated / unchanged (NULL-safe comparison). Deleted rows carry NULL
    non-key values; the first key column decides presence."""
    keys, cmp = col_list(natural_key), col_list(compare_columns)
    if not keys:
        raise ValueError("cdc_diff: natural key is required")
    if not cmp:
        raise ValueError("cdc_diff: compare columns are required")
    c, p = current.alias("c"), previous.alias("p")
    j = c.join(p, _keys(c, p, keys), "full")
    k0 = keys[0]
    diff = _or([~F.col(f"c.{x}").eqNullSafe(F.col(f"p.{x}")) for x in cmp])
    ct = (F.when(F.col(f"p.{k0}").isNull(), "inserted").when(F.col(f"c.{k0}").isNull(), "deleted")
          .when(diff, "updated").otherwise("unchanged"))
    out = j.select(*[F.coalesce(F.col(f"c.{k}"), F.col(f"p.{k}")).alias(k) for k in keys],
                   *[F.col(f"c.{x}") for x in current.columns if x not in keys], ct.alias("change_type"))
    return out.where(F.col("change_type") != "unchanged") if reject_unchanged else out


def scd1(current: DataFrame, previous: DataFrame, natural_key) -> DataFrame:
    """Current rows ∪ previous rows whose key no longer appears."""
    keys = col_list(natural_key)
    gone = previous.join(current.select(*keys), keys, "left_anti") if keys else previous
    return current.unionByName(gone, allowMissingColumns=True)


def upsert_delta(current: DataFrame, previous: DataFrame, natural_key, compare_columns=None) -> DataFrame:
    """Current rows that are new or changed; without compare columns only
    new keys."""
    keys, cmp = col_list(natural_key), col_list(compare_columns)
    c, p = current.alias("c"), previous.alias("p")
    j = c.join(p, _keys(c, p, keys), "left")
    cond = F.col(f"p.{keys[0]}").isNull()
    if cmp:
        cond = cond | _or([~F.col(f"c.{x}").eqNullSafe(F.col(f"p.{x}")) for x in cmp])
    return j.where(cond).select("c.*")


def scd2(current: DataFrame, history: DataFrame, natural_key, compare_columns, valid_from: str = "valid_from",
         valid_to: str = "valid_to", is_current: str = "is_current", as_of: _dt.datetime | None = None) -> DataFrame:
    """Type-2 history: closed history kept; open rows that are unchanged
    kept; changed or vanished open rows closed at ``as_of``; new or changed
    current rows opened at ``as_of``.

    One full outer join of the current snapshot against the open rows, then
    an ``explode`` of (close, open) actions — no second pass over history."""
    keys, cmp = col_list(natural_key), col_list(compare_columns)
    if not cmp:
        raise ValueError("scd2: compare columns are required")
    ts = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
    hist_cols = history.columns
    data_cols = [x for x in hist_cols if x not in (valid_from, valid_to, is_current)]
    closed = history.where(~F.col(is_current))
    open_ = history.where(F.col(is_current))
    c, p = current.alias("c"), open_.alias("p")
    j = c.join(p, _keys(c, p, keys), "full")
    k0 = keys[0]
    has_c, has_p = F.col(f"c.{k0}").isNotNull(), F.col(f"p.{k0}").isNotNull()
    same = _and([F.col(f"c.{x}").eqNullSafe(F.col(f"p.{x}")) for x in cmp])
    prev_row = F.struct(*[F.col(f"p.{x}").alias(x) for x in data_cols], F.col(f"p.{valid_from}").alias(valid_from),
                        F.col(f"p.{valid_to}").alias(valid_to), F.col(f"p.{is_current}").alias(is_current))
    closed_row = F.struct(*[F.col(f"p.{x}").alias(x) for x in data_cols], F.col(f"p.{valid_from}").alias(valid_from),
                          ts.alias(valid_to), F.lit(False).alias(is_current))
    new_row = F.struct(*[(F.col(f"c.{x}") if x in current.columns else F.lit(None)).alias(x) for x in data_cols],
                       ts.alias(valid_from), F.lit(None).cast("timestamp_ntz").alias(valid_to), F.lit(True).alias(is_current))
    actions = (F.when(has_c & has_p & same, F.array(prev_row))
               .when(has_c & has_p, F.array(closed_row, new_row))
               .when(has_p, F.array(closed_row))
               .otherwise(F.array(new_row)))
    changed = j.select(F.explode(actions).alias("r")).select("r.*")
    return closed.select(*hist_cols).unionByName(changed.select(*hist_cols))


def scd3(current: DataFrame, previous: DataFrame, key_columns, track_columns, effective_date_column: str | None = None,
         as_of: _dt.datetime | None = None) -> DataFrame:
    """Current rows plus ``previous_<col>`` for each tracked column."""
    keys, tracked = col_list(key_columns), col_list(track_columns)
    if not tracked:
        raise ValueError("scd3: track columns are required")
    c, p = current.alias("c"), previous.alias("p")
    j = c.join(p, _keys(c, p, keys), "left")
    extra = []
    if effective_date_column:
        ts = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
        extra.append(ts.alias(effective_date_column))
    return j.select("c.*", *[F.col(f"p.{t}").alias(f"previous_{t}") for t in tracked], *extra)


# ---------------------------------------------------------------------------
# Incremental load with a saved high-water mark
# ---------------------------------------------------------------------------

class IncrementalLoad:
    """``rows = load.pending(df)`` keeps rows with ``column > mark``; after the
    sink has committed, ``load.commit(rows)`` saves the new mark (the max
    loaded value) as a one-row parquet state table. A run that fails before
    ``commit`` leaves the mark untouched, so it is retried in full."""

    def __init__(self, spark, state_path: str, column: str, initial_value=None):
        self.spark, self.state_path, self.column, self.initial = spark, state_path.rstrip("/"), column, initial_value

    def mark(self):
        if not path_exists(self.spark, self.state_path):  # any other error must not reload everything
            return self.initial
        rows = self.spark.read.parquet(self.state_path).orderBy(F.col("version").desc()).limit(1).collect()
        return rows[0]["mark"] if rows else self.initial

    def pending(self, df: DataFrame) -> DataFrame:
        m = self.mark()
        # A literal comparison: Catalyst pushes it into the parquet scan.
        return df if m is None else df.where(F.col(self.column) > F.lit(m))

    def commit(self, loaded: DataFrame) -> None:
        new = loaded.agg(F.max(self.column).alias("mark")).collect()[0]["mark"]
        if new is None:
            return
        old = self.mark()
        if old is not None and new <= old:
            return
        version = int(_dt.datetime.now(_dt.timezone.utc).timestamp() * 1e6)
        state = self.spark.createDataFrame([(version, new)], ["version", "mark"])
        state.write.mode("append").parquet(self.state_path)

    def backfill(self, value) -> None:
        """Reset the mark (e.g. to reload a range)."""
        version = int(_dt.datetime.now(_dt.timezone.utc).timestamp() * 1e6)
        self.spark.createDataFrame([(version, value)], ["version", "mark"]).write.mode("append").parquet(self.state_path)


def incremental_load(df: DataFrame, column: str, mark=None) -> DataFrame:
    """Rows with ``column`` strictly greater than ``mark`` (all rows when no
    mark yet)."""
    return df if mark is None else df.where(F.col(column) > F.lit(mark))
