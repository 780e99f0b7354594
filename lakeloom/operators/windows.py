"""Window operators.

Partitioned windows map to Spark windows directly. Without a partition the
literal translation (a window with no PARTITION BY) runs in ONE task, so the
global forms here use range partitioning plus a per-partition carry frame
whose size is the number of partitions, never the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.core import Split, col_list, global_row_number, partition_offsets, range_numbered

_RANKERS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def _asc(cols: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def global_rank(df: DataFrame, order: list[str], output: str = "rank", dense: bool = False) -> DataFrame:
    """Exact ``rank``/``dense_rank`` over the whole frame without one task:
    ties share a range partition, so a partition-local rank plus the count
    (or distinct-key count) of earlier partitions is the global rank."""
    numbered = range_numbered(df, order)
    w = Window.partitionBy("__pid").orderBy(*_asc(order))
    local = numbered.withColumn("__lr", (F.dense_rank() if dense else F.rank()).over(w))
    extra = {"__dk": F.max("__lr")} if dense else {}
    offs = partition_offsets(local, extra)
    if dense:
        wd = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
        offs = offs.withColumn("__off", F.coalesce(F.sum("__dk").over(wd), F.lit(0)))
    return (
        local.join(F.broadcast(offs.select("__pid", "__off")), "__pid")
        .withColumn(output, (F.col("__lr") + F.col("__off")).cast("bigint"))
        .drop("__pid", "__lrn", "__lr", "__off")
    )


def global_dense_rank(df: DataFrame, order: list[str], output: str) -> DataFrame:
    return global_rank(df, order, output, dense=True)


def rank_rows(
    df: DataFrame, func: str = "row_number", partition_by=None, order_by=None, ntile_buckets: int = 4,
    output: str | None = None, skew_safe: bool = True,
) -> DataFrame:
    """row_number / rank / dense_rank / ntile, ascending, result as BIGINT.
    ``skew_safe`` row_number splits hot keys over range partitions."""
    keys, order = col_list(partition_by), col_list(order_by)
    if not order:
        raise ValueError(f"{func}: order_by is required")
    out = output or func
    if keys and skew_safe:
        from lakeloom.operators import segmented as seg

        if func == "row_number":
            return seg.keyed_row_number(df, keys, order, out)
        if func == "ntile":
            return seg.keyed_ntile(df, keys, order, ntile_buckets, out)
        return seg.keyed_rank(df, keys, order, out, dense=func == "dense_rank")
    if keys:
        w = Window.partitionBy(*keys).orderBy(*_asc(order))
        e = F.ntile(int(ntile_buckets)).over(w) if func == "ntile" else _RANKERS[func]().over(w)
        return df.withColumn(out, e.cast("bigint"))
    if func == "row_number":
        return global_row_number(df, order, out)
    if func in ("rank", "dense_rank"):
        return global_rank(df, order, out, dense=func == "dense_rank")
    if func == "ntile":
        n = int(ntile_buckets)
        numbered = global_row_number(df, order, "__r")
        total = numbered.agg(F.count(F.lit(1)).alias("__n"))  # one row
        r, N = F.col("__r"), F.col("__n")
        q, rem = F.floor(N / n), N % n
        big = rem * (q + 1)
        bucket = F.when(r <= big, F.floor((r - 1) / (q + 1)) + 1).otherwise(rem + F.floor((r - 1 - big) / q) + 1)
        return numbered.crossJoin(F.broadcast(total)).withColumn(out, bucket.cast("bigint")).drop("__r", "__n")
    raise ValueError(f"unknown ranking function {func!r}")


def lead_lag(
    df: DataFrame, func: str, target_column: str, offset: int = 1, partition_by=None, order_by=None,
    output: str | None = None, skew_safe: bool = True,
) -> DataFrame:
    keys, order = col_list(partition_by), col_list(order_by)
    out = output or func
    f = F.lead if func == "lead" else F.lag
    if keys and skew_safe:
        from lakeloom.operators.segmented import keyed_shift

        return keyed_shift(df, keys, order, target_column, int(offset) if func == "lag" else -int(offset), out)
    if keys:
        w = Window.partitionBy(*keys).orderBy(*_asc(order))
        return df.withColumn(out, f(F.col(target_column), int(offset)).over(w))
    # Global shift: number rows, then an equi join on row number ± offset.
    numbered = global_row_number(df, order, "__r")
    shift = int(offset) if func == "lag" else -int(offset)
    other = numbered.select((F.col("__r") + shift).alias("__r"), F.col(target_column).alias(out))
    return numbered.join(other, "__r", "left").drop("__r")


def first_last_value(df: DataFrame, func: str, target_column: str, partition_by=None, order_by=None,
                     output: str | None = None) -> DataFrame:
    """first_value / last_value over the WHOLE partition frame."""
    keys, order = col_list(partition_by), col_list(order_by)
    out = output or func
    # Whole-frame first/last = value at min/max order key: an aggregate
    # (partial aggregation before the shuffle) joined back on the keys.
    # Without an order any row's value is valid, still as an aggregate.
    parts = []
    for c in order:
        parts += [F.isnull(F.col(c)), F.col(c)]  # (is NULL, value): NULLS LAST per column
    if not order:
        agg = (F.first if func == "first_value" else F.last)(F.col(target_column))
    elif func == "first_value":
        agg = F.min_by(F.col(target_column), F.struct(*parts))
    else:
        agg = F.max_by(F.col(target_column), F.struct(*parts))
    if keys:
        per = df.groupBy(*keys).agg(agg.alias(out))
        return df.join(per, [df[k].eqNullSafe(per[k]) for k in keys], "left").select(df["*"], per[out])
    one = df.agg(agg.alias(out))
    return df.crossJoin(F.broadcast(one))


def window_aggregate(df: DataFrame, function: str = "sum", column: str = "*", partition_by=None,
                     output: str | None = None) -> DataFrame:
    """Aggregate on every row over the whole partition. Built as
    aggregate + join back (partial aggregation, skew-safe); unpartitioned is
    one global row broadcast to every row."""
    keys = col_list(partition_by)
    from lakeloom.operators.aggregate import agg_expr, default_alias

    name = output or default_alias(function, column)
    a = agg_expr(function, None if column == "*" else column).alias(name)
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(a)))
    per = df.groupBy(*keys).agg(a)
    return df.join(per, [df[k].eqNullSafe(per[k]) for k in keys], "left").select(df["*"], per[name])


_CUM = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


def cumulative(df: DataFrame, column: str, order_by, function: str = "sum", partition_by=None,
               output: str | None = None, skew_safe: bool = True) -> DataFrame:
    """Running aggregate, ROWS frame, ``{col}_running_{fn}``."""
    keys, order = col_list(partition_by), col_list(order_by)
    out = output or f"{column}_running_{function}"
    f = _CUM[function]
    if skew_safe or not keys:
        from lakeloom.operators.segmented import keyed_running

        return keyed_running(df, keys, order, column, function, out)
    w = Window.partitionBy(*keys).orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, f(F.col(column)).over(w))


def fill_forward(df: DataFrame, column: str, order_by, partition_by=None, skew_safe: bool = True) -> DataFrame:
    """Last non-NULL value up to the current row, in place."""
    keys, order = col_list(partition_by), col_list(order_by)
    if keys and skew_safe:
        from lakeloom.operators.segmented import keyed_fill

        return keyed_fill(df, keys, order, column)
    w = Window.partitionBy(*keys).orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if keys:
        return df.withColumn(column, F.last(F.col(column), ignorenulls=True).over(w))
    numbered = range_numbered(df, order, split_ties=True)
    wl = Window.partitionBy("__pid").orderBy(*_asc(order), F.col("__lrn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = numbered.withColumn("__f", F.last(F.col(column), ignorenulls=True).over(wl))
    per = numbered.groupBy("__pid").agg(F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("__lrn"))).alias("__last"))
    wp = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("__pid", F.last("__last", ignorenulls=True).over(wp).alias("__carry"))
    j = local.join(F.broadcast(carry), "__pid")
    return j.withColumn(column, F.coalesce(F.col("__f"), F.col("__carry"))).select(*df.columns)


def fill_backward(df: DataFrame, column: str, order_by, partition_by=None, skew_safe: bool = True) -> DataFrame:
    """First non-NULL value from the current row on, in place."""
    keys, order = col_list(partition_by), col_list(order_by)
    if keys and skew_safe:
        from lakeloom.operators.segmented import keyed_fill

        return keyed_fill(df, keys, order, column, backward=True)
    if keys:
        back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_first() for c in order])
        return df.withColumn(column, F.last(F.col(column), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    numbered = range_numbered(df, order, split_ties=True)
    # from the last row back: a frame that shrinks to the end is built anew for every row
    wl = Window.partitionBy("__pid").orderBy(F.col("__lrn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = numbered.withColumn("__f", F.last(F.col(column), ignorenulls=True).over(wl))
    per = numbered.groupBy("__pid").agg(F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("__lrn"))).alias("__first"))
    wp = Window.orderBy(F.col("__pid").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("__pid", F.last("__first", ignorenulls=True).over(wp).alias("__carry"))
    j = local.join(F.broadcast(carry), "__pid")
    return j.withColumn(column, F.coalesce(F.col("__f"), F.col("__carry"))).select(*df.columns)


# Gap units in seconds.
_UNIT_SECONDS = {"seconds": 1, "second": 1, "minutes": 60, "minute": 60, "hours": 3600, "hour": 3600,
                 "days": 86400, "day": 86400}


def sessionize(
    df: DataFrame, partition_by, order_by: str, gap: float, gap_unit: str = "minutes",
    session_column: str = "session_id", emit_seq: bool = True, seq_column: str = "session_seq",
    skew_safe: bool = True,
) -> DataFrame:
    """New session when the gap to the previous event is strictly greater
    than the threshold; ids run 1.. per partition; seq restarts per session.
    Rows of equal time share a session. ``skew_safe`` (default) cuts hot keys
    into range partitions; False uses Spark's window per key, same results."""
    keys = col_list(partition_by)
    if not keys:
        # One global event stream: a constant key is the hottest key there
        # is, so it goes through the skew-safe (range-split) path.
        out = sessionize(df.withColumn("__all", F.lit(0)), "__all", order_by, gap, gap_unit, session_column,
                         emit_seq, seq_column, skew_safe=True)
        return out.drop("__all")
    micros = int(float(gap) * _UNIT_SECONDS[gap_unit] * 1_000_000)
    ts = F.col(order_by)
    if skew_safe:
        from lakeloom.operators.segmented import keyed_sessions

        return keyed_sessions(df, keys, order_by, micros, session_column, seq_column if emit_seq else None)
    w = Window.partitionBy(*keys).orderBy(ts.asc_nulls_last())
    prev = F.lag(ts).over(w)
    gap_us = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    brk = F.when(prev.isNull() | (gap_us > micros), 1).otherwise(0)
    out = df.withColumn("__brk", brk)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn(session_column, F.sum("__brk").over(wr).cast("bigint"))
    if emit_seq:
        ws = Window.partitionBy(*keys, session_column).orderBy(ts.asc_nulls_last())
        out = out.withColumn(seq_column, F.row_number().over(ws).cast("bigint"))
    return out.drop("__brk")


def zscore(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """(x - mean) / stddev_samp over all rows; NULL when stddev is 0.
    One global aggregate (one row) broadcast to every row."""
    stats = df.agg(F.avg(column).alias("__mu"), F.stddev_samp(column).alias("__sd"))
    out = output or f"{column}_zscore"
    z = F.when(F.col("__sd") != 0, (F.col(column) - F.col("__mu")) / F.col("__sd"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, z).drop("__mu", "__sd")


def exact_quantiles(df: DataFrame, column: str, qs: list[float]) -> DataFrame:
    """Exact continuous quantiles (linear interpolation) as one row with columns ``q0,
    q1, …``, found by counting passes over ranges of the value (``selection``)."""
    from lakeloom.operators.selection import quantiles

    values = quantiles(df, column, qs)
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(f"q{i} double" for i in range(len(qs))))


def outlier(df: DataFrame, column: str, method: str = "iqr", sensitivity: float | None = None) -> Split:
    """Inliers pass, outliers reject; NULL values pass.

    ``iqr``: within [q1 - k·iqr, q3 + k·iqr] with exact quartiles.
    ``zscore``: |x - mean| ≤ k·stddev_pop; all pass when the spread is 0."""
    x = F.col(column)
    if method == "iqr":
        k = 1.5 if sensitivity is None else float(sensitivity)
        q = exact_quantiles(df, column, [0.25, 0.75])
        iqr = F.col("q1") - F.col("q0")
        ok = x.isNull() | x.between(F.col("q0") - iqr * k, F.col("q1") + iqr * k)
        stats = q
    elif method == "zscore":
        k = 3.0 if sensitivity is None else float(sensitivity)
        stats = df.agg(F.avg(x).alias("__mu"), F.stddev_pop(x).alias("__sd"))
        ok = x.isNull() | (F.col("__sd") == 0) | (F.abs((x.cast("double") - F.col("__mu")) / F.col("__sd")) <= k)
    else:
        raise ValueError(f"outlier: unknown method {method!r}")
    # An undecidable row (e.g. a single-row spread) counts as an inlier.
    j = df.crossJoin(F.broadcast(stats)).withColumn("__ok", F.coalesce(ok, F.lit(True)))
    return Split(j.where("__ok").select(*df.columns), j.where("NOT __ok").select(*df.columns))
