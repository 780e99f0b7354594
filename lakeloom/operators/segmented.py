"""Ordered windows per key that no single key can fill a task with.

Spark's window operator sends all rows of a key to one task. Here a key of ordinary
size keeps that plan (one shuffle, one sort), and a hot key is cut into slices that
follow each other in the window's order; rows are dealt by (key, slice). What a slice
needs from the slices before it is a row per slice: counts, sums, the last value. These
rows are chained by a window over the slices, so every carry stays a Spark value of the
column's own type.

A key is hot above twice ``ROWS`` rows, or twice the table's ``1 / SLICES`` if that is
more: at most ``SLICES`` slices exist in all, which bounds what is broadcast. The
borders of a hot key's slices come from a sample of its rows chosen by hash; they only
decide where a slice ends, not the result. A row's place in the order is its order
columns (nulls last) and, where ties may be split, a hash of the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from lakeloom.core import col_list

ROWS = 100_000
SLICES = 10_000
SAMPLES = 64  # sampled rows a slice

SLICE, PLACE = "__w_slice", "__w_place"


def _asc(cols: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def attach(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Left join of a broadcast frame of at most one row per key and slice; keys
    compare null-safe and may have any name."""
    names = {c: f"__j{i}" for i, c in enumerate(on)}
    cond = None
    for c, j in names.items():
        same = F.col(c).eqNullSafe(F.col(j))
        cond = same if cond is None else cond & same
    small = small.select(*[F.col(c).alias(j) for c, j in names.items()], *[c for c in small.columns if c not in names])
    return rows.join(F.broadcast(small), cond, "left").drop(*names.values())


def _borders(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, borders): the hot keys, with the first place of each slice but the first,
    in groups of about the square root of their number."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__w_n"))
    total = counts.agg(F.sum("__w_n").alias("__w_total"))  # one row
    size = F.greatest(F.lit(ROWS), F.ceil(F.col("__w_total") / SLICES))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("__w_n") > 2 * size) \
        .select(*keys, F.ceil(F.col("__w_n") / size).cast("int").alias("__w_m"), F.col("__w_n"))
    rows = attach(df.select(*keys, PLACE), hot, keys).where(F.col("__w_m").isNotNull())
    drawn = F.pmod(F.xxhash64(F.lit(7), F.col(PLACE)), F.col("__w_n")) < F.col("__w_m") * SAMPLES
    found = rows.where(drawn).groupBy(*keys).agg(F.sort_array(F.collect_list(PLACE)).alias("__w_s"), F.first("__w_m").alias("__w_m"))
    at = "cast(i * size(__w_s) / __w_m as int)"
    found = found.withColumn("__w_b", F.expr(f"array_distinct(transform(filter(sequence(1, __w_m - 1), i -> {at} > 0), i -> __w_s[{at}]))"))
    found = found.withColumn("__w_w", F.expr("greatest(1, cast(ceil(sqrt(size(__w_b))) as int))"))
    grouped = "if(size(__w_b) = 0, array(), transform(sequence(0, size(__w_b) - 1, __w_w), i -> slice(__w_b, i + 1, __w_w)))"
    return found.select(*keys, F.expr(grouped).alias("__w_borders"))


def sliced(df: DataFrame, keys: list[str], order: list[str], ties: list[str] | None) -> DataFrame:
    """``df`` with the row's place, and its slice: -1 for keys that are not hot."""
    parts = [p for c in order for p in (F.col(c).isNull(), F.col(c))]
    if ties:
        parts.append(F.xxhash64(*[F.col(c) for c in dict.fromkeys(ties)]))
    df = df.withColumn(PLACE, F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]))
    rows = attach(df, _borders(df, keys), keys)
    group = f"size(filter(__w_borders, g -> g[0] <= {PLACE}))"
    width = "size(__w_borders[0])"
    inside = f"if({group} = 0, 0, ({group} - 1) * {width} + size(filter(__w_borders[greatest({group} - 1, 0)], x -> x <= {PLACE})))"
    return rows.withColumn(SLICE, F.expr(f"case when __w_borders is null then -1 when size(__w_borders) = 0 then 0 else {inside} end")) \
        .drop("__w_borders")


def _window(keys: list[str], order: list[str], ties: bool):
    w = Window.partitionBy(*[F.col(k) for k in keys], F.col(SLICE))
    return w.orderBy(F.col(PLACE)) if ties else w.orderBy(*_asc(order))


def _hot(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(SLICE) >= 0)


def _slices(keys: list[str], reverse: bool = False):
    """Over the slices of a key: those before (after) the current one."""
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(F.col(SLICE).desc() if reverse else F.col(SLICE))
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _earlier(rows: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Per hot slice: the sums of each aggregate over the slices before it."""
    per = _hot(rows).groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in aggregates.items()])
    return per.select(*keys, SLICE, *[F.coalesce(F.sum(n).over(_slices(keys)), F.lit(0)).alias(n) for n in aggregates])


def _numbered(df: DataFrame, keys: list[str], order: list[str], ties: list[str], output: str) -> DataFrame:
    """Rows with place, slice, local number ``__w_r`` and the number within the key."""
    rows = sliced(df, keys, order, ties)
    rows = rows.withColumn("__w_r", F.row_number().over(_window(keys, order, True)).cast("bigint"))
    rows = attach(rows, _earlier(rows, keys, __w_before=F.count(F.lit(1))), [*keys, SLICE])
    return rows.withColumn(output, F.col("__w_r") + F.coalesce(F.col("__w_before"), F.lit(0)).cast("bigint")).drop("__w_before")


def keyed_row_number(df: DataFrame, keys, order, output: str = "row_number") -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)``; ties by a hash of keys and order."""
    ks, od = col_list(keys), col_list(order)
    return _numbered(df, ks, od, _hashable(df), output).select(*df.columns, output)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


def keyed_rank(df: DataFrame, keys, order, output: str = "rank", dense: bool = False) -> DataFrame:
    """``rank`` / ``dense_rank`` per key. Rows of equal order values have one rank, so the
    distinct values are counted and numbered, and a row finds its rank by an equi-join: rows
    of one value need not meet in a task."""
    ks, od = col_list(keys), col_list(order)
    on = list(dict.fromkeys([*ks, *od]))
    values = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__r_n"))
    if dense:
        values = keyed_row_number(values, ks, od, "__r_at")
    else:
        values = keyed_running(values, ks, od, "__r_n", "sum", "__r_at").withColumn("__r_at", F.col("__r_at") - F.col("__r_n") + 1)
    names = {c: f"__j{i}" for i, c in enumerate(on)}
    values = values.select(*[F.col(c).alias(j) for c, j in names.items()], "__r_at")
    rows = df.join(values, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(j)) for c, j in names.items()]))
    return rows.withColumn(output, F.col("__r_at").cast("bigint")).select(*df.columns, output)


def keyed_ntile(df: DataFrame, keys, order, buckets: int, output: str = "ntile") -> DataFrame:
    """``ntile(n)`` per key from the row number and the key's row count."""
    ks, od = col_list(keys), col_list(order)
    rows = _numbered(df, ks, od, _hashable(df), "__w_rn")
    n = int(buckets)
    whole = F.count(F.lit(1)).over(Window.partitionBy(*[F.col(k) for k in ks], F.col(SLICE)))
    sizes = _hot(rows).groupBy(*ks).agg(F.count(F.lit(1)).alias("__w_all"))
    rows = attach(rows.withColumn("__w_own", whole), sizes, ks)
    r, total = F.col("__w_rn"), F.coalesce(F.col("__w_all"), F.col("__w_own"))
    q, rem = F.floor(total / n), total % n
    big = rem * (q + 1)
    bucket = F.when(r <= big, F.floor((r - 1) / (q + 1)) + 1).otherwise(rem + F.floor((r - 1 - big) / q) + 1)
    return rows.withColumn(output, bucket.cast("bigint")).select(*df.columns, output)


def keyed_shift(df: DataFrame, keys, order, column: str, offset: int = 1, output: str = "lag") -> DataFrame:
    """lag (offset > 0) / lead (offset < 0) per key. Near a slice's border the row lies
    in another slice: the rows by the borders are matched by their numbers."""
    ks, od, k = col_list(keys), col_list(order), abs(offset)
    rows = _numbered(df, ks, od, _hashable(df), "__w_rn")
    w = _window(ks, od, True)
    rows = rows.withColumn("__w_v", (F.lag if offset >= 0 else F.lead)(F.col(column), k).over(w))
    last = F.count(F.lit(1)).over(Window.partitionBy(*[F.col(x) for x in ks], F.col(SLICE)))
    rows = rows.withColumn("__w_back", last - F.col("__w_r"))  # rows after this one in its slice
    near = F.col("__w_back") < k if offset >= 0 else F.col("__w_r") <= k
    others = _hot(rows).where(near).select(*ks, (F.col("__w_rn") + offset).alias("__w_rn"), F.struct(F.col(column).alias("v")).alias("__w_far"))
    rows = attach(rows, others, [*ks, "__w_rn"])
    outside = F.col("__w_r") <= k if offset >= 0 else F.col("__w_back") < k
    value = F.when((F.col(SLICE) >= 0) & outside, F.col("__w_far.v")).otherwise(F.col("__w_v"))
    return rows.withColumn(output, value).select(*df.columns, output)


def _with_carries(rows: DataFrame, keys: list[str], carried: dict[str, tuple], reverse: bool = False) -> DataFrame:
    """``rows`` and, for each hot slice, one more row that comes first and holds what
    the slices before (after) it leave: ``carried`` maps a column to (aggregate of a
    slice, aggregate over slices). Marked by ``__w_own`` = false."""
    per = _hot(rows).groupBy(*keys, SLICE).agg(*[a.alias(c) for c, (a, _) in carried.items()])
    over = _slices(keys, reverse)
    per = per.select(*keys, SLICE, *[f(F.col(c)).over(over).cast(rows.schema[c].dataType).alias(c) for c, (_, f) in carried.items()])
    return rows.withColumn("__w_own", F.lit(True)).unionByName(per.withColumn("__w_own", F.lit(False)), allowMissingColumns=True)


def _carry_window(keys: list[str], reverse: bool = False):
    """In place order (``reverse``: from the last place back), a slice's carry row first.
    The frame always grows: one that shrinks to the end of the slice is built anew for
    every row, which is quadratic."""
    w = Window.partitionBy(*[F.col(k) for k in keys], F.col(SLICE))
    w = w.orderBy(F.col("__w_own").asc(), F.col(PLACE).desc() if reverse else F.col(PLACE))
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def keyed_running(df: DataFrame, keys, order, column: str, function: str = "sum", output: str | None = None) -> DataFrame:
    """Running sum / count / min / max / avg per key (ROWS frame), in the type Spark's
    window gives. Without keys: over the whole frame."""
    ks, od = col_list(keys), col_list(order)
    out = output or f"{column}_running_{function}"
    base = df if ks else df.withColumn("__w_all", F.lit(0))
    rows = sliced(base, ks or ["__w_all"], od, _hashable(df))
    ks = ks or ["__w_all"]
    v = F.col(column)
    kind = df.select({"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}[function](v).alias("a")).schema["a"].dataType
    w = _carry_window(ks)
    if function in ("min", "max"):
        f = F.min if function == "min" else F.max
        rows = _with_carries(rows.withColumn("__w_v", v), ks, {"__w_v": (f("__w_v"), f)})
        got = f("__w_v").over(w)
    else:
        # sums run over values already in the result's type, so carries lose no digit
        total = kind if function == "sum" else df.select(F.sum(v).alias("a")).schema["a"].dataType if function == "avg" else "bigint"
        rows = rows.withColumn("__w_v", v.cast(total) if function != "count" else F.lit(0).cast("bigint"))
        rows = rows.withColumn("__w_n", F.when(v.isNotNull(), 1).otherwise(0).cast("bigint"))
        rows = _with_carries(rows, ks, {"__w_v": (F.sum("__w_v"), F.sum), "__w_n": (F.sum("__w_n"), F.sum)})
        s, n = F.sum("__w_v").over(w).cast(total), F.coalesce(F.sum("__w_n").over(w), F.lit(0))
        got = {"sum": s, "count": n, "avg": _average(s, n, total, kind)}[function]
    return rows.withColumn("__w_got", got.cast(kind)).where("__w_own").withColumn(out, F.col("__w_got")).select(*df.columns, out)


def _average(s: Column, n: Column, total, kind) -> Column:
    """s / n; of decimals in two steps, so that the quotient keeps all its digits."""
    n = F.nullif(n, F.lit(0))
    if not isinstance(kind, DecimalType):
        return s / n
    rest = s % n.cast("decimal(19,0)")
    whole = ((s - rest) / n.cast("decimal(19,0)")).cast(kind)
    return whole + (rest.cast(f"decimal({min(38, 19 + total.scale)},{total.scale})") / n.cast("decimal(19,0)")).cast(kind)


def keyed_fill(df: DataFrame, keys, order, column: str, backward: bool = False) -> DataFrame:
    """Fill NULLs from the last (or next) non-NULL value of the same key."""
    ks, od = col_list(keys), col_list(order)
    rows = sliced(df, ks, od, _hashable(df)).withColumn("__w_v", F.col(column))
    pick = F.min_by if backward else F.max_by
    at = F.when(F.col("__w_v").isNotNull(), F.col(PLACE))
    rows = _with_carries(rows, ks, {"__w_v": (pick("__w_v", at), lambda c: F.last(c, ignorenulls=True))}, reverse=backward)
    filled = F.last("__w_v", ignorenulls=True).over(_carry_window(ks, backward))
    return rows.withColumn("__w_got", filled).where("__w_own").withColumn(column, F.col("__w_got")).select(*df.columns)


def keyed_sessions(df: DataFrame, keys, order: str, micros: int, session_column: str, seq_column: str | None) -> DataFrame:
    """Sessions per key: the gap to the row before, the running count of breaks, and the
    place since the last break. Rows of equal time fall in one session."""
    ks = col_list(keys)
    rows = sliced(df, ks, [order], _hashable(df))
    w = _window(ks, [order], True)
    ends = _hot(rows).groupBy(*ks, SLICE).agg(F.max(PLACE).alias("__w_last"))
    ends = ends.select(*ks, SLICE, F.lag(F.col("__w_last")["p1"]).over(
        Window.partitionBy(*[F.col(k) for k in ks]).orderBy(SLICE)).alias("__w_prev"))
    rows = attach(rows, ends, [*ks, SLICE])
    rows = rows.withColumn("__w_r", F.row_number().over(w).cast("bigint")).withColumn("__w_lag", F.lag(order).over(w))
    prev = F.when(F.col("__w_r") == 1, F.col("__w_prev")).otherwise(F.col("__w_lag"))
    gap = F.unix_micros(F.col(order).cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    rows = rows.withColumn("__w_brk", F.when(prev.isNull() | (gap > micros), 1).otherwise(0).cast("bigint"))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__w_breaks", F.sum("__w_brk").over(run)) \
        .withColumn("__w_start", F.max(F.when(F.col("__w_brk") == 1, F.col("__w_r"))).over(run))
    per = _hot(rows).groupBy(*ks, SLICE).agg(F.max("__w_r").alias("__w_rows"), F.max("__w_breaks").alias("__w_b"),
                                            F.max("__w_start").alias("__w_s"))
    per = per.withColumn("__w_before", F.coalesce(F.sum("__w_rows").over(_slices(ks)), F.lit(0)))
    per = per.select(*ks, SLICE, "__w_before", F.coalesce(F.sum("__w_b").over(_slices(ks)), F.lit(0)).alias("__w_sessions"),
                     F.max(F.col("__w_before") + F.col("__w_s")).over(_slices(ks)).alias("__w_open"))
    rows = attach(rows, per, [*ks, SLICE])
    before = F.coalesce(F.col("__w_before"), F.lit(0))
    rows = rows.withColumn("__w_session", (F.col("__w_breaks") + F.coalesce(F.col("__w_sessions"), F.lit(0))).cast("bigint"))
    start = F.coalesce(F.col("__w_start") + before, F.col("__w_open"))
    rows = rows.withColumn("__w_seq", (F.col("__w_r") + before - start + 1).cast("bigint"))
    out = [F.col("__w_session").alias(session_column)] + ([F.col("__w_seq").alias(seq_column)] if seq_column else [])
    return rows.select(*df.columns, *out)
