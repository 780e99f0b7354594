"""Exact selection by rank without sorting: counting passes over ranges of the key.

The range from the smallest to the largest value is cut into ``BUCKETS`` equal parts,
rows are counted per part (a partial sum in every task), and only the part that holds
the wanted rank is looked into further, until it holds one value or few enough rows to
look at. Every pass reads one column and returns at most ``BUCKETS`` counts a rank. A
rank's value then splits the table by a plain filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType,
    TimestampNTZType, TimestampType, VariantType,
)

BUCKETS = 4_096
FEW = 50_000  # rows that may be sorted and looked at


def _number(c: Column, kind) -> Column | None:
    """A column of numbers in the order of ``c`` (null where a value is not finite)."""
    if isinstance(kind, (IntegralType, DecimalType)):
        return c
    if isinstance(kind, (FloatType, DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("double"))
    if isinstance(kind, BooleanType):
        return c.cast("int")
    if isinstance(kind, DateType):
        return F.unix_date(c)
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    return None


def _bucket(x: Column, low, high) -> Column:
    """Which of the BUCKETS equal parts of low..high; never falls as x rises."""
    part = F.floor((x.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low)) * BUCKETS)
    return F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), part)).cast("int")


def _halved(x: Column, low, high) -> Column:
    """Two parts, where doubles cannot tell more apart."""
    middle = low + (high - low) / 2 if isinstance(low, float) else low + (high - low) // 2
    return (x > F.lit(middle)).cast("int")


def kth(rows: DataFrame, x: Column, ranks: list[int]) -> dict[int, object]:
    """The values of ``x`` (not null) at the 0-based ``ranks`` in rising order."""
    out: dict[int, object] = {}
    todo = [(rows.where(x.isNotNull()), 0, sorted(set(ranks)))]
    while todo:
        part, before, wanted = todo.pop()
        low, high, n = part.agg(F.min(x), F.max(x), F.count(x)).first()
        if low is None:
            continue
        if low == high:
            out |= {r: low for r in wanted}
        elif n <= FEW:
            values = [v[0] for v in part.select(x.alias("v")).orderBy("v").collect()]
            out |= {r: values[r - before] for r in wanted if r - before < n}
        else:
            spread = float(high) - float(low)
            b = _bucket(x, low, high) if 0 < spread < float("inf") else _halved(x, low, high)
            counts = sorted(part.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
            if len(counts) == 1:
                b = _halved(x, low, high)
                counts = sorted(part.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
            at = before
            for bucket, size in counts:
                inside = [r for r in wanted if at <= r < at + size]
                if inside:
                    todo.append((part.where(b == bucket), at, inside))
                at += size
    return out


def _text_key(c: Column, skip: int) -> Column:
    """Six bytes of a text after the first ``skip`` as a number in byte order."""
    part = F.hex(F.substring(c.cast("binary"), skip + 1, 6))
    return F.conv(F.rpad(part, 12, "0"), 16, 10).cast("bigint")


def _kth_text(rows: DataFrame, c: Column, rank: int):
    """The value of a text column (not null) at a rank, some bytes after the other."""
    while True:
        low, high, n = rows.agg(F.min(c), F.max(c), F.count(c)).first()
        if low is None or low == high:
            return low
        if n <= FEW:
            return rows.select(c.alias("v")).orderBy("v").collect()[rank][0]
        a, b = low.encode() if isinstance(low, str) else bytes(low), high.encode() if isinstance(high, str) else bytes(high)
        skip = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        key = _text_key(c, skip)
        value = kth(rows, key, [rank])[rank]
        rank -= rows.where(key < value).count()
        rows = rows.where(key == value)
        # texts that end inside the six bytes, padded, equal longer ones with zero bytes: these come first
        short = F.length(c.cast("binary")) - skip
        least = rows.agg(F.min(short), F.max(short)).first()
        if least[0] < 6 and least[0] != least[1]:
            rows = rows.withColumn("__w_short", short)
            size = kth(rows, F.least(F.col("__w_short"), F.lit(6)), [rank])[rank]
            rank -= rows.where(F.least(F.col("__w_short"), F.lit(6)) < size).count()
            rows = rows.where(F.least(F.col("__w_short"), F.lit(6)) == size).drop("__w_short")


def can_order(kind) -> bool:
    return not isinstance(kind, (MapType, VariantType, ArrayType, StructType))


def first_rows(df: DataFrame, order: list[tuple[Column, object, bool]], k: int) -> DataFrame:
    """The first ``k`` rows in the order of (column, type, descending), nulls last.
    Equal rows count one by one: of rows equal in the whole order any are taken, as many
    as are needed. No sort and no buffer of ``k`` rows: a filter per column."""
    taken = []
    rows, left = df, k
    for c, kind, down in order:
        if left <= 0:
            break
        # first the values, then the nulls; among doubles NaN is the largest, infinities are values
        odd = isinstance(kind, (FloatType, DoubleType))
        classes = [c.isNotNull()]
        if odd:
            finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
            classes = [c == float("-inf"), finite, c == float("inf"), F.isnan(c)]
            classes = classes[::-1] if down else classes
        classes.append(c.isNull())
        sizes = rows.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(f"n{i}") for i, p in enumerate(classes)]).first()
        rest = None
        for p, n in zip(classes, sizes):
            part = rows.where(p)
            if n <= left:
                if n:
                    taken.append(part)
                left -= n
                continue
            rest = part
            break
        if rest is None or left <= 0:
            rows = None
            break
        rows = rest
        if n and p is not classes[-1]:
            n = int(n)
            rank = n - left if down else left - 1
            x = _number(c, kind)
            if x is not None:
                value = kth(rows, x, [rank]).get(rank)
            else:
                x, value = c, _kth_text(rows, c, rank)
            if value is not None:
                before = rows.where(x > F.lit(value) if down else x < F.lit(value))
                taken.append(before)
                left -= before.count()
                rows = rows.where(x == F.lit(value))
    if rows is not None and left > 0:
        # rows that nothing tells apart: as many as are needed, by their place in the storage
        taken.append(_any(rows, left))
    out = df.where(F.lit(False))
    for part in taken:
        out = out.unionByName(part)
    return out


def _any(rows: DataFrame, k: int) -> DataFrame:
    """``k`` of rows that are alike: whole partitions, and the first rows of one."""
    numbered = rows.withColumn("__w_at", F.monotonically_increasing_id()).checkpoint(eager=True)  # the ids must not change any more
    counts = sorted(numbered.groupBy(F.shiftright("__w_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    whole, left = [], k
    keep = F.lit(False)
    for p, n in counts:  # one row a partition
        if n <= left:
            whole.append(p)
            left -= n
            continue
        if left:
            at = kth(numbered.where(F.shiftright("__w_at", 33) == p), F.col("__w_at"), [left - 1])[left - 1]
            keep = (F.shiftright("__w_at", 33) == p) & (F.col("__w_at") <= at)
        break
    return numbered.where(F.shiftright("__w_at", 33).isin(whole) | keep).drop("__w_at")


def quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """Exact continuous quantiles (linear interpolation) of the values, NaN the largest."""
    c = F.col(column).cast("double")
    classes = [c == float("-inf"), c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c == float("inf"), F.isnan(c)]
    sizes = df.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(f"n{i}") for i, p in enumerate(classes)]).first()
    n = sum(sizes)
    if not n:
        return [None] * len(qs)
    places = [q * (n - 1) for q in qs]
    ranks = sorted({int(p) + d for p in places for d in (0, 1) if int(p) + d < n})
    finite = kth(df.where(classes[1]), c, [r - sizes[0] for r in ranks if 0 <= r - sizes[0] < sizes[1]])

    def at(r: int) -> float:
        if r < sizes[0]:
            return float("-inf")
        if r < sizes[0] + sizes[1]:
            return finite[r - sizes[0]]
        return float("inf") if r < sizes[0] + sizes[1] + sizes[2] else float("nan")

    out = []
    for p in places:
        low = at(int(p))
        part = p - int(p)
        out.append(low + (at(int(p) + 1) - low) * part if part else low)
    return out
