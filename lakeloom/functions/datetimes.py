"""Date/time functions (naive timestamps, session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.core import strptime_to_java, with_result


def dt_parse(df: DataFrame, column: str, format: str = "%Y-%m-%d", output: str | None = None) -> DataFrame:
    """NULL on a value that does not match."""
    e = F.try_to_timestamp(F.col(column).cast("string"), F.lit(strptime_to_java(format))).cast("timestamp_ntz")
    return with_result(df, column, e, output)


def dt_format(df: DataFrame, column: str, format: str, output: str | None = None) -> DataFrame:
    return with_result(df, column, F.date_format(F.col(column), strptime_to_java(format)), output)


# date_part unit names.
_EXTRACT = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute,
    "second": F.second, "quarter": F.quarter, "week": F.weekofyear, "dayofyear": F.dayofyear, "doy": F.dayofyear,
}


def dt_extract(df: DataFrame, column: str, unit: str = "day", output: str | None = None) -> DataFrame:
    """date_part as BIGINT (``epoch`` as DOUBLE seconds); day of week counts
    Sunday = 0; millisecond/microsecond include the seconds, as in SQL."""
    u = unit.lower()
    c = F.col(column)
    micros_in_minute = F.unix_micros(c.cast("timestamp")) - F.unix_micros(F.date_trunc("minute", c).cast("timestamp"))
    if u in ("dow", "dayofweek", "weekday"):
        e = F.dayofweek(c) - 1
    elif u in ("isodow",):
        e = F.weekday(c) + 1
    elif u == "epoch":
        return with_result(df, column, F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0), output)
    elif u in ("millisecond", "milliseconds", "ms"):
        e = F.floor(micros_in_minute / 1000)
    elif u in ("microsecond", "microseconds", "us"):
        e = micros_in_minute
    elif u == "decade":
        e = F.floor(F.year(c) / 10)
    else:
        e = _EXTRACT[u](c)
    return with_result(df, column, e.cast("bigint"), output)


def dt_trunc(df: DataFrame, column: str, unit: str = "day", output: str | None = None) -> DataFrame:
    return with_result(df, column, F.date_trunc(unit, F.col(column)).cast("timestamp_ntz"), output)


def dt_tz(df: DataFrame, column: str, timezone: str, output: str | None = None) -> DataFrame:
    """Naive local time in ``timezone`` → the instant (as naive UTC)."""
    if not timezone:
        raise ValueError("dt_tz: timezone is required")
    e = F.to_utc_timestamp(F.col(column).cast("timestamp"), timezone).cast("timestamp_ntz")
    return with_result(df, column, e, output)


def add_interval(c: Column, amount: int, unit: str) -> Column:
    u = unit.lower().rstrip("s")
    n = int(amount)
    if u == "year":
        return c + F.make_interval(years=F.lit(n))
    if u == "quarter":
        return c + F.make_interval(months=F.lit(3 * n))
    if u == "month":
        return c + F.make_interval(months=F.lit(n))
    if u == "week":
        return c + F.make_interval(weeks=F.lit(n))
    if u == "hour":
        return c + F.make_interval(hours=F.lit(n))
    if u == "minute":
        return c + F.make_interval(mins=F.lit(n))
    if u == "second":
        return c + F.make_interval(secs=F.lit(n))
    return c + F.make_interval(days=F.lit(n))


def dt_add(df: DataFrame, column: str, amount: int = 1, unit: str = "day", output: str | None = None) -> DataFrame:
    """Interval maths; month arithmetic clamps to the month end."""
    return with_result(df, column, add_interval(F.col(column), amount, unit), output)


def boundary_diff(start: Column, end: Column, unit: str) -> Column:
    """Number of unit boundaries crossed from start to end
    (23:00 → 01:00 next day = 1 day)."""
    u = unit.lower().rstrip("s")
    s, e = start.cast("timestamp"), end.cast("timestamp")
    if u == "year":
        return (F.year(e) - F.year(s)).cast("bigint")
    if u == "quarter":
        return ((F.year(e) * 4 + F.quarter(e)) - (F.year(s) * 4 + F.quarter(s))).cast("bigint")
    if u == "month":
        return ((F.year(e) * 12 + F.month(e)) - (F.year(s) * 12 + F.month(s))).cast("bigint")
    if u == "week":
        # whole weeks of crossed day boundaries, truncated toward zero
        return (F.datediff(e.cast("date"), s.cast("date")) / 7).cast("bigint")
    if u == "day":
        return F.datediff(e.cast("date"), s.cast("date")).cast("bigint")
    div = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}[u]
    return (F.floor(F.unix_micros(e) / div) - F.floor(F.unix_micros(s) / div)).cast("bigint")


def dt_diff(df: DataFrame, start_column: str, end_column: str, unit: str = "day", output: str = "date_diff") -> DataFrame:
    return df.withColumn(output, boundary_diff(F.col(start_column), F.col(end_column), unit))


def dt_now(df: DataFrame, output: str = "loaded_at") -> DataFrame:
    return df.withColumn(output, F.current_timestamp().cast("timestamp_ntz"))


def dt_epoch(df: DataFrame, column: str, mode: str = "to", output: str | None = None) -> DataFrame:
    """``to``: seconds since epoch as DOUBLE (``{col}_epoch``); ``from``:
    seconds → naive timestamp (``{col}_timestamp``)."""
    c = F.col(column)
    if mode == "to":
        return df.withColumn(output or f"{column}_epoch", F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0))
    e = F.timestamp_micros(F.round(c.cast("double") * 1_000_000).cast("bigint")).cast("timestamp_ntz")
    return df.withColumn(output or f"{column}_timestamp", e)


# Bucket unit lengths in microseconds.
_UNIT_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000,
            "week": 7 * 86_400_000_000}


def time_bin_expr(c: Column, unit: str = "minute", count: int = 5) -> Column:
    """Floor to a fixed-width bucket aligned to the epoch."""
    width = _UNIT_US[unit.lower().rstrip("s")] * int(count)
    us = F.unix_micros(c.cast("timestamp"))
    return F.timestamp_micros(us - F.pmod(us, F.lit(width))).cast("timestamp_ntz")


def time_bin(df: DataFrame, column: str, unit: str = "minute", count: int = 5, output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{column}_bin", time_bin_expr(F.col(column), unit, count))
