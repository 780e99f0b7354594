"""Numeric functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.core import with_result


def _finite(arg, name: str):
    if arg is None:
        return None
    v = float(arg)
    if not math.isfinite(v):
        raise ValueError(f"{name}: numeric argument must be finite (got {arg!r})")
    return arg


def num_round(df: DataFrame, column: str, argument: int = 0, output: str | None = None) -> DataFrame:
    """Half away from zero, like the SQL engines."""
    return with_result(df, column, F.round(F.col(column), int(_finite(argument, "round"))), output)


def num_abs(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return with_result(df, column, F.abs(F.col(column)), output)


def num_sqrt(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return with_result(df, column, F.sqrt(F.col(column)), output)


def num_power(df: DataFrame, column: str, argument: float = 2, output: str | None = None) -> DataFrame:
    return with_result(df, column, F.pow(F.col(column), float(_finite(argument, "power"))), output)


def num_mod(df: DataFrame, column: str, argument, output: str | None = None) -> DataFrame:
    """C-sign modulo; a zero divisor gives NULL instead of failing the job."""
    if argument is None:
        raise ValueError("num_mod: a divisor argument is required")
    return with_result(df, column, F.try_mod(F.col(column), F.lit(_finite(argument, "mod"))), output)


def num_log(df: DataFrame, column: str, argument=None, output: str | None = None) -> DataFrame:
    """Natural log, or log to ``argument``; non-positive input → NULL."""
    c = F.col(column)
    e = F.ln(c) if argument is None else F.log(float(_finite(argument, "log")), c)
    return with_result(df, column, F.when(c > 0, e), output)


def num_clamp(df: DataFrame, column: str, low: float, high: float, output: str | None = None) -> DataFrame:
    """least(greatest(x, low), high) as DOUBLE. NULL becomes ``low`` because
    greatest/least skip NULLs (same in both engines)."""
    e = F.least(F.greatest(F.col(column).cast("double"), F.lit(float(low))), F.lit(float(high)))
    return with_result(df, column, e, output)


def num_sign(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{column}_sign", F.signum(F.col(column)).cast("int"))


def bucketize(df: DataFrame, column: str, low: float | None = None, high: float | None = None, buckets: int = 10,
              bounds=None, labels=None, output: str | None = None) -> DataFrame:
    """Equal-width buckets 0..N+1 (below low → 0, at/above high → N+1), or
    labelled half-open bins ``<b0``, ``b0-b1``, …, ``>=bN``."""
    out = output or f"{column}_bucket"
    x = F.col(column).cast("double")
    if bounds:
        bs = [float(b) for b in (bounds.split(",") if isinstance(bounds, str) else bounds)]
        labs = list(labels or [])
        if labs and len(labs) != len(bs) + 1:
            raise ValueError(f"bucketize: labels must have {len(bs) + 1} entries")

        def g(v: float) -> str:
            return str(int(v)) if float(v).is_integer() else repr(v)

        def lab(i: int, auto: str) -> str:
            return labs[i] if labs else auto

        e = F.when(F.col(column).isNull(), F.lit(None).cast("string"))
        e = e.when(x < bs[0], F.lit(lab(0, f"<{g(bs[0])}")))
        for i in range(1, len(bs)):
            e = e.when(x < bs[i], F.lit(lab(i, f"{g(bs[i - 1])}-{g(bs[i])}")))
        return df.withColumn(out, e.otherwise(F.lit(lab(len(bs), f">={g(bs[-1])}"))))
    low, high = float(low), float(high)
    if high <= low:
        raise ValueError("bucketize: high must exceed low")
    n = int(buckets) if buckets and int(buckets) > 0 else 10
    step = (high - low) / n
    e = (F.when(x < low, F.lit(0)).when(x >= high, F.lit(n + 1))
         .otherwise(F.floor((x - low) / step).cast("int") + 1))
    return df.withColumn(out, e)
