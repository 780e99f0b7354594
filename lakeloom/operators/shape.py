"""Reshaping: pivot, unpivot, normalize (split + explode), transpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.core import col_list, require_cols
from lakeloom.operators.aggregate import agg_expr

# Spark refuses pivots wider than spark.sql.pivotMaxValues (10000 by default).


def pivot(df: DataFrame, pivot_column: str, value_column: str, aggregation: str = "sum", group_by=None,
          values: list | None = None) -> DataFrame:
    """Dynamic pivot: one output column per distinct non-NULL pivot value
    (sorted). Without ``group_by`` the other columns are the keys. Groups
    whose pivot value is always NULL still appear (with NULL cells)."""
    keys = col_list(group_by) or [c for c in df.columns if c not in (pivot_column, value_column)]
    if values is None:
        vals = df.where(F.col(pivot_column).isNotNull()).select(pivot_column).distinct().orderBy(pivot_column).collect()
        values = [r[0] for r in vals]
    a = agg_expr(aggregation, value_column)
    out = df.groupBy(*keys).pivot(pivot_column, values).agg(a)
    return out


def unpivot(df: DataFrame, columns, name_column: str = "name", value_column: str = "value") -> DataFrame:
    """Columns → (name, value) rows; NULL values are kept."""
    cols = col_list(columns)
    require_cols(df, cols, "unpivot")
    ids = [c for c in df.columns if c not in cols]
    return df.unpivot(ids, cols, name_column, value_column)


def normalize(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """Split a delimited text (or take an array when ``separator=''``) and
    explode outer; the column moves to the end."""
    src = F.col(column) if separator == "" else F.split(F.col(column).cast("string"), _literal(separator), -1)
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*rest, F.explode_outer(src).alias(column))


def _literal(sep: str) -> str:
    import re

    return re.escape(sep)


def transpose(df: DataFrame, order_by) -> DataFrame:
    """Columns → rows ``column_name, r1, r2, …`` with rows ordered by
    ``order_by``. Every input row becomes an output COLUMN, so the input is as
    long as a plan can be wide."""
    order = col_list(order_by)
    n = df.count()
    from lakeloom.core import global_row_number

    numbered = global_row_number(df, order, "__r")
    data_cols = [c for c in df.columns]
    long = numbered.select(
        "__r",
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v"))
                            for c in data_cols])).alias("__cv"),
    ).select("__r", "__cv.column_name", "__cv.v")
    wide = long.groupBy("column_name").pivot("__r", list(range(1, n + 1))).agg(F.first("v"))
    return wide.select("column_name", *[F.col(str(i)).alias(f"r{i}") for i in range(1, n + 1)])
