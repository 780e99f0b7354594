"""Aggregation: group-by with named functions, rollup/cube/grouping sets,
ordered collections that keep NULLs, golden-record survivorship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.core import col_list, require_cols

# Aggregate function names accepted by group_by.
_AGG = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max,
    "count": F.count, "count_distinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct, "stddev": F.stddev_samp,
    "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop, "variance": F.var_samp,
    "var_samp": F.var_samp, "var_pop": F.var_pop, "first": F.first, "last": F.last,
    "any_value": F.any_value, "median": F.median, "mode": F.mode,
    "bool_and": F.bool_and, "bool_or": F.bool_or, "product": F.product,
    "string_agg": None, "list": None,
}


def agg_expr(func: str, column: str | None) -> Column:
    f = func.lower()
    if f == "count" and (column in (None, "", "*")):
        return F.count(F.lit(1))
    if f == "string_agg":
        return F.listagg(F.col(column), F.lit(","))
    if f == "list":
        return F.collect_list(F.col(column))
    if f not in _AGG:
        return F.expr(f"{func}({column})")
    return _AGG[f](F.col(column))


def default_alias(func: str, column: str | None) -> str:
    if column in (None, "", "*"):
        return f"{func.lower()}_all"
    return f"{func.lower()}_{column}"


def _aggs(aggregations) -> list[Column]:
    out = []
    for a in aggregations or []:
        func, column = a.get("func") or a.get("function"), a.get("column")
        if not func:
            raise ValueError(f"group_by: column {column!r} has no aggregate function")
        out.append(agg_expr(func, column).alias(a.get("output") or default_alias(func, column)))
    return out


def group_by(df: DataFrame, keys=None, aggregations=None, having: str | None = None) -> DataFrame:
    """GROUP BY with ``[{column, func, output}]``; no keys and no aggregations
    → ``row_count``. Partial aggregation runs before the shuffle."""
    ks = col_list(keys)
    aggs = _aggs(aggregations)
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("row_count")]
    out = df.groupBy(*ks).agg(*aggs) if ks else df.agg(*aggs)
    return out.where(F.expr(having)) if having else out


def rollup(df: DataFrame, keys, aggregations, with_grouping_id: bool = False) -> DataFrame:
    ks = col_list(keys)
    aggs = _aggs(aggregations) + ([F.grouping_id().alias("grouping_id")] if with_grouping_id else [])
    return df.rollup(*ks).agg(*aggs)


def cube(df: DataFrame, keys, aggregations, with_grouping_id: bool = False) -> DataFrame:
    ks = col_list(keys)
    aggs = _aggs(aggregations) + ([F.grouping_id().alias("grouping_id")] if with_grouping_id else [])
    return df.cube(*ks).agg(*aggs)


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregations) -> DataFrame:
    allk = []
    for s in sets:
        for k in s:
            if k not in allk:
                allk.append(k)
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in allk]).agg(*_aggs(aggregations))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def count_distinct(df: DataFrame, column: str, keys=None, output: str | None = None) -> DataFrame:
    return group_by(df, keys, [{"column": column, "func": "count_distinct", "output": output}])


def approx_distinct(df: DataFrame, column: str, keys=None, output: str | None = None, rsd: float = 0.01) -> DataFrame:
    ks = col_list(keys)
    e = F.approx_count_distinct(F.col(column), rsd).alias(output or f"approx_count_distinct_{column}")
    return df.groupBy(*ks).agg(e) if ks else df.agg(e)


def approx_quantile(df: DataFrame, column: str, quantile: float = 0.5, group_by=None, accuracy: int = 10000) -> DataFrame:
    """``{col}_q{pct}``; out-of-range quantile falls back to 0.5."""
    q = float(quantile)
    if not 0.0 <= q <= 1.0:
        q = 0.5
    name = f"{column}_q{int(round(q * 100))}"
    e = F.percentile_approx(F.col(column), F.lit(q), F.lit(accuracy)).alias(name)
    ks = col_list(group_by)
    return df.groupBy(*ks).agg(e) if ks else df.agg(e)


def _ordered_with_nulls(value: Column) -> Column:
    """Ordered array of ``value`` per group with NULLs kept (last).

    ``collect_list`` drops NULLs, so collect ``struct(isnull, value)`` and sort
    it; the flag sorts NULLs after every value."""
    packed = F.array_sort(F.collect_list(F.struct(F.isnull(value).alias("n"), value.alias("v"))))
    return F.transform(packed, lambda s: s["v"])


def collect_list(df: DataFrame, value_column: str, group_by=None, output: str = "items") -> DataFrame:
    ks = col_list(group_by)
    e = _ordered_with_nulls(F.col(value_column)).alias(output)
    return df.groupBy(*ks).agg(e) if ks else df.agg(e)


def json_array_agg(df: DataFrame, column: str, group_by=None) -> DataFrame:
    """Ordered JSON array text per group, NULLs kept as ``null``."""
    ks = col_list(group_by)
    e = F.to_json(_ordered_with_nulls(F.col(column))).alias(f"{column}_array")
    return df.groupBy(*ks).agg(e) if ks else df.agg(e)


def denormalize(df: DataFrame, group_by, aggregate_columns, separator: str = ", ") -> DataFrame:
    """Per group, each column's values joined in the order of the whole
    tuple so positions line up across columns; NULLs skipped per column."""
    ks = col_list(group_by)
    vals = col_list(aggregate_columns)
    # sort key per field is (is NULL, value): NULLS LAST within the tuple order
    fields = []
    for i, c in enumerate(vals):
        fields += [F.isnull(F.col(c)).alias(f"__n{i}"), F.col(c).alias(c)]
    packed = F.array_sort(F.collect_list(F.struct(*fields)))
    out = df.groupBy(*ks).agg(packed.alias("__rows"))

    def joined(c: str) -> Column:
        values = F.transform(F.col("__rows"), lambda r: r[c].cast("string"))
        return F.array_join(F.filter(values, lambda v: v.isNotNull()), separator).alias(c)

    return out.select(*ks, *[joined(c) for c in vals])


def survivor(df: DataFrame, group_by, rule: str = "most_frequent", recency_column: str | None = None) -> DataFrame:
    """Golden record: the rule picks each non-key column independently.

    ``most_recent``/``oldest`` use ``max_by``/``min_by`` over non-NULL values
    only (a NULL newest value does not erase an older known one)."""
    ks = col_list(group_by)
    require_cols(df, ks, "survivor")
    others = [c for c in df.columns if c not in ks]
    aggs = []
    for c in others:
        v = F.col(c)
        if rule == "most_frequent":
            e = F.mode(v, deterministic=True)
        elif rule in ("most_recent", "oldest"):
            if not recency_column:
                raise ValueError("survivor: most_recent/oldest need a recency column")
            if c == recency_column:
                e = F.max(v) if rule == "most_recent" else F.min(v)
            else:
                rc = F.when(v.isNotNull(), F.col(recency_column))
                e = F.max_by(v, rc) if rule == "most_recent" else F.min_by(v, rc)
        elif rule == "max":
            e = F.max(v)
        elif rule == "min":
            e = F.min(v)
        else:
            raise ValueError(f"survivor: unknown rule {rule!r}")
        aggs.append(e.alias(c))
    return df.groupBy(*ks).agg(*aggs)


def diff_summary(df: DataFrame, change_column: str = "change_type") -> DataFrame:
    """One row: added, removed, updated, total_changes, summary."""
    ct = F.col(change_column)
    s = df.agg(
        F.count_if(ct == "insert").alias("added"),
        F.count_if(ct == "delete").alias("removed"),
        F.count_if(ct == "update_postimage").alias("updated"),
    )
    s = s.withColumn("total_changes", F.col("added") + F.col("removed") + F.col("updated"))
    return s.withColumn(
        "summary",
        F.format_string("%d added, %d removed, %d updated", "added", "removed", "updated"),
    )
