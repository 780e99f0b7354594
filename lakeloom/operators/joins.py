"""Equi joins, semi/anti, set operations, referential integrity, reconcile.

Join strategy is left to Catalyst + AQE: a side whose *measured* shuffle
size is under ``spark.sql.autoBroadcastJoinThreshold`` is broadcast at
runtime, anything larger stays a sort-merge join, and skewed partitions are
split by AQE's skew-join rule. No code here broadcasts a frame whose size
grows with the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.core import Split, col_list, require_cols

# Join type aliases.
_JOIN_TYPES = {
    "inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full",
    "full_outer": "full", "left_outer": "left", "right_outer": "right",
}


def join(df: DataFrame, other: DataFrame, left_key, right_key=None, join_type: str = "inner") -> DataFrame:
    """Equi join on composite keys.

    Same key names → one key column (USING). Different names → the key is
    ``coalesce(left, right)`` under the left name and the right key is
    dropped. Other name clashes get a ``_1`` suffix on the right side."""
    how = _JOIN_TYPES[join_type.lower()]
    lk = col_list(left_key)
    rk = col_list(right_key) or lk
    if len(lk) != len(rk) or not lk:
        raise ValueError("join: left and right keys must be non-empty and the same length")
    require_cols(df, lk, "join (left)")
    require_cols(other, rk, "join (right)")
    if lk == rk:
        clash = [c for c in other.columns if c in df.columns and c not in lk]
        o = other.withColumnsRenamed({c: f"{c}_1" for c in clash}) if clash else other
        return df.join(o, lk, how)
    clash = [c for c in other.columns if c in df.columns and c not in rk]
    o = other.withColumnsRenamed({c: f"{c}_1" for c in clash}) if clash else other
    l, r = df.alias("__l"), o.alias("__r")
    cond = reduce(lambda a, b: a & b, [F.col(f"__l.{a}") == F.col(f"__r.{b}") for a, b in zip(lk, rk)])
    joined = l.join(r, cond, how)
    keys = [F.coalesce(F.col(f"__l.{a}"), F.col(f"__r.{b}")).alias(a) for a, b in zip(lk, rk)]
    rest_l = [F.col(f"__l.{c}") for c in df.columns if c not in lk]
    rest_r = [F.col(f"__r.{c}") for c in o.columns if c not in rk]
    return joined.select(*keys, *rest_l, *rest_r)


def join_inner(df, other, left_key, right_key=None):
    return join(df, other, left_key, right_key, "inner")


def join_left(df, other, left_key, right_key=None):
    return join(df, other, left_key, right_key, "left")


def join_right(df, other, left_key, right_key=None):
    return join(df, other, left_key, right_key, "right")


def join_full(df, other, left_key, right_key=None):
    return join(df, other, left_key, right_key, "full")


def lookup(df: DataFrame, dim: DataFrame, left_key, right_key=None) -> DataFrame:
    """Left join to a dimension. AQE broadcasts ``dim`` when its measured
    size is under the threshold; a dimension that outgrows it stays a
    sort-merge join instead of overflowing executor memory."""
    return join(df, dim, left_key, right_key, "left")


def join_cross(df: DataFrame, other: DataFrame) -> DataFrame:
    """Cartesian product: output size is |df|·|other| by definition, so use
    only with a small, bounded ``other``."""
    return df.crossJoin(other)


def _key_cond(df: DataFrame, other: DataFrame, lk, rk) -> Column:
    return reduce(lambda a, b: a & b, [df[a] == other[b] for a, b in zip(lk, rk)])


def join_semi(df: DataFrame, other: DataFrame, left_key, right_key=None) -> DataFrame:
    """EXISTS: NULL keys never match; no fan-out."""
    lk, rk = col_list(left_key), col_list(right_key) or col_list(left_key)
    o = other.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(rk)])
    cond = reduce(lambda a, b: a & b, [df[a] == o[f"__k{i}"] for i, a in enumerate(lk)])
    return df.join(o, cond, "left_semi")


def join_anti(df: DataFrame, other: DataFrame, left_key, right_key=None) -> DataFrame:
    """NOT EXISTS: a NULL on the right never empties the result (unlike NOT IN)."""
    lk, rk = col_list(left_key), col_list(right_key) or col_list(left_key)
    o = other.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(rk)])
    cond = reduce(lambda a, b: a & b, [df[a] == o[f"__k{i}"] for i, a in enumerate(lk)])
    return df.join(o, cond, "left_anti")


def ref_integrity(df: DataFrame, other: DataFrame, left_key, right_key=None) -> Split:
    """Rows whose key exists in ``other`` pass; orphans (and NULL keys) reject."""
    return Split(join_semi(df, other, left_key, right_key), join_anti(df, other, left_key, right_key))


# ---------------------------------------------------------------------------
# Set operations (aligned by column NAME)
# ---------------------------------------------------------------------------

def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL BY NAME; columns missing from an input are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


merge_streams = union_all


def intersect_rows(*frames: DataFrame) -> DataFrame:
    """DISTINCT intersection aligned by the first input's column names."""
    cols = frames[0].columns
    return reduce(lambda a, b: a.intersect(b.select(*cols)), frames[1:], frames[0].select(*cols))


def except_rows(*frames: DataFrame) -> DataFrame:
    cols = frames[0].columns
    return reduce(lambda a, b: a.subtract(b.select(*cols)), frames[1:], frames[0].select(*cols))


# ---------------------------------------------------------------------------
# Reconcile two tables
# ---------------------------------------------------------------------------

def reconcile(source: DataFrame, target: DataFrame, key_columns, measure_columns=None) -> DataFrame:
    """``metric, value`` rows comparing two tables on NULL-safe keys.

    One full outer join, one global aggregate (a single row), then
    ``stack`` to rows."""
    keys = col_list(key_columns)
    measures = col_list(measure_columns)
    s_side = source.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__sn"), *[F.sum(m).alias(f"__s_{m}") for m in measures]
    )
    t_side = target.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__tn"), *[F.sum(m).alias(f"__t_{m}") for m in measures]
    )
    s, t = s_side.alias("s"), t_side.alias("t")
    cond = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    j = s.join(t, cond, "full")
    sn, tn = F.col("__sn"), F.col("__tn")
    aggs = [
        F.coalesce(F.sum(sn), F.lit(0)).cast("double").alias("source_rows"),
        F.coalesce(F.sum(tn), F.lit(0)).cast("double").alias("target_rows"),
        F.coalesce(F.sum(F.when(tn.isNull(), sn)), F.lit(0)).cast("double").alias("rows_only_in_source"),
        F.coalesce(F.sum(F.when(sn.isNull(), tn)), F.lit(0)).cast("double").alias("rows_only_in_target"),
        # join pairs, as a row-level join would count them, without the fan-out
        F.coalesce(F.sum(sn * tn), F.lit(0)).cast("double").alias("keys_matched"),
    ]
    for m in measures:
        ssum = F.sum(F.col(f"__s_{m}")).cast("double")
        tsum = F.sum(F.col(f"__t_{m}")).cast("double")
        aggs += [ssum.alias(f"{m}_source_sum"), tsum.alias(f"{m}_target_sum"), (ssum - tsum).alias(f"{m}_difference")]
    one = j.agg(*aggs)
    names = one.columns
    stack = "stack({n}, {pairs}) as (metric, value)".format(
        n=len(names), pairs=", ".join(f"'{c}', `{c}`" for c in names)
    )
    return one.selectExpr(stack)
