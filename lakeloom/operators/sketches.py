"""Stored, mergeable summaries: HyperLogLog for distinct counts, KLL for quantiles.

A sketch per group is a few kilobytes, whatever the group's size. Sketches of the finest
groups (a day, a shard) are written once; coarser groups and longer spans are merged from
them without reading the rows again. Merging gives what a sketch over all rows gives, up
to the sketch's own error: about 1.04 / sqrt(2^lg_k) of a distinct count, and about
1.7 / k^0.9 in rank for a quantile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, StringType

from lakeloom.core import col_list

LG_K, K = 12, 400


def _hashable(df: DataFrame, column: str) -> Column:
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, IntegralType):
        return c.cast("bigint")
    return c if isinstance(kind, (StringType, BinaryType)) else c.cast("string")


def sketch_groups(df: DataFrame, group_by, distinct=(), quantiles=(), lg_k: int = LG_K, k: int = K) -> DataFrame:
    """Per group: ``rows``, ``<column>_hll`` for each distinct column and ``<column>_kll``
    for each quantile column. Nulls are in neither."""
    out = [F.count(F.lit(1)).alias("rows")]
    out += [F.hll_sketch_agg(_hashable(df, c), F.lit(lg_k)).alias(f"{c}_hll") for c in col_list(distinct)]
    # a null would end as one more value: an aggregate skips it
    out += [F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), F.lit(k)).alias(f"{c}_kll") for c in col_list(quantiles)]
    return df.groupBy(*col_list(group_by)).agg(*out)


def merge_groups(sketches: DataFrame, group_by=None) -> DataFrame:
    """Sketches of coarser groups (of everything without ``group_by``)."""
    out = [F.sum("rows").alias("rows")]
    out += [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.endswith("_hll")]
    out += [F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.endswith("_kll")]
    keys = col_list(group_by)
    return sketches.groupBy(*keys).agg(*out) if keys else sketches.agg(*out)


def distinct_estimate(column: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(f"{column}_hll"), F.lit(0))


def quantile_estimate(column: str, quantile: float) -> Column:
    """Null where a group has no value."""
    c = F.col(f"{column}_kll")
    return F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(float(quantile))))
