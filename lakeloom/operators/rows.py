"""Row selection: sort, limit, top-k, sampling, distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType, DecimalType, DoubleType, FloatType, IntegralType, LongType, MapType, TimestampNTZType, TimestampType, VariantType,
)

from lakeloom.core import col_list, global_row_number, require_cols
from lakeloom.operators import selection


def order_spec(order_by, nulls_last: bool = True) -> list[Column]:
    """``[("col", "desc"), "col2"]`` or ``"a desc, b"`` → Columns with an
    explicit NULL order (Spark's ascending default is NULLS FIRST)."""
    if isinstance(order_by, str):
        order_by = [tuple(p.split()) if len(p.split()) > 1 else p.strip() for p in order_by.split(",") if p.strip()]
    out = []
    for item in order_by or []:
        if isinstance(item, Column):
            out.append(item)
            continue
        if isinstance(item, dict):
            name, direction = item["column"], item.get("direction", "asc")
        elif isinstance(item, (tuple, list)):
            name, direction = item[0], item[1] if len(item) > 1 else "asc"
        else:
            name, direction = item, "asc"
        c = F.col(name)
        desc = str(direction).lower().startswith("desc")
        if desc:
            out.append(c.desc_nulls_last() if nulls_last else c.desc_nulls_first())
        else:
            out.append(c.asc_nulls_last() if nulls_last else c.asc_nulls_first())
    return out


def sort_rows(df: DataFrame, order_by, nulls_last: bool = True) -> DataFrame:
    return df.orderBy(*order_spec(order_by, nulls_last))


def limit_rows(df: DataFrame, limit: int = 100) -> DataFrame:
    return df.limit(int(limit))


#: Rows that a task may hold for a merge of top lists; beyond it rows are selected by counting.
BUFFER = 100_000


def top_n(df: DataFrame, n: int = 100, order_by=None) -> DataFrame:
    """ORDER BY … LIMIT n. Ties at the edge fall in the order of all columns. Up to
    ``BUFFER`` rows: a top-n per partition, then their merge; beyond it the n-th key is
    found by counting (``selection``), and only the selected rows are sorted."""
    spec = order_spec(order_by)
    named = _named_order(df, order_by)
    if not spec or int(n) <= BUFFER or named is None:
        return (df.orderBy(*spec, *_sortable(df)) if spec else df).limit(int(n))
    return selection.first_rows(df, named + _by_all(df), int(n)).orderBy(*spec, *_sortable(df))


def _named_order(df: DataFrame, order_by, down: bool = False) -> list | None:
    """(column, type, descending) of an order given by names, or None."""
    if isinstance(order_by, str):
        order_by = [tuple(p.split()) for p in order_by.split(",") if p.strip()]
    out = []
    for item in order_by or []:
        if isinstance(item, Column):
            return None
        name, way = (item, None) if isinstance(item, str) else (item["column"], item.get("direction")) if isinstance(item, dict) \
            else (item[0], item[1] if len(item) > 1 else None)
        kind = df.schema[name].dataType
        if not selection.can_order(kind):
            return None
        out.append((F.col(f"`{name}`"), kind, str(way).lower().startswith("desc") if way else down))
    return out


def _by_all(df: DataFrame) -> list:
    return [(F.col(f"`{f.name}`"), f.dataType, False) for f in df.schema.fields if selection.can_order(f.dataType)]


def _sortable(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]


def _first_k_by(df: DataFrame, key: Column, k: int) -> DataFrame:
    """The ``k`` rows with the smallest ``key`` (a bigint), equal keys in the order of all columns."""
    if k <= BUFFER:
        return df.orderBy(key, *_sortable(df)).limit(k)
    return selection.first_rows(df, [(key, LongType(), False), *_by_all(df)], k)


def skip_rows(df: DataFrame, n: int = 100, order_by=None) -> DataFrame:
    """Rows after the first ``n`` in order. Numbered over range partitions
    (Spark's OFFSET would pull every row into one task)."""
    spec = order_spec(order_by)
    if not spec:
        return df.offset(int(n))
    numbered = global_row_number(df, spec, "__rn")
    return numbered.where(F.col("__rn") > int(n)).drop("__rn")


def sample_rows(df: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows chosen by a seeded row hash."""
    return _first_k_by(df, F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]), int(n))


def sample_percent(df: DataFrame, percent: float, method: str = "reservoir", seed: int = 42) -> DataFrame:
    """Reproducible percentage sample.

    ``bernoulli``: keep a row when its seeded hash falls under the rate; the
    choice depends only on the row, not on partitioning.
    ``reservoir``: exactly ``round(count * p)`` rows, the lowest seeded hashes, found
    by counting passes over the hash (no sort, no buffer of the sample)."""
    p = float(percent) / 100.0
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    if method == "bernoulli":
        return df.where(F.pmod(h, F.lit(1_000_000)) < F.lit(int(round(p * 1_000_000))))
    if method != "reservoir":
        raise ValueError(f"sample_percent: unknown method {method!r}")
    k = int(round(df.count() * p))
    return selection.first_rows(df, [(h, LongType(), False), *_by_all(df)], k)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def _sort_key(name: str, desc: bool, kind) -> list[Column] | None:
    """Struct fields that order like ``name ASC/DESC NULLS LAST`` under plain ascending
    struct comparison. Whole numbers are reversed by their complement, which the smallest
    one has as well; among doubles NaN is the largest."""
    c = F.col(f"`{name}`")
    if not desc:
        return [F.isnull(c), c]
    if isinstance(kind, IntegralType):
        return [F.isnull(c), F.bitwise_not(c)]
    if isinstance(kind, (FloatType, DoubleType)):
        return [F.isnull(c), ~F.isnan(c), -c]
    if isinstance(kind, DecimalType):
        return [F.isnull(c), -c]
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return [F.isnull(c), F.bitwise_not(F.unix_micros(c.cast("timestamp")))]
    if isinstance(kind, DateType):
        return [F.isnull(c), F.bitwise_not(F.unix_date(c))]
    return None


def distinct_on(df: DataFrame, columns, order_by=None) -> DataFrame:
    """One row per key: the first row by ``order_by`` then all columns
    (NULLS LAST), i.e. ``DISTINCT ON (keys) … ORDER BY keys, order…, all``.

    Built as a grouped ``min(struct(sort keys, row))``: partial aggregation
    runs map-side, so a key holding a third of the table is reduced before
    the shuffle instead of being sorted in one task."""
    keys = col_list(columns)
    if not keys:
        return df.distinct()
    require_cols(df, keys, "distinct_on")
    order = []
    if order_by:
        if isinstance(order_by, str):
            order_by = [tuple(p.split()) if len(p.split()) > 1 else p.strip() for p in order_by.split(",") if p.strip()]
        for item in order_by:
            name, direction = (item, "asc") if isinstance(item, str) else (item[0], item[1] if len(item) > 1 else "asc")
            order.append((name, str(direction).lower().startswith("desc")))
    # DESC on a type with no order-reversing map (e.g. text): narrow the rows column by
    # column to each key's best value (a grouped max/min, which skips NULLs = NULLS LAST,
    # joined back). Aggregations and joins only, so a hot key is never sorted by one task.
    cur = df
    last = max((i + 1 for i, (c, desc) in enumerate(order) if _sort_key(c, desc, df.schema[c].dataType) is None), default=0)
    for name, desc in order[:last]:
        best = (cur.groupBy(*keys).agg((F.max if desc else F.min)(F.col(name)).alias("__best"))
                .select(*[F.col(k).alias(f"__bk{i}") for i, k in enumerate(keys)], "__best"))
        cond = [F.col(k).eqNullSafe(F.col(f"__bk{i}")) for i, k in enumerate(keys)]
        cur = (cur.join(best, cond).where(F.col(name).eqNullSafe(F.col("__best")))
               .select(*[F.col(f"`{c}`") for c in df.columns]))
    rest = [c for c in df.columns if c not in keys]
    fields = [p for name, desc in order[last:] + [(c, False) for c in rest] for p in _sort_key(name, desc, df.schema[name].dataType)]
    packed = F.struct(*[p.alias(f"k{i}") for i, p in enumerate(fields)], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    agg = cur.groupBy(*keys).agg(F.min(packed).alias("__m"))
    return agg.select(*keys, *[F.col(f"__m.row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def rank_filter(df: DataFrame, partition_by, order_by, n: int = 10, desc: bool = True) -> DataFrame:
    """Top ``n`` rows per group by ``row_number``. ``order_by`` may give a
    direction per column (``"price desc, id asc"``); columns without one follow
    ``desc``.

    Spark plans a partial WindowGroupLimit before the shuffle, so each map
    task forwards at most ``n`` rows per key (skew-safe); without a partition
    this is ``top_n``."""
    keys = col_list(partition_by)
    items = [p for p in order_by.split(",") if p.strip()] if isinstance(order_by, str) else order_by
    spec = []
    for item in items:
        name, *way = item.split() if isinstance(item, str) else item
        down = str(way[0]).lower().startswith("desc") if way else desc
        spec.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last())
    if not keys:
        named = _named_order(df, items, desc)
        if int(n) <= BUFFER or named is None:
            return df.orderBy(*spec, *_sortable(df)).limit(int(n))
        return selection.first_rows(df, named + _by_all(df), int(n))
    w = Window.partitionBy(*keys).orderBy(*spec)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= int(n)).drop("__rn")
