"""Shared building blocks: reject splits, in-place results, run gates,
format translation and scalable global numbering."""

from __future__ import annotations

import re
from typing import Iterable, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Split(NamedTuple):
    """Two outputs of one parent: rows that passed and rows that were rejected.

    Both are lazy filters of the same parent plan; ``passed ∪ rejected`` is
    always the input because the predicate is NULL-safe (NULL → rejected)."""

    passed: DataFrame
    rejected: DataFrame


def col_list(cols) -> list[str]:
    """Accept ``"a, b"``, ``["a", "b"]`` or ``None``."""
    if cols is None:
        return []
    if isinstance(cols, str):
        return [c.strip() for c in cols.split(",") if c.strip()]
    return [c for c in cols if c]


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.expr(c) if _looks_like_expr(c) else F.col(c)


def _looks_like_expr(s: str) -> bool:
    return not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", s)


def split_by(df: DataFrame, predicate) -> Split:
    """NULL-safe predicate split: pass = coalesce(p, false), reject = the rest."""
    p = F.coalesce(as_col(predicate) if isinstance(predicate, (str, Column)) else predicate, F.lit(False))
    return Split(df.where(p), df.where(~p))


def with_result(df: DataFrame, column: str, expr: Column, output: str | None = None) -> DataFrame:
    """Write ``expr`` to ``output``, or replace ``column`` in place."""
    return df.withColumn(output or column, expr)


def require_cols(df: DataFrame, cols: Iterable[str], what: str = "operator") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: unknown column(s) {missing}; available {df.columns}")


def gated(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Pass ``df`` through, failing the job when the one-row ``stats`` frame
    has ``__fail = true``; ``__msg`` is the error text.

    ``stats`` is a global aggregate (one row), so the broadcast is bounded by
    construction. ``raise_error`` sits inside the filter, so the check fires
    however the result is consumed (count, collect, write)."""
    cols = df.columns
    s = F.broadcast(stats.select(F.col("__fail"), F.col("__msg")))
    return (
        df.crossJoin(s)
        .where(F.when(F.col("__fail"), F.raise_error(F.col("__msg"))).otherwise(F.lit(True)))
        .select(*cols)
    )


# ---------------------------------------------------------------------------
# strftime → Java DateTimeFormatter pattern
# ---------------------------------------------------------------------------

# Strftime directive → Java pattern letters.
STRFTIME_TO_JAVA = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%e": "d", "%H": "HH",
    "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM",
    "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%z": "XX", "%Z": "zzz",
    "%%": "%", "%T": "HH:mm:ss", "%D": "MM/dd/yy", "%F": "yyyy-MM-dd",
    "%-d": "d", "%-m": "M", "%-H": "H", "%-I": "h", "%-M": "m", "%-S": "s",
}


def strptime_to_java(fmt: str) -> str:
    """Translate a C strftime/strptime pattern to a Java pattern.

    Literal text is quoted; directives with no Java equivalent raise."""
    out = []
    literal = []
    i = 0

    def flush():
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append(f"'{text}'" if re.search(r"[A-Za-z]", text) else text)
            literal.clear()

    while i < len(fmt):
        if fmt[i] == "%":
            tok = fmt[i:i + 3] if fmt[i + 1:i + 2] == "-" else fmt[i:i + 2]
            if tok not in STRFTIME_TO_JAVA:
                raise ValueError(f"format directive {tok!r} has no Spark equivalent")
            flush()
            java = STRFTIME_TO_JAVA[tok]
            out.append("%" if tok == "%%" else java)
            i += len(tok)
        else:
            literal.append(fmt[i])
            i += 1
    flush()
    return "".join(out)


# ---------------------------------------------------------------------------
# Global (unpartitioned) ordered numbering without a single-task window.
# ---------------------------------------------------------------------------

def _order_cols(order: list) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, Column):
            out.append(o)
        else:
            out.append(F.col(o).asc_nulls_last())
    return out


def range_numbered(
    df: DataFrame, order: list, num_partitions: int | None = None, split_ties: bool = False
) -> DataFrame:
    """Range-partition ``df`` on ``order`` and add ``__pid`` (partition id) and
    ``__lrn`` (row number inside the partition), checkpointed so that the
    partition assignment is stable under task retries.

    Equal keys always land in the same range partition, so partition-local
    ranks plus per-partition offsets give exact global ranks. Only one row
    per partition ever reaches the offset computation."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _order_cols(order)
    if split_ties:
        # row_number may order ties arbitrarily: a row hash as last key lets
        # one hot key spread over several range partitions.
        ordered = ordered + [F.xxhash64(*[F.col(c) for c in df.columns])]
    # Sorted partitions are stored; a monotonic id then holds the partition in its
    # upper bits and the place in it in the lower 33: no second shuffle.
    ranged = df.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered)
    ranged = ranged.withColumn("__at", F.monotonically_increasing_id()).checkpoint(eager=True)
    return (ranged.withColumn("__pid", F.shiftright("__at", 33).cast("int"))
            .withColumn("__lrn", (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).drop("__at"))


def partition_offsets(numbered: DataFrame, extra_aggs: dict | None = None) -> DataFrame:
    """One row per range partition: ``__pid``, ``__cnt`` and ``__off`` (rows in
    earlier partitions). Size is bounded by the partition count."""
    aggs = [F.count(F.lit(1)).alias("__cnt")]
    for name, c in (extra_aggs or {}).items():
        aggs.append(c.alias(name))
    per = numbered.groupBy("__pid").agg(*aggs)
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # The window below runs over at most `num_partitions` rows.
    return per.withColumn("__off", F.coalesce(F.sum("__cnt").over(w), F.lit(0)))


def global_row_number(df: DataFrame, order: list, output: str = "row_number") -> DataFrame:
    """Exact ``row_number() OVER (ORDER BY order)`` across the whole frame,
    computed with range partitions instead of one task."""
    numbered = range_numbered(df, order, split_ties=True)
    offs = partition_offsets(numbered)
    return (
        numbered.join(F.broadcast(offs.select("__pid", "__off")), "__pid")
        .withColumn(output, (F.col("__lrn") + F.col("__off")).cast("bigint"))
        .drop("__pid", "__lrn", "__off")
    )


def checkpoint_dir(spark: SparkSession) -> str:
    d = spark.sparkContext.getCheckpointDir()
    if not d:
        from lakeloom.session import ensure_checkpoint_dir

        d = ensure_checkpoint_dir(spark)
    return d
