"""Projection, column maintenance and row filters (all Catalyst built-ins)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.core import Split, as_col, col_list, require_cols, split_by, strptime_to_java

# Declared type names → Spark SQL types.
TYPE_NAMES = {
    "string": "string", "int32": "int", "int64": "bigint", "float32": "float",
    "float64": "double", "bool": "boolean", "date": "date", "timestamp": "timestamp_ntz",
    "decimal": "decimal(18,4)", "binary": "binary", "json": "string", "time": "string",
    "integer": "int", "int": "int", "bigint": "bigint", "double": "double",
    "float": "float", "boolean": "boolean", "varchar": "string", "text": "string",
}


def spark_type(name: str) -> str:
    return TYPE_NAMES.get(name.lower().strip(), name)


def filter_rows(df: DataFrame, predicate: str | Column | None = None) -> DataFrame:
    """WHERE; an empty predicate keeps every row."""
    if predicate is None or (isinstance(predicate, str) and not predicate.strip()):
        return df
    return df.where(as_col(predicate))


def filter_split(df: DataFrame, predicate: str | Column) -> Split:
    """Filter with a reject output; NULL predicate rows are rejected."""
    return split_by(df, as_col(predicate))


def project(df: DataFrame, columns=None) -> DataFrame:
    cols = col_list(columns)
    return df.select(*cols) if cols else df


def drop_columns(df: DataFrame, columns) -> DataFrame:
    cols = col_list(columns)
    require_cols(df, cols, "drop_columns")
    return df.drop(*cols)


def reorder(df: DataFrame, columns) -> DataFrame:
    first = col_list(columns)
    require_cols(df, first, "reorder")
    return df.select(*first, *[c for c in df.columns if c not in first])


def parse_rename_pairs(mapping) -> list[tuple[str, str]]:
    """``{"old": "new"}``, ``[("old","new")]``, ``"old:new, a:b"`` or a JSON
    string. The first mapping for a column wins."""
    if isinstance(mapping, str):
        text = mapping.strip()
        if text.startswith("{") or text.startswith("["):
            mapping = json.loads(text)
        else:
            mapping = [tuple(p.split(":", 1)) for p in text.split(",") if ":" in p]
    pairs = list(mapping.items()) if isinstance(mapping, dict) else [tuple(p) for p in mapping]
    seen, out = set(), []
    for old, new in pairs:
        old, new = str(old).strip(), str(new).strip()
        if old and new and old not in seen:
            seen.add(old)
            out.append((old, new))
    return out


def read_rename_file(spark, path: str):
    """Pairs from a small mapping file: JSON, CSV rows ``old,new`` or YAML lines
    ``old: new``, by the file's ending."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.lower().endswith(".json"):
        return json.loads(text)
    mark = "," if path.lower().endswith(".csv") else ":"
    lines = [x for x in text.splitlines() if mark in x and not x.lstrip().startswith("#")]
    return [tuple(p.strip().strip("'\"") for p in x.split(mark, 1)) for x in lines]


def rename(df: DataFrame, mapping=None, mapping_file: str | None = None) -> DataFrame:
    """Rename old→new, by a mapping or a mapping file; renamed columns move to
    the end, others keep order."""
    if mapping_file is not None:
        mapping = read_rename_file(df.sparkSession, mapping_file)
    pairs = [(o, n) for o, n in parse_rename_pairs(mapping) if o in df.columns]
    renamed = dict(pairs)
    keep = [F.col(c) for c in df.columns if c not in renamed]
    moved = [F.col(o).alias(n) for o, n in pairs]
    return df.select(*keep, *moved)


def _cast_expr(c: Column, target: str, fmt: str | None, strict: bool) -> Column:
    t = spark_type(target)
    if fmt == "excel" and t in ("timestamp_ntz", "timestamp", "date"):
        # day serials; the fraction is the time of day
        days = c.cast("string").cast("double") if strict else c.cast("string").try_cast("double")
        moment = F.lit("1899-12-30").cast("timestamp_ntz") + F.make_dt_interval(secs=F.round(days * 86400, 6).cast("decimal(18,6)"))
        return moment.cast(t)
    if fmt and t in ("timestamp_ntz", "timestamp", "date"):
        java = strptime_to_java(fmt)
        if strict:
            parsed = F.to_timestamp_ntz(c.cast("string"), F.lit(java))
        else:
            parsed = F.try_to_timestamp(c.cast("string"), F.lit(java)).cast("timestamp_ntz")
        return parsed.cast("date") if t == "date" else parsed
    if strict:
        return c.cast(t)
    if t in ("int", "bigint", "smallint", "tinyint"):
        # Numeric text such as '2.7' becomes 3 (rounded), as the reference does.
        as_num = c.cast("string").try_cast("double")
        return F.when(as_num.isNotNull(), F.round(as_num).try_cast(t)).otherwise(c.try_cast(t))
    return c.try_cast(t)


def cast_columns(df: DataFrame, casts: list[dict], on_error: str = "null") -> DataFrame:
    """In-place casts. ``on_error``: ``null`` (try_cast) / ``reject`` (same as
    null) / ``fail`` (ANSI cast raises). Duplicate or blank column = error."""
    seen = set()
    for spec in casts:
        name = (spec.get("column") or "").strip()
        if not name:
            raise ValueError("cast_columns: blank column name")
        if name in seen:
            raise ValueError(f"cast_columns: column {name!r} listed twice")
        seen.add(name)
    require_cols(df, seen, "cast_columns")
    strict = on_error == "fail"
    exprs = {
        s["column"]: _cast_expr(F.col(s["column"]), s.get("targetType") or s.get("target_type"), s.get("format"), strict)
        for s in casts
    }
    return df.withColumns(exprs)


def add_columns(df: DataFrame, columns: list[dict], on_error: str = "null") -> DataFrame:
    """Computed columns ``[{name, expression, type?}]``."""
    exprs = {}
    for spec in columns:
        name, expression = spec.get("name"), spec.get("expression")
        if not name or not expression:
            raise ValueError(f"add_columns: column {name!r} needs an expression")
        e = F.expr(expression)
        if spec.get("type"):
            t = spark_type(spec["type"])
            e = e.cast(t) if on_error == "fail" else (e).try_cast(t)
        exprs[name] = e
    return df.withColumns(exprs)


def coalesce_cols(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Null-fill: ``name = <expression>`` where expression is usually coalesce(...)."""
    return df.withColumn(name, F.expr(expression))


# Comparison operator names.
COMPARE_OPS = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
}


def compare_columns(df: DataFrame, left: str, right: str, op: str = "eq") -> DataFrame:
    """Boolean ``{left}_{op}_{right}``; NULL if either side is NULL."""
    return df.withColumn(f"{left}_{op}_{right}", COMPARE_OPS[op](F.col(left), F.col(right)))


def add_uuid(df: DataFrame, output: str = "row_id") -> DataFrame:
    """Random UUID v4 per row. Non-deterministic: persist before reusing."""
    return df.withColumn(output, F.expr("uuid()"))


def _text_key(cols: list[str], sep: str) -> Column:
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])


def surrogate_key(
    df: DataFrame, key_columns, mode: str = "hash", separator: str = "||", output: str = "surrogate_key"
) -> DataFrame:
    """md5 of the joined text keys, or ``row_number() OVER (ORDER BY keys)``.

    The sequence form numbers rows with range partitions plus per-partition
    offsets, so it never funnels the table through one task."""
    keys = col_list(key_columns)
    if not keys:
        raise ValueError("surrogate_key: needs at least one key column")
    require_cols(df, keys, "surrogate_key")
    if mode == "hash":
        return df.withColumn(output, F.md5(_text_key(keys, separator)))
    if mode != "sequence":
        raise ValueError(f"surrogate_key: unknown mode {mode!r}")
    from lakeloom.core import global_row_number

    return global_row_number(df, keys, output)


# Digest algorithms.
def _digest(algorithm: str, text: Column) -> Column:
    a = algorithm.lower()
    if a == "md5":
        return F.md5(text)
    if a == "sha1":
        return F.sha1(text)
    if a == "sha256":
        return F.sha2(text, 256)
    if a == "hash":
        return F.xxhash64(text)
    raise ValueError(f"unknown hash algorithm {algorithm!r}")


def row_hash(df: DataFrame, columns=None, algorithm: str = "md5", output: str = "_row_hash") -> DataFrame:
    """Fingerprint over ``concat_ws('||', cols)``; NULLs are skipped."""
    cols = col_list(columns) or list(df.columns)
    return df.withColumn(output, _digest(algorithm, _text_key(cols, "||")))


def audit_stamp(
    df: DataFrame, loaded_at: bool = True, loaded_date: bool = False, source: str | None = None,
    batch_id: str | None = None,
) -> DataFrame:
    cols = {}
    if loaded_at:
        cols["_loaded_at"] = F.current_timestamp().cast("timestamp_ntz")
    if loaded_date:
        cols["_loaded_date"] = F.current_date()
    if source:
        cols["_source"] = F.lit(source)
    if batch_id:
        cols["_batch_id"] = F.lit(batch_id)
    if not cols:
        raise ValueError("audit_stamp: choose at least one stamp")
    return df.withColumns(cols)


def map_join(
    df: DataFrame, expressions: dict[str, str], lookups: list[dict] | None = None, filter: str | None = None
) -> DataFrame:
    """Projection over ``main`` plus keyed lookups ``lookup_1..N``.

    ``lookups=[{"df": frame, "left_key": "a", "right_key": "b", "join_type": "left"}]``;
    expressions reference ``main.col`` and ``lookup_1.col``. The join strategy
    is left to AQE, which broadcasts a lookup only when its measured size is
    under the broadcast threshold."""
    out = df.alias("main")
    for i, lk in enumerate(lookups or [], start=1):
        if lk.get("df") is None or not lk.get("left_key") or not lk.get("right_key"):
            raise ValueError(f"map_join: lookup_{i} is not wired or has no keys")
        name = f"lookup_{i}"
        right = lk["df"].alias(name)
        lks, rks = col_list(lk["left_key"]), col_list(lk["right_key"])
        cond = None
        for a, b in zip(lks, rks):
            c = F.col(f"main.{a}") == F.col(f"{name}.{b}")
            cond = c if cond is None else cond & c
        out = out.join(right, cond, lk.get("join_type", "left"))
    if filter:
        out = out.where(F.expr(filter))
    return out.select(*[F.expr(e).alias(n) for n, e in expressions.items()])


def fill_constant(df: DataFrame, column: str, value) -> DataFrame:
    t = dict(df.dtypes)[column]
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value).cast(t)))


def log_rows(df: DataFrame, name: str = "rows"):
    """Pass-through that reports its row count once an action runs.

    Returns ``(df, observation)``; ``observation.get["row_count"]`` is filled
    by the first action, with no extra job."""
    from pyspark.sql import Observation

    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("row_count")), obs
