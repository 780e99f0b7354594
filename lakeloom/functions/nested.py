"""JSON, struct and array functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lakeloom.core import col_list, with_result


def json_parse(df: DataFrame, column: str, output: str | None = None, strict: bool = True) -> DataFrame:
    """Text → VARIANT; bad JSON fails the job unless ``strict=False``."""
    f = F.parse_json if strict else F.try_parse_json
    return with_result(df, column, f(F.col(column).cast("string")), output)


def json_stringify(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    c = F.col(column)
    dtype = dict(df.dtypes)[column]
    e = c.cast("string") if dtype in ("string", "variant") else F.to_json(c)
    return with_result(df, column, e, output)


def _to_jsonpath(path: str) -> str:
    p = path.strip()
    return p if p.startswith("$") else "$." + p.lstrip(".")


def json_path(df: DataFrame, column: str, path: str, output: str | None = None, keep_quotes: bool = False) -> DataFrame:
    """Extract by JSONPath. Scalars come back as text; with ``keep_quotes``
    strings keep their JSON quotes (the source engine's json_extract form)."""
    if not path:
        raise ValueError("json_path: a path is required")
    jp = _to_jsonpath(path)
    if keep_quotes:
        e = F.expr(f"to_json(try_variant_get(try_parse_json(CAST(`{column}` AS STRING)), '{jp}'))")
    else:
        e = F.get_json_object(F.col(column).cast("string"), jp)
    return with_result(df, column, e, output)


def json_flatten(df: DataFrame, column: str) -> DataFrame:
    """Struct fields → top-level columns appended after the others."""
    dt = df.schema[column].dataType
    if not isinstance(dt, StructType):
        raise ValueError(f"json_flatten: {column} is not a struct")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column],
                     *[F.col(f"`{column}`.`{f.name}`").alias(f.name) for f in dt.fields])


def merge_patch_py(target: str | None, patch: str | None) -> str | None:
    """RFC 7396 JSON merge patch on text values."""
    if target is None and patch is None:
        return None

    def merge(t, p):
        if not isinstance(p, dict):
            return p
        out = dict(t) if isinstance(t, dict) else {}
        for k, v in p.items():
            if v is None:
                out.pop(k, None)
            else:
                out[k] = merge(out.get(k), v)
        return out

    t = json.loads(target) if target is not None else None
    p = json.loads(patch) if patch is not None else None
    if p is None:
        return json.dumps(t, separators=(",", ":"))
    return json.dumps(merge(t, p), separators=(",", ":"))


@F.pandas_udf(StringType())
def _merge_patch_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([merge_patch_py(x, y) for x, y in zip(a, b)], dtype="object")


def json_merge(df: DataFrame, column: str, second_column: str, output: str = "merged") -> DataFrame:
    """RFC 7396 merge patch (NULL in the patch deletes a key), per row in an
    Arrow-batched pandas UDF."""
    return df.withColumn(output, _merge_patch_udf(F.col(column).cast("string"), F.col(second_column).cast("string")))


def explode(df: DataFrame, column: str) -> DataFrame:
    """One row per element; NULL or empty arrays keep one NULL row; the
    exploded column moves first."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(F.explode_outer(F.col(column)).alias(column), *rest)


def arr_element(df: DataFrame, column: str, index: int = 1, output: str | None = None) -> DataFrame:
    """1-based; negative counts from the end; 0 or out of range → NULL."""
    i = int(index)
    e = F.lit(None) if i == 0 else F.try_element_at(F.col(column), F.lit(i))
    return with_result(df, column, e, output)


def arr_distinct(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return with_result(df, column, F.array_distinct(F.array_compact(F.col(column))), output)


def arr_contains(df: DataFrame, column: str, value, output: str | None = None) -> DataFrame:
    """FALSE (not NULL) for a NULL array."""
    return df.withColumn(output or f"{column}_contains", F.coalesce(F.array_contains(F.col(column), value), F.lit(False)))


def arr_length(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{column}_length", F.array_size(F.col(column)).cast("bigint"))


def zip_to_table(df: DataFrame, headings_column: str, values_column: str, headings: list[str] | None = None) -> DataFrame:
    """Headings array + array of row arrays → one row per inner array, one
    column per heading. Heading names come from one distinct pass (a small
    set: column names), unless given."""
    if headings is None:
        hs = df.select(F.explode(F.col(headings_column)).alias("h")).distinct().collect()
        headings = sorted(r["h"] for r in hs)
    rows = df.select(F.col(headings_column).alias("__h"), F.explode(F.col(values_column)).alias("__v"))
    m = rows.select(F.map_from_arrays(F.col("__h"), F.col("__v")).alias("__m"))
    return m.select(*[F.try_element_at(F.col("__m"), F.lit(h)).alias(h) for h in headings])


def unnest_struct_cols(df: DataFrame, columns) -> DataFrame:
    for c in col_list(columns):
        df = json_flatten(df, c)
    return df
