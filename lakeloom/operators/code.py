"""SQL and user-code surface: SQL over an input frame, parameterised
read-only SQL, named routines, per-row Python and batched model calls."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_READ_ONLY = re.compile(r"^\s*(with|select|values|from|\()", re.I)
_FORBIDDEN = re.compile(r";\s*\S|\b(insert|update|delete|merge|create|drop|alter|truncate|grant|call)\b", re.I)


def sql_node(spark: SparkSession, sql: str, input: DataFrame | None = None, **inputs: DataFrame) -> DataFrame:
    """Run a SELECT where the upstream frame is visible as ``input`` (and
    any extra frames under their keyword names). DataFrame parameters keep
    the whole thing one Catalyst plan."""
    frames = dict(inputs)
    if input is not None:
        frames["input"] = input
    text = sql
    for name in frames:
        text = re.sub(rf"(?<![\w{{]){re.escape(name)}(?![\w}}])", "{" + name + "}", text)
    return spark.sql(text, **frames)


def sql_template(spark: SparkSession, sql: str, args: dict | None = None, context: dict | None = None, **frames) -> DataFrame:
    """Parameterised single read-only SELECT: ``${context.var}`` values are
    substituted as text first, ``:name`` markers are bound as typed
    parameters (never string-spliced)."""
    text = sql
    for k, v in (context or {}).items():
        text = text.replace("${context." + k + "}", str(v))
    if not _READ_ONLY.match(text) or _FORBIDDEN.search(text):
        raise ValueError("sql_template: only a single read-only SELECT is allowed")
    if frames:
        for name in frames:
            text = re.sub(rf"(?<![\w{{]){re.escape(name)}(?![\w}}])", "{" + name + "}", text)
        return spark.sql(text, args=args or {}, **frames)
    return spark.sql(text, args=args or {})


def sql_routine(spark: SparkSession, name: str, params: list[str], body: str) -> None:
    """Register a reusable SQL function (``CREATE TEMPORARY FUNCTION ...
    RETURN``) that later queries can call by name."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(params)}) RETURN {body}")


def python_rows(df: DataFrame, process: Callable[[dict], dict | None], schema: StructType | str) -> DataFrame:
    """Apply ``process(row_dict) -> dict | None`` to each row; ``None`` drops
    the row. Runs per partition over Arrow batches, so NULLs reach ``process``
    as ``None`` and integers as integers."""
    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for r in map(process, batch.to_pylist()) if r is not None]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[list], list], input_column: str, output_column: str,
                output_type: str = "string", batch_size: int = 100, retries: int = 2) -> DataFrame:
    """Call ``fn(values) -> results`` on batches of ``batch_size`` values of
    one column (e.g. an embedding or classification model supplied by the
    user), with per-batch retries; adds ``output_column``."""
    schema = StructType.fromDDL(",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
                                + f",`{output_column}` {output_type}")

    def call(values: list) -> list:
        for attempt in range(retries + 1):
            try:
                res = list(fn(values))
                if len(res) != len(values):
                    raise ValueError("map_batches: function returned a different number of results")
                return res
            except Exception:  # noqa: BLE001
                if attempt == retries:
                    raise
        return []

    result = to_arrow_schema(schema).field(len(schema) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results: list = []
            vals = batch.column(input_column).to_pylist()
            for i in range(0, len(vals), batch_size):
                results.extend(call(vals[i:i + batch_size]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, result.type)],
                                             names=[*batch.schema.names, output_column])

    return df.mapInArrow(run, schema)
