"""Readers: every source is a lazy ``spark.read`` so filters and column
selection reach the scan (PushedFilters / ReadSchema in the plan)."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.core import checkpoint_dir, col_list, strptime_to_java
from lakeloom.sources import csv_records


def _apply_declared(df: DataFrame, declared: list[dict] | None) -> DataFrame:
    """A declared (possibly partial) schema overrides inferred types by
    column NAME with ``try_cast``; declared names absent from the file are
    ignored."""
    if not declared:
        return df
    from lakeloom.operators.columns import spark_type

    exprs = {}
    for c in declared:
        name = c["name"]
        if name not in df.columns:
            continue
        t = spark_type(c.get("type", "string"))
        fmt = c.get("format")
        if fmt and t in ("timestamp_ntz", "date"):
            parsed = F.try_to_timestamp(F.col(name).cast("string"), F.lit(strptime_to_java(fmt))).cast("timestamp_ntz")
            exprs[name] = parsed.cast("date") if t == "date" else parsed
        else:
            exprs[name] = (F.col(name)).try_cast(t)
    return df.withColumns(exprs) if exprs else df


def read_csv(
    spark: SparkSession, path: str, has_header: bool = True, delimiter: str = ",", quote_char: str = '"',
    null_value: str | None = None, skip_lines: int = 0, encoding: str = "UTF-8", ignore_errors: bool = False,
    filename: bool = False, date_format: str | None = None, timestamp_format: str | None = None,
    schema: StructType | str | None = None, columns: list[dict] | None = None, read_options: dict | None = None,
    null_padding: bool = False, multi_line: bool = False,
) -> DataFrame:
    """Delimited text. ``ignore_errors`` drops malformed rows, else the read
    fails fast; ``null_padding`` fills the missing fields of short rows with
    NULL and nothing else (surplus fields and unreadable values are malformed);
    ``skip_lines`` skips leading lines of each file; ``multi_line`` keeps line ends
    inside quotes. Files are split over tasks in every case (these three read UTF-8)."""
    r = spark.read.option("header", has_header).option("sep", delimiter).option("quote", quote_char)
    r = r.option("encoding", encoding).option("mode", "DROPMALFORMED" if ignore_errors else "FAILFAST")
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if date_format:
        r = r.option("dateFormat", strptime_to_java(date_format))
    if timestamp_format:
        r = r.option("timestampNTZFormat", strptime_to_java(timestamp_format))
    for k, v in (read_options or {}).items():
        r = r.option(k, v)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    if skip_lines or null_padding or multi_line:
        if filename or encoding.upper() not in ("UTF-8", "UTF8"):
            raise ValueError("read_csv: skip_lines, null_padding and multi_line read UTF-8 and give no file name")
        rows = csv_records.records(spark, path, quote_char, skip_lines, multi_line)
        if null_padding:
            if schema is not None:
                fields = len(spark.createDataFrame([], schema).columns)
            else:  # as many as the first record has
                first = rows.select(csv_records.fields_of(F.col("value"), delimiter, quote_char)).first()
                fields = first[0] if first else 1
            rows = csv_records.padded(rows, delimiter, quote_char, fields, null_value or "")
        df = csv_records.parse(r, rows)
    else:
        df = r.csv(path)
    if filename:
        df = df.withColumn("filename", F.col("_metadata.file_path"))
    return _apply_declared(df, columns)


def read_csv_split(spark: SparkSession, path: str, columns: list[dict], **kw):
    """Declared columns read as text; rows where every non-empty declared
    value parses pass (typed), others go raw to the reject output."""
    from lakeloom.core import Split
    from lakeloom.operators.columns import spark_type

    r = spark.read.option("header", kw.get("has_header", True)).option("sep", kw.get("delimiter", ","))
    r = r.option("quote", kw.get("quote_char", '"')).option("encoding", kw.get("encoding", "UTF-8"))
    if kw.get("null_value") is not None:
        r = r.option("nullValue", kw["null_value"])
    raw = r.csv(path)
    typed, bad = {}, []
    for c in columns:
        name = c["name"]
        if name not in raw.columns:
            continue
        t = spark_type(c.get("type", "string"))
        fmt = c.get("format")
        if fmt and t in ("timestamp_ntz", "date"):
            v = F.try_to_timestamp(F.col(name), F.lit(strptime_to_java(fmt))).cast("timestamp_ntz")
            v = v.cast("date") if t == "date" else v
        else:
            v = (F.col(name)).try_cast(t)
        typed[name] = v
        bad.append(F.col(name).isNotNull() & (F.trim(F.col(name)) != "") & v.isNull())
    is_bad = F.lit(False)
    for b in bad:
        is_bad = is_bad | b
    flagged = raw.withColumn("__bad", is_bad)
    return Split(flagged.where(~F.col("__bad")).withColumns(typed).drop("__bad"), flagged.where("__bad").drop("__bad"))


def read_tsv(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_csv(spark, path, delimiter="\t", **kw)


def read_parquet(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    cols = col_list(columns)
    return df.select(*cols) if cols else df


def _flatten(df: DataFrame) -> DataFrame:
    """Recursively lift struct fields to top-level columns ``a_b``."""
    while True:
        structs = [f for f in df.schema.fields if isinstance(f.dataType, StructType)]
        if not structs:
            return df
        sel = []
        for f in df.schema.fields:
            if isinstance(f.dataType, StructType):
                sel += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
            else:
                sel.append(F.col(f"`{f.name}`"))
        df = df.select(*sel)


def read_json(
    spark: SparkSession, path: str, format: str = "auto", ignore_errors: bool = False,
    records_path: str | None = None, schema: StructType | str | None = None,
) -> DataFrame:
    """JSON lines or arrays. ``records_path='a.b'`` unnests that array and
    flattens each record to columns."""
    multi = format in ("array", "object")
    if format == "auto":
        multi = _looks_like_json_document(spark, path)
    r = spark.read.option("multiLine", multi).option("mode", "DROPMALFORMED" if ignore_errors else "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    df = r.json(path)
    if records_path:
        df = df.select(F.inline(F.col(records_path)))
        df = _flatten(df)
    return df


def _looks_like_json_document(spark: SparkSession, path: str) -> bool:
    # One tiny read: a first line that is a whole JSON object means JSON lines.
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if not first:
        return False
    try:
        return not isinstance(json.loads(first[0][0]), dict)
    except ValueError:
        return True


def read_fixedwidth(spark: SparkSession, path: str, columns: list[dict], trim: bool = True) -> DataFrame:
    """Positional text: ``[{name, start (1-based), width}]``; right-trimmed strings."""
    lines = spark.read.text(path)
    out = []
    for c in columns:
        v = F.substring(F.col("value"), int(c["start"]), int(c["width"]))
        out.append((F.rtrim(v) if trim else v).alias(c["name"]))
    return lines.select(*out)


def read_xml(spark: SparkSession, path: str, row_path: str, schema: StructType | str | None = None) -> DataFrame:
    """A row per element whose path ends with ``row_path`` (``r/a/row`` leaves out
    ``r/b/row``; namespace prefixes do not count; an empty path takes the root elements).
    Attributes are ``@name`` columns, text beside them or beside children is ``_text``,
    children nest and repeated ones are arrays. Without a ``schema`` the rows are stored
    once and their types inferred."""
    from lakeloom.sources.xml_path import xml_rows

    rows = xml_rows(spark, path, row_path)
    if schema is not None:
        return rows.select(F.from_json("value", schema).alias("r")).select("r.*")
    at = f"{checkpoint_dir(spark).rstrip('/')}/xml-{uuid.uuid4().hex}"
    rows.write.text(at)
    return spark.read.json(at)


# URI schemes per cloud store.
_SCHEMES = {"s3": "s3a://", "minio": "s3a://", "r2": "s3a://", "b2": "s3a://", "gcs": "gs://",
            "azureblob": "abfss://", "http": "https://", "file": "file://"}


def resolve_uri(store: str, path: str | None = None, bucket: str | None = None, key: str | None = None) -> str:
    if path and re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path  # already a URI (s3a://, gs://, file:/...)
    base = _SCHEMES.get(store, "")
    if bucket:
        return f"{base}{bucket}/{(key or '').lstrip('/')}"
    return f"{base}{path}" if base and path and not path.startswith("/") else (f"file://{path}" if store == "file" else path)


def read_cloud(spark: SparkSession, store: str, path: str | None = None, bucket: str | None = None,
               key: str | None = None, **options) -> DataFrame:
    """Pick the reader by extension; avro/orc refused as in the source tool."""
    uri = resolve_uri(store, path, bucket, key)
    low = uri.lower().split("?")[0]
    if low.endswith((".csv", ".csv.gz")):
        return read_csv(spark, uri, **options)
    if low.endswith((".tsv", ".tsv.gz")):
        return read_tsv(spark, uri, **options)
    if low.endswith((".json", ".jsonl", ".ndjson", ".json.gz")):
        return read_json(spark, uri, **options)
    if low.endswith(".parquet") or low.endswith("/"):
        return read_parquet(spark, uri, options.get("columns"))
    raise ValueError(f"read_cloud: cannot tell the format of {uri!r}")


def read_jdbc(spark: SparkSession, url: str, table_name: str | None = None, schema_name: str | None = None,
              sql: str | None = None, partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, properties: dict | None = None) -> DataFrame:
    """Whole table or a custom query (the query wins). With a partition
    column and bounds the read is split into parallel range queries."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if sql:
        r = r.option("dbtable", f"({sql}) q")
    else:
        r = r.option("dbtable", f"{schema_name}.{table_name}" if schema_name else table_name)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions or 8))
    return r.load()


def read_iceberg(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("iceberg").load(path)


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("delta").load(path)


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("avro").load(path)


def read_kafka(spark: SparkSession, bootstrap: str, topic: str, start_offset: int = -2,
               max_records: int | None = None, partition: int | None = None) -> DataFrame:
    """Bounded Kafka read shaped as ``offset, timestamp_ms, key, value``.
    ``start_offset``: -2 earliest, -1 latest (a bounded read has nothing after
    it), n ≥ 0 from that offset in every partition read."""
    r = spark.read.format("kafka").options(**kafka_options(bootstrap, topic, start_offset, partition))
    return shape_kafka(r.load(), partition, max_records, start_offset)


def kafka_options(bootstrap: str, topic: str, start_offset: int = -2, partition: int | None = None) -> dict[str, str]:
    """Options of the bounded read. An offset map must name every partition
    read, so it is given only when one partition is assigned."""
    out = {"kafka.bootstrap.servers": bootstrap, "startingOffsets": "earliest"}
    if partition is None:
        return out | {"subscribe": topic}
    out["assign"] = json.dumps({topic: [partition]})
    if start_offset >= 0:
        out["startingOffsets"] = json.dumps({topic: {str(partition): start_offset}})
    return out


def shape_kafka(raw: DataFrame, partition: int | None = None, max_records: int | None = None, start_offset: int = -2) -> DataFrame:
    df = raw
    if partition is not None:
        df = df.where(F.col("partition") == partition)
    if start_offset == -1:
        df = df.where(F.lit(False))
    elif start_offset >= 0:
        df = df.where(F.col("offset") >= start_offset)
    df = df.select(
        F.col("offset"),
        (F.unix_millis(F.col("timestamp"))).alias("timestamp_ms"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )
    if max_records:
        df = df.orderBy("offset").limit(int(max_records))
    return df


def inspect(spark: SparkSession, path: str, format: str = "parquet", **options):
    """Schema plus an 8-row preview."""
    df = spark.read.format(format).options(**options).load(path)
    return df.schema, df.limit(8)
