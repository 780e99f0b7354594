"""Records of delimited files as text, read in parallel.

Files are read by the text reader, so large ones are split. Leading lines are skipped by
their place in a file's first block. A line end inside quotes belongs to the record: each
block's quotes are counted, the counts are chained in file order, and every block then
knows whether it begins inside quotes; a record that crosses a block's
border is put together from its pieces. Short records are padded after their fields are
counted outside quotes, so the parser may stay strict."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                        F.monotonically_increasing_id().alias("at"))


def _without_first(lines: DataFrame, skip: int) -> DataFrame:
    """Lines after the first ``skip`` of each file, which must lie in its first block."""
    heads = lines.where("start = 0").groupBy("file").agg(F.min("at").alias("head"), F.max("at").alias("tail"))
    more = lines.where("start > 0").select("file").distinct().withColumn("more", F.lit(True))
    heads = heads.join(more, "file", "left").select("file", "head", F.when(
        F.col("more") & (F.col("tail") - F.col("head") < skip),
        F.raise_error(F.lit("skip_lines reaches beyond the first block of a file")).cast("boolean")).alias("bad"))
    kept = lines.join(heads.hint("broadcast"), "file", "left")  # one row a file, as the scan's own file list
    return kept.where(F.col("bad").isNull() & ((F.col("start") > 0) | (F.col("at") >= F.col("head") + skip))).drop("head", "bad")


def _joined(inside: dict, quote: str):
    """Whole records (last = true, origin = start), and pieces of those that cross blocks."""

    def run(batches):
        now, open_, parts, origin = None, False, [], None
        out: list = []

        def batch():
            columns = list(zip(*out)) or [[]] * 5
            out.clear()
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                              names=["file", "origin", "start", "whole", "value"])

        def flush():
            if parts:  # the block ends inside a record, or the file does
                out.append((now[0], origin, now[1], False, "\n".join(parts)))

        for b in batches:
            for value, *at in zip(*(b.column(c).to_pylist() for c in ("value", "file", "start"))):
                if at != now:
                    flush()
                    now, parts = at, []
                    open_, origin = inside[tuple(at)]
                    fresh = not open_
                parts.append(value)
                if value.count(quote) % 2:
                    open_ = not open_
                if not open_:
                    out.append((now[0], origin, now[1], fresh, "\n".join(parts)))
                    parts, origin, fresh = [], now[1], True
            if len(out) > 4096:
                yield batch()
        flush()
        yield batch()

    return run


def _whole_records(lines: DataFrame, quote: str) -> DataFrame:
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    counts = lines.groupBy("file", "start").agg(F.sum(quotes).alias("n")).collect()  # a row per block
    inside, now, open_, origin = {}, None, False, 0
    for file, start, n in sorted(counts):
        if file != now:
            now, open_ = file, False
        inside[file, start] = (open_, origin if open_ else start)
        if n:
            origin = start  # a record that is open at the block's end began after a quote of the block
        open_ ^= n % 2 == 1
    pieces = lines.select("value", "file", "start").mapInArrow(_joined(inside, quote), "file string, origin long, start long, whole boolean, value string")
    whole = pieces.where("whole").select("value")
    cut = pieces.where("not whole").groupBy("file", "origin").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda p: p["value"]), "\n").alias("value")).select("value")
    return whole.unionByName(cut)


def fields_of(value: Column, delimiter: str, quote: str) -> Column:
    """Fields of a record: delimiters outside quotes, and one."""
    q = "\\" + quote
    bare = F.regexp_replace(value, f"{q}([^{q}]|{q}{q})*{q}", "")
    return ((F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))) / len(delimiter) + 1).cast("int")


def records(spark: SparkSession, path: str, quote: str = '"', skip_lines: int = 0, multi_line: bool = False) -> DataFrame:
    """``value``: the records of all files."""
    lines = _lines(spark, path)
    if skip_lines:
        lines = _without_first(lines, skip_lines)
    return _whole_records(lines, quote) if multi_line else lines.select("value")


def padded(rows: DataFrame, delimiter: str, quote: str, fields: int, null_value: str = "") -> DataFrame:
    """Records of fewer fields than ``fields`` with empty ones (``null_value``) at the end."""
    missing = F.greatest(F.lit(0), fields - fields_of(F.col("value"), delimiter, quote))
    return rows.select(F.when(F.col("value") == "", F.col("value"))
                       .otherwise(F.concat("value", F.repeat(F.lit(delimiter + null_value), missing))).alias("value"))


def parse(reader, rows: DataFrame) -> DataFrame:
    """Spark's CSV parser over a frame of records."""
    spark = rows.sparkSession
    texts = getattr(rows.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(texts), spark)
