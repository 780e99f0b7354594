"""Token counts per document from flat, unindexed token files.

``write_token_files`` writes documents as raw little-endian ids, one after the
other, each closed by the end-of-document id; nothing says where a document
begins. A document opens with its doc_id as ``HEADER`` ids of 15 bits (below any
separator), so a file needs no list of names. Spark's text writer puts the bytes
out unchanged (its line separator is the end-of-document id), so files may lie in
any store that Spark writes to.

``scan_token_files`` reads the files in blocks of ``block_tokens`` ids. A block's
task searches all separators at once and returns the documents that begin and end
in it, its first separator, and the start of the document left open at its end. A
prefix scan over a file's blocks (the last open start before each block) closes the
documents that cross block borders, however many blocks they span.

Defined results: null and empty texts count 0; a null doc_id stays null; repeated
rows are separate documents; an empty table gives no rows; extra columns are not
read. Files are read whole by a task before they are cut, so the writer bounds
them by its input splits and ``docs_per_file``.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch
from .registry import query, table
from .word_tokens import tokenizer_for

VOCABULARY = "word_bpe_49k.json"
SEPARATOR = 49407
HEADER = 5  # ids before a document's tokens: its doc_id in 15-bit digits, bit 74 set for null
DTYPE = "<u2"


def header(doc_id: int | None) -> np.ndarray:
    value = 1 << 74 if doc_id is None else doc_id & ((1 << 64) - 1)
    return np.array([(value >> (15 * i)) & 0x7FFF for i in range(HEADER)], DTYPE)


def read_headers(digits: np.ndarray) -> list[int | None]:
    """doc_ids of rows of HEADER digits."""
    d = digits.astype(np.uint64)
    value = d[:, 0] | d[:, 1] << np.uint64(15) | d[:, 2] << np.uint64(30) | d[:, 3] << np.uint64(45) | d[:, 4] << np.uint64(60)
    null = (d[:, 4] >> np.uint64(14)) == 1
    return [None if n else v for n, v in zip(null.tolist(), value.view(np.int64).tolist())]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, docs_per_file: int = 100_000) -> None:
    """Flat token files of ``docs`` (doc_id, text) under ``path``."""

    def run(batches):
        tokenizer = tokenizer_for(vocabulary, special_as_text=True)
        if tokenizer.size > SEPARATOR + 1:
            raise ValueError("the separator is an id of the vocabulary")
        for batch in batches:
            ids = tokenizer.encode([t or "" for t in batch.column("text").to_pylist()])
            rows = [header(i).tobytes() + x.astype(DTYPE).tobytes() for i, x in zip(batch.column("doc_id").to_pylist(), ids)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    separator = np.array([SEPARATOR], DTYPE).tobytes().decode("latin-1")
    (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "ids binary")
     .select(F.col("ids").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", separator)
     .option("maxRecordsPerFile", docs_per_file).text(path))


BLOCKS = ("file string, block long, first_end long, open_start long, open_id long, open_null boolean, "
          "ids array<long>, counts array<long>")


def scan_blocks(block_tokens: int):
    """Blocks (file, block, last, bytes with HEADER ids of overlap) -> BLOCKS."""

    def run(batches):
        for batch in batches:
            out = []
            for file, block, last, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "last", "bytes"))):
                ids = np.frombuffer(raw, DTYPE)
                base = block * block_tokens
                ends = np.flatnonzero(ids[:block_tokens] == SEPARATOR)
                starts = ends + 1
                if block == 0:
                    starts = np.concatenate([[0], starts])
                    first_end, inner = None, ends
                else:
                    first_end, inner = (base + int(ends[0]) if len(ends) else None), ends[1:]
                closed = starts[:len(inner)]
                names = read_headers(ids[closed[:, None] + np.arange(HEADER)]) if len(closed) else []
                opened, name = None, None
                if len(starts) > len(inner) and not (last and starts[-1] >= len(ids)):
                    opened = base + int(starts[-1])
                    name = read_headers(ids[starts[-1]:starts[-1] + HEADER][None, :])[0]
                out.append((file, block, first_end, opened, name, opened is not None and name is None, names,
                            (inner - closed - HEADER).tolist()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("file", "block", "first_end", "open_start", "open_id", "open_null", "ids", "counts"), r)) for r in out],
                schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("first_end", pa.int64()), ("open_start", pa.int64()),
                                  ("open_id", pa.int64()), ("open_null", pa.bool_()), ("ids", pa.list_(pa.int64())),
                                  ("counts", pa.list_(pa.int64()))]))

    return run


def scan_token_files(spark: SparkSession, path: str, block_tokens: int = 1 << 19) -> DataFrame:
    """(doc_id, n_tokens) of every document in the flat files under ``path``."""
    size = np.dtype(DTYPE).itemsize
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                           T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = spark.read.format("binaryFile").schema(schema).load(path).where("length > 0")
    step = block_tokens * size
    blocks = (files.select(F.col("path").alias("file"), "length", "content",
                           F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")).alias("block"))
              .select("file", "block", (F.col("block") == F.expr(f"(length - 1) div {step}")).alias("last"),
                      F.expr(f"substring(content, int(block * {step} + 1), {step + HEADER * size})").alias("bytes")))
    scanned = blocks.mapInArrow(scan_blocks(block_tokens), BLOCKS)
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("open_start").isNotNull(), F.struct(F.col("open_start").alias("start"), F.col("open_id").alias("id")))
    carried = F.last(opened, ignorenulls=True).over(order)
    item = "array<struct<doc_id:bigint,n_tokens:bigint>>"
    inner = F.zip_with("ids", "counts", lambda i, n: F.struct(i.alias("doc_id"), n.alias("n_tokens")))
    crossing = F.when(F.col("first_end").isNotNull(), F.array(F.struct(
        F.col("carried.id").alias("doc_id"), (F.col("first_end") - F.col("carried.start") - HEADER).alias("n_tokens"))))
    return (scanned.withColumn("carried", carried)
            .select(F.explode(F.concat(inner.cast(item), F.coalesce(crossing.cast(item), F.array().cast(item)))).alias("d"))
            .select("d.doc_id", "d.n_tokens"))


@query("op8_token_counts")
def op8_token_counts(spark, d):
    path = scratch(spark, "tokens")
    write_token_files(table(spark, d, "documents"), path, public_tokenizers.path(VOCABULARY))
    return scan_token_files(spark, path)
