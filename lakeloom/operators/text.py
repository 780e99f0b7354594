"""Text preparation: chunking (PII redaction, prompt templates and label
normalisation live in :mod:`lakeloom.functions.strings`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_list(text: str | None, size: int, overlap: int) -> list[str]:
    """Character windows of ``size`` with step ``max(size − overlap, 1)``,
    stopping at the window that reaches the end; at least one chunk (the
    whole text when it fits, '' for NULL/empty)."""
    s = text or ""
    if size <= 0 or len(s) <= size:
        return [s]
    step = max(size - overlap, 1)
    out, start, n = [], 0, len(s)
    while start < n:
        end = min(start + size, n)
        out.append(s[start:end])
        if end == n:
            break
        start += step
    return out


def chunk_array(text: Column, size: int, overlap: int) -> Column:
    """``chunk_list`` as a column. The text is cut once into pieces of one step, and a chunk
    is put together from the pieces it spans: substring() would walk the text from its start
    for every window, which is quadratic in the text length."""
    s = F.coalesce(text.cast("string"), F.lit(""))
    if size <= 0:
        return F.array(s)
    step = max(size - overlap, 1)
    spans = -(-size // step)
    pieces = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def chunks(cut: Column) -> Column:
        last = F.least(F.ceil((F.char_length(s) - size) / F.lit(step)).cast("int"), F.size(cut) - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.array_join(F.slice(cut, k + 1, F.lit(spans)), ""), 1, size))

    # the pieces are bound to a name, so that they are cut once a row
    return F.when(F.char_length(s) <= size, F.array(s)).otherwise(F.transform(F.array(pieces), chunks)[0])


def chunk_text(df: DataFrame, input_column: str = "text", chunk_size: int = 1000, chunk_overlap: int = 100,
               mode: str = "explode", output: str = "chunk") -> DataFrame:
    """``explode``: one row per chunk with ``chunk``, ``chunk_index`` (0-based)
    and ``chunk_count``; ``array``: the chunk array in ``output``."""
    arr = chunk_array(F.col(input_column), int(chunk_size), int(chunk_overlap))
    if mode == "array":
        return df.withColumn(output, arr)
    # the count is taken before the explode so exploded rows do not carry
    # the whole chunk array along
    with_arr = df.withColumn("__chunks", arr).withColumn("chunk_count", F.size("__chunks").cast("bigint"))
    rest = [F.col(f"`{c}`") for c in with_arr.columns if c != "__chunks"]
    return (with_arr.select(*rest, F.posexplode("__chunks").alias("chunk_index", output))
            .withColumn("chunk_index", F.col("chunk_index").cast("bigint")))
