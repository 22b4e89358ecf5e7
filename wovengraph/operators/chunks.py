"""Chunking of sources for search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wovengraph.functions.text import lines, source_slice

MAX_LINES, OVERLAP = 30, 5


def sliding_chunks(sources: DataFrame, path: str = "path", text: str = "text", max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """(path, ordinal, start_line, end_line, text): windows of `max_lines` lines, overlapping by
    `overlap` (one line of progress at least), the last one the first that reaches the end."""
    step = max(1, max_lines - overlap)
    rows = sources.select(F.col(path).alias("path"), lines(F.col(text)).alias("l")).where(F.size("l") > 0)
    last = F.greatest(F.ceil((F.size("l") - max_lines) / F.lit(float(step))), F.lit(0)).cast("int")
    each = rows.select("path", "l", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    begin = F.col("ordinal") * step
    return each.select(
        "path",
        "ordinal",
        (begin + 1).cast("bigint").alias("start_line"),
        F.least(begin + max_lines, F.size("l")).cast("bigint").alias("end_line"),
        F.array_join(F.slice("l", begin + 1, max_lines), "\n").alias("text"),
    )


def symbol_chunks(sources: DataFrame, symbols: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, ordinal, symbol, start_line, text): one chunk a declaration, in parse order.
    `symbols` has path, ordinal, id, start_line and end_line; lines outside declarations are
    in no chunk and nested declarations overlap."""
    joined = symbols.join(sources.select(F.col(path).alias("path"), F.col(text).alias("source")), "path")
    return joined.select("path", "ordinal", F.col("id").alias("symbol"), "start_line", source_slice(F.col("source"), F.col("start_line"), F.col("end_line")).alias("text"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """The id of each chunk: path, `chunk` and its ordinal."""
    return chunks.withColumn("id", F.concat_ws("::", "path", F.lit("chunk"), F.col("ordinal").cast("string")))
