"""Keyed writes as set operations: what stays, plus what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wovengraph.functions.text import symbol_file


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of `delta` replace those of `base` with the same key."""
    return base.join(delta.select(key), key, "left_anti").select(*base.columns).unionByName(delta.select(*base.columns))


def last_declarations(symbols: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Of symbols with the same id the last in parse order."""
    rest = [c for c in symbols.columns if c not in ("id", ordinal)]
    return symbols.groupBy("id").agg(F.max_by(F.struct(*rest), ordinal).alias("s")).select("id", *(F.col(f"s.{c}").alias(c) for c in rest))


def symbol_upsert(base: DataFrame, delta: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Symbols replaced by the last declarations of a delta.  Scores are a table of their own,
    so they stay until the next scoring."""
    return upsert(base, last_declarations(delta, ordinal), "id")


def without_files(frame: DataFrame, paths: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose `columns` (symbol ids, chunk ids or paths) belongs to one of `paths`."""
    gone = paths.select(F.col(paths.columns[0]).alias("__gone")).distinct()
    for c in columns:
        frame = frame.join(gone, symbol_file(F.col(c)) == F.col("__gone"), "left_anti")
    return frame


def delete_symbols(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without the symbols of some files, and without all edges at them."""
    symbols = {"symbols": ("id",), "scores": ("id",), "calls": ("src", "dst"), "contains": ("src", "dst")}
    return {name: without_files(t, paths, *symbols[name]) if name in symbols else t for name, t in tables.items()}


def remove_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without some files: their row, symbols, chunks and every edge at them."""
    out = delete_symbols(tables, paths)
    for name, columns in {"files": ("path",), "imports": ("src", "dst"), "chunks": ("id",), "documented_by": ("chunk_id",)}.items():
        if name in out:
            out[name] = without_files(out[name], paths, *columns)
    return out


def stale(indexed: DataFrame, observed: DataFrame) -> DataFrame:
    """Indexed paths that a walk no longer sees."""
    return indexed.select("path").join(observed.select("path"), "path", "left_anti")


def changed(found: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files found whose hash isn't the indexed one."""
    return found.join(hashes.select("path", "hash"), ["path", "hash"], "left_anti")


def with_endpoints(contains: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct CONTAINS edges whose both ends exist."""
    ends = files.select(F.lit("File").alias("src_kind"), F.col("path").alias("src")).unionByName(symbols.select(F.lit("Symbol").alias("src_kind"), F.col("id").alias("src"))).distinct()
    there = contains.join(ends, ["src_kind", "src"], "left_semi").join(symbols.select(F.col("id").alias("dst")), "dst", "left_semi")
    return there.select("src_kind", "src", "dst").distinct()


def replace_chunks(chunks: DataFrame, documented_by: DataFrame, fresh: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of the files of `fresh` (path, id, symbol, text, language, start_line) replaced, not
    embedded yet; edges from the file always and from the symbol where it exists."""
    paths = fresh.select("path").distinct()
    rows = fresh.select("id", "text", "language", "start_line", F.lit(None).cast("array<float>").alias("embedding"))
    of_file = fresh.select(F.lit("File").alias("src_kind"), F.col("path").alias("src"), F.col("id").alias("chunk_id"))
    of_symbol = fresh.where("symbol is not null").join(symbols.select(F.col("id").alias("symbol")), "symbol", "left_semi").select(F.lit("Symbol").alias("src_kind"), F.col("symbol").alias("src"), F.col("id").alias("chunk_id"))
    return without_files(chunks, paths, "id").unionByName(rows), without_files(documented_by, paths, "chunk_id").unionByName(of_file).unionByName(of_symbol)
