"""The graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Nested columns are typed rather than JSON text; `operators.resolve` reads either.
TABLES: dict[str, str] = {
    "files": "path string, language string, file_size bigint, hash string, raw_imports array<struct<path:string,line:bigint>>",
    "symbols": "id string, name string, kind string, start_line bigint, start_col bigint, end_line bigint, signature string, raw_calls array<struct<name:string,line:bigint,is_method:boolean>>",
    "scores": "id string, pagerank double",
    "chunks": "id string, text string, language string, start_line bigint, embedding array<float>",
    "contains": "src_kind string, src string, dst string",
    "imports": "src string, dst string",
    "calls": "src string, dst string, call_site_line bigint",
    "documented_by": "src_kind string, src string, chunk_id string",
}
DIMENSIONS = 384


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty, typed table."""
    return spark.createDataFrame([], TABLES[table])


def ddl(table: str) -> str:
    """CREATE TABLE for a table of the graph."""
    return f"CREATE TABLE IF NOT EXISTS {table} ({TABLES[table]}) USING parquet"
