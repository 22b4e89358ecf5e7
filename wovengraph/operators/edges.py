"""Edge lookups, adjacency and set-like operators: equi joins that Catalyst plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHOWN = ("id", "name", "kind", "signature")


def _line(name: str) -> F.Column:
    return F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0))


def callers(calls: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    """Symbols that call `target`, with the line of each call."""
    hits = calls.where(F.col("dst") == target).select(F.col("src").alias("id"), _line("call_site_line").alias("call_site_line"))
    return symbols.join(hits, "id").select(*_SHOWN, "call_site_line")


def callees(calls: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    """Symbols that `target` calls."""
    hits = calls.where(F.col("src") == target).select(F.col("dst").alias("id"))
    return symbols.join(hits, "id").select(*_SHOWN)


def imported_files(imports: DataFrame, path: str) -> DataFrame:
    """Files that a file imports."""
    return imports.where(F.col("src") == path).select(F.col("dst").alias("path"))


def importing_files(imports: DataFrame, path: str) -> DataFrame:
    """Files that import a file."""
    return imports.where(F.col("dst") == path).select(F.col("src").alias("path"))


def dependencies(imports: DataFrame, path: str) -> DataFrame:
    """Both, with a direction column."""
    return imported_files(imports, path).select(F.lit("imports").alias("direction"), "path").unionByName(importing_files(imports, path).select(F.lit("imported_by").alias("direction"), "path"))


def distinct_edges(calls: DataFrame) -> DataFrame:
    """Each pair once."""
    return calls.select("src", "dst").distinct()


def incoming(calls: DataFrame) -> DataFrame:
    """The set of callers of each callee."""
    return calls.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("callers"))


def out_degree(calls: DataFrame) -> DataFrame:
    """Distinct callees of each caller."""
    return calls.groupBy("src").agg(F.countDistinct("dst").alias("out_degree"))


def in_list(frame: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is in a table of ids."""
    return frame.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")


def without_dangling(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose caller has a symbol row."""
    return calls.join(symbols.select(F.col("id").alias("src")), "src", "left_semi")


def calls_by_owner(symbols: DataFrame, owned: DataFrame) -> DataFrame:
    """Symbols with their calls: every symbol of an id gets the union of the calls that name it
    their owner; calls without an owner fall away."""
    lists = owned.where("owner is not null").groupBy(F.col("owner").alias("id")).agg(F.sort_array(F.collect_list(F.struct("line", "name", "is_method"))).alias("found"))
    shaped = F.transform("found", lambda c: F.struct(c["name"].alias("name"), c["line"].alias("line"), c["is_method"].alias("is_method")))
    none = F.array().cast("array<struct<name:string,line:bigint,is_method:boolean>>")
    return symbols.join(lists, "id", "left").withColumn("raw_calls", F.coalesce(shaped, none)).drop("found")


def containment(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """CONTAINS edges from ids: the parent is the id without its last segment, a file at the top."""
    parent = F.regexp_replace("id", r"::(?:(?!::).)*\z", "")
    rows = symbols.select(parent.alias("src"), F.col("id").alias("dst")).where("src <> dst").distinct()
    paths = files.select(F.col("path").alias("src"), F.lit("File").alias("found"))
    return rows.join(paths, "src", "left").select(F.coalesce("found", F.lit("Symbol")).alias("src_kind"), "src", "dst")
