"""Candidates, ranking, dead code, and the composite questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wovengraph.functions.text import ENTRY_NAMES, ENTRY_PREFIXES, ENTRY_SUFFIXES, entry_point, symbol_file
from wovengraph.operators import edges, graph


class QueryError(Exception):
    """A question that has no single answer."""


class NotFound(QueryError):
    def __init__(self, target: str, suggestions: list[str] | None = None) -> None:
        self.target, self.suggestions = target, suggestions or []
        super().__init__(f"nothing matches {target!r}" + (f"; did you mean {', '.join(self.suggestions)}?" if self.suggestions else ""))


class Ambiguous(QueryError):
    def __init__(self, target: str, candidates: list[dict]) -> None:
        self.target, self.candidates = target, candidates
        super().__init__(f"{len(candidates)} candidates match {target!r}")


class InvalidInput(QueryError):
    pass


def symbol_candidates(symbols: DataFrame, target: str, fuzzy: bool = False) -> DataFrame:
    """By id where the target has `::`, else by name; `fuzzy` is a substring in any case."""
    column = F.col("id" if "::" in target else "name")
    return symbols.where(F.lower(column).contains(target.lower()) if fuzzy else column == target)


def file_candidates(files: DataFrame, target: str, fuzzy: bool = False) -> DataFrame:
    return files.where(F.lower("path").contains(target.lower()) if fuzzy else F.col("path") == target)


def suggestions(symbols: DataFrame, target: str, n: int = 5) -> DataFrame:
    """The first ids, in order, whose name or id contains the target."""
    low = target.lower()
    return symbols.where(F.lower("name").contains(low) | F.lower("id").contains(low)).select("id").distinct().orderBy("id").limit(n)


def one_symbol(symbols: DataFrame, target: str, fuzzy: bool = False, most: int = 1000) -> dict:
    """The one symbol that matches; NotFound or Ambiguous (with `most` candidates) otherwise."""
    found = symbol_candidates(symbols, target, fuzzy).orderBy("id").limit(most).collect()
    if not found:
        raise NotFound(target, [r.id for r in suggestions(symbols, target).collect()])
    if len(found) > 1:
        raise Ambiguous(target, [{"name": r.name, "file": r.id.split("::")[0], "line": r.start_line} for r in found])
    return found[0].asDict(recursive=True)


def one_file(files: DataFrame, target: str, fuzzy: bool = False, most: int = 1000) -> dict:
    found = file_candidates(files, target, fuzzy).orderBy("path").limit(most).collect()
    if not found:
        raise NotFound(target)
    if len(found) > 1:
        raise Ambiguous(target, [{"name": r.path, "file": r.path, "line": 0} for r in found])
    return found[0].asDict(recursive=True)


def of_kind(symbols: DataFrame, kind: str | None) -> DataFrame:
    """Symbols of a kind, by its exact name; all without one."""
    return symbols if kind is None else symbols.where(F.col("kind") == kind)


def rank(symbols: DataFrame, scores: DataFrame, top: int = 10, kind: str | None = None) -> DataFrame:
    """(rank, id, name, kind, file, pagerank): the best scored symbols, ties by id."""
    rows = of_kind(symbols, kind).join(scores.where("pagerank is not null"), "id")
    best = rows.select("id", "name", "kind", symbol_file(F.col("id")).alias("file"), "pagerank").orderBy(F.desc("pagerank"), "id").limit(top)
    return numbered(best, F.desc("pagerank"), F.col("id"))


def numbered(few: DataFrame, *order: F.Column) -> DataFrame:
    """Rows of a bounded top-k report numbered from 1."""
    return few.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), *few.columns)


def numbered_whole(ordered: DataFrame) -> DataFrame:
    """All rows of an ordered table numbered from 1: each partition numbers its own rows, after as
    many as the partitions before it have (a row a partition reaches the driver)."""
    rows = graph.checkpoint(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, found = 0, []
    for k, n in sizes:
        found.append((k, before))
        before += n
    base = ordered.sparkSession.createDataFrame(found, "__part long, __before long")
    return rows.withColumn("__part", part).join(F.broadcast(base), "__part").select((F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int").alias("rank"), *ordered.columns)


def uncalled(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols without an incoming call; a call of itself counts as one."""
    return symbols.join(calls.select(F.col("dst").alias("id")), "id", "left_anti")


def dead_code(symbols: DataFrame, calls: DataFrame, scores: DataFrame, top: int | None = 50, kind: str | None = None) -> DataFrame:
    """(id, name, kind, file, start_line, pagerank): functions and methods that nothing calls and
    that aren't entry points, least score first (none counts as 0), ties by id."""
    pool = of_kind(symbols, kind).where(F.col("kind").isin("Function", "Method") & ~entry_point(F.col("name")))
    rows = uncalled(pool, calls).join(scores, "id", "left")
    shown = rows.select("id", "name", "kind", symbol_file(F.col("id")).alias("file"), "start_line", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")).orderBy("pagerank", "id")
    return shown if top is None else shown.limit(top)


def dead_code_report(rows: DataFrame) -> DataFrame:
    """The count after truncation, with the patterns that are left out."""
    patterns = [*ENTRY_NAMES, *(f"{p}*" for p in ENTRY_PREFIXES), *(f"*{s}" for s in ENTRY_SUFFIXES)]
    return rows.agg(F.count("*").alias("count")).withColumn("excluded", F.lit(", ".join(patterns)))


def impact_report(calls: DataFrame, symbols: DataFrame, scores: DataFrame, target: str, top: int | None = 50, max_depth: int | None = None) -> DataFrame:
    """(rank, id, name, kind, file, depth, pagerank): what a change of `target` reaches, best
    scored first, without a score last, ties by id."""
    reached = graph.impact(calls, symbols, target, max_depth)
    rows = reached.join(symbols, "id").join(scores, "id", "left").select("id", "name", "kind", symbol_file(F.col("id")).alias("file"), "depth", "pagerank")
    order = (F.desc_nulls_last("pagerank"), F.col("id").asc())
    rows = rows.orderBy(*order)
    return numbered_whole(rows) if top is None else numbered(rows.limit(top), *order)


def impact_target(symbols: DataFrame, target: str) -> tuple[str, int]:
    """The id that a fuzzy target stands for (the least of all that match) and how many match."""
    found = symbol_candidates(symbols, target, True).agg(F.min("id").alias("id"), F.count("*").alias("n")).collect()[0]
    if not found.n:
        raise NotFound(target, [r.id for r in suggestions(symbols, target).collect()])
    return found.id, found.n


def context(tables: dict[str, DataFrame], symbol: str | None = None, file: str | None = None, fuzzy: bool = False) -> dict:
    """All about one symbol (callers, callees) or one file (imports, importers, symbols): the
    row itself and DataFrames for the rest."""
    if (symbol is None) == (file is None):
        raise InvalidInput("name either a symbol or a file")
    if symbol is not None:
        row = one_symbol(tables["symbols"], symbol, fuzzy)
        return {"symbol": row, "callers": edges.callers(tables["calls"], tables["symbols"], row["id"]), "callees": edges.callees(tables["calls"], tables["symbols"], row["id"])}
    row = one_file(tables["files"], file, fuzzy)
    return {
        "file": row,
        "imports": edges.imported_files(tables["imports"], row["path"]),
        "imported_by": edges.importing_files(tables["imports"], row["path"]),
        "symbols": graph.contained_symbols(tables["contains"], tables["symbols"], row["path"]),
    }
