"""One object for a stored graph: everything a front-end asks."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph import render
from wovengraph.functions.text import source_slice
from wovengraph.operators import edges, lookup, vectors
from wovengraph.operators.store import Store
from wovengraph.operators.vector_index import VectorIndex
from wovengraph.plans import indexing
from wovengraph.plans.cypher import cypher


def _rows(frame: DataFrame, most: int = 100_000) -> list[dict]:
    """Rows of an answer for a person or tool."""
    return [r.asDict(recursive=True) for r in frame.limit(most).collect()]


class Graph:
    def __init__(self, spark: SparkSession, folder: str, embedder: vectors.Embedder = vectors.hashed_features) -> None:
        self.spark, self.store, self.embedder = spark, Store(spark, folder), embedder

    def index(self, root: str, rebuild: bool = False) -> indexing.Report:
        return indexing.index(self.store, os.path.abspath(root) if "://" not in root else root, self.store.folder, rebuild)

    def embed(self, batch: int = 256, index: bool = False) -> int:
        """Embed what isn't yet; with `index`, also see that a vector index is in force."""
        done = indexing.embed(self.store, self.embedder, batch)
        if index:
            indexing.ensure_index(self.store)
        return done

    def cypher(self, text: str, parameters: dict[str, Any] | None = None) -> DataFrame:
        return cypher(text, self.store.tables(), parameters)

    def call_graph(self, target: str, direction: str, exact: bool = False, depth: int = 1) -> tuple[str, list[dict]]:
        """(id, callers or callees); callers of more than one step come with their depth."""
        t = self.store.tables()
        row = lookup.one_symbol(t["symbols"], target, not exact)
        if direction == "callers" and depth > 1:
            found = lookup.impact_report(t["calls"], t["symbols"], t["scores"], row["id"], None, depth)
            return row["id"], _rows(found.orderBy("depth", "id"))
        find = edges.callers if direction == "callers" else edges.callees
        return row["id"], _rows(find(t["calls"], t["symbols"], row["id"]).orderBy("id"))

    def dependencies(self, target: str, exact: bool = False) -> tuple[str, list[dict]]:
        t = self.store.tables()
        row = lookup.one_file(t["files"], target, not exact)
        return row["path"], _rows(edges.dependencies(t["imports"], row["path"]).orderBy(F.desc("direction"), "path"))

    def context(self, symbol: str | None = None, file: str | None = None, fuzzy: bool = False) -> dict:
        found = lookup.context(self.store.tables(), symbol, file, fuzzy)
        out = {k: _rows(v.distinct().orderBy(*v.columns)) if isinstance(v, DataFrame) else v for k, v in found.items()}
        if symbol is not None:
            row = out["symbol"]
            path = os.path.join(self.store.root(), row["id"].split("::")[0])
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    text = self.spark.range(1).select(F.lit(f.read()).alias("t"))
                out["source"] = text.select(source_slice(F.col("t"), F.lit(row["start_line"]), F.lit(row["end_line"])).alias("s")).first().s
        return out

    def rank(self, top: int = 10, kind: str | None = None) -> list[dict]:
        t = self.store.tables()
        return _rows(lookup.rank(t["symbols"], t["scores"], top, kind).orderBy("rank"))

    def impact(self, target: str, top: int | None = 50, max_depth: int | None = None) -> tuple[str, int, list[dict]]:
        """(id, how many symbols matched, rows)."""
        t = self.store.tables()
        found, n = lookup.impact_target(t["symbols"], target)
        return found, n, _rows(lookup.impact_report(t["calls"], t["symbols"], t["scores"], found, top, max_depth).orderBy("rank"))

    def dead_code(self, top: int | None = 50, kind: str | None = None) -> dict:
        t = self.store.tables()
        shown = _rows(lookup.dead_code(t["symbols"], t["calls"], t["scores"], top, kind))
        patterns = [*lookup.ENTRY_NAMES, *(f"{p}*" for p in lookup.ENTRY_PREFIXES), *(f"*{s}" for s in lookup.ENTRY_SUFFIXES)]
        return {"count": len(shown), "excluded": patterns, "rows": shown}

    def similar(self, text: str, k: int = 5, threshold: float = 0.5) -> list[dict]:
        t = self.store.tables()
        at = self.store.vector_index()
        search = VectorIndex(self.spark, at).search if at else None
        return _rows(vectors.similar(t["chunks"], t["documented_by"], t["symbols"], text, k, threshold, self.embedder, search))

    def counts(self) -> dict[str, int]:
        t = self.store.tables()
        return {k: t[k].count() for k in ("files", "symbols", "chunks")} | {"embedded": t["chunks"].where("embedding is not null").count()}


def shown_cypher(frame: DataFrame) -> str:
    """A result as a table of text."""
    found = _rows(frame)
    return render.table(frame.columns, [[render.cell(r[c]) for c in frame.columns] for r in found])
