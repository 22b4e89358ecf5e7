"""Indexing: from a source tree to the stored graph, and its derived tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wovengraph.operators import chunks, edges, graph, mutations, resolve, vectors
from wovengraph.operators.store import Store
from wovengraph.operators.vector_index import VectorIndex
from wovengraph.sources import scan


@dataclass
class Report:
    """What an indexing run did."""

    written: int = 0
    bytes: int = 0
    unchanged: int = 0
    removed: int = 0
    failed: list[str] = field(default_factory=list)


def apply_files(store: Store, fresh: DataFrame, removed: DataFrame) -> tuple[Report, dict[str, DataFrame]]:
    """The store's tables after some files (path, language, file_size, hash, content) are written
    and some paths removed; a file that fails to parse is left as it was."""
    parsed = graph.checkpoint(scan.parse_files(fresh))
    failed = parsed.where("failed").select("path")
    good = fresh.join(failed, "path", "left_anti")
    ok = parsed.where(~F.col("failed"))
    files = graph.checkpoint(good.join(ok.select("path", "imports"), "path", "left").select("path", "language", "file_size", "hash", F.coalesce("imports", F.array().cast("array<struct<path:string,line:bigint>>")).alias("raw_imports")))
    touched = files.select("path").unionByName(removed.select("path"))
    tables = mutations.remove_files({k: t for k, t in store.tables().items() if k != "scores"}, touched)
    tables["scores"] = store.read("scores")  # a rewritten symbol keeps its score until the next scoring
    declared = ok.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    owned = ok.select(F.explode("calls").alias("c")).select("c.*")
    symbols = edges.calls_by_owner(mutations.last_declarations(declared.drop("path")), owned)
    tables["files"] = tables["files"].unionByName(files)
    tables["symbols"] = tables["symbols"].unionByName(symbols.select(*tables["symbols"].columns))
    inside = ok.select("path", F.explode("contains").alias("e")).select(F.when(F.col("e.src") == F.col("path"), "File").otherwise("Symbol").alias("src_kind"), "e.src", "e.dst")
    tables["contains"] = tables["contains"].unionByName(mutations.with_endpoints(inside, files, symbols))
    text = good.where("content is not null").join(ok.select("path"), "path", "left_semi").select("path", F.col("content").cast("string").alias("text"), "language")
    with_symbols = declared.select("path").distinct()
    whole = chunks.sliding_chunks(text.join(with_symbols, "path", "left_anti")).select("path", "ordinal", F.lit(None).cast("string").alias("symbol"), "start_line", "text")
    by_symbol = chunks.symbol_chunks(text, declared).select("path", "ordinal", "symbol", "start_line", "text")
    made = chunks.chunk_ids(whole.unionByName(by_symbol)).join(text.select("path", "language"), "path")
    tables["chunks"], tables["documented_by"] = mutations.replace_chunks(tables["chunks"], tables["documented_by"], made, symbols)
    done = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("b")).collect()[0]
    return Report(done.n, done.b, 0, removed.count(), [r.path for r in failed.limit(1000).collect()]), tables


def link(store: Store) -> None:
    """Recompute every import and call edge, then every score, from the stored tables."""
    store.begin()
    files, symbols = store.read("files"), store.read("symbols")
    imports = graph.checkpoint(resolve.resolve_imports(files))
    calls = graph.checkpoint(resolve.resolve_calls(symbols, imports).select("src", "dst", "call_site_line"))
    scores = graph.pagerank(symbols, calls)
    store.commit({"imports": imports, "calls": calls, "scores": scores}, graph_dirty=False)


def index(store: Store, root: str, database: str = "", rebuild: bool = False) -> Report:
    """Index a tree: new and changed files are parsed and written, files no longer there removed
    (only if the walk met no error), and the graph linked and scored."""
    store.initialize(root, rebuild)
    store.begin()
    found, errors = scan.read_tree(store.spark, root, database)
    rows = scan.file_rows(found)
    seen = graph.checkpoint(rows.select("path", "hash"))
    indexed = store.read("files")
    fresh = scan.changed_files(rows, indexed)
    gone = mutations.stale(indexed, seen) if not errors else indexed.select("path").limit(0)
    report, tables = apply_files(store, fresh, gone)
    report.unchanged = seen.count() - report.written - len(report.failed)
    report.failed += errors
    if report.written or report.removed:
        store.commit(tables, graph_dirty=True, vector_dirty=True)
    if store.dirty("graph"):
        link(store)
    return report


def embed(store: Store, embedder: vectors.Embedder = vectors.hashed_features, batch: int = 256) -> int:
    """Embed every chunk without an embedding; how many there were."""
    store.begin()
    rows = store.read("chunks")
    missing = rows.where(vectors.needs_embedding(F.col("embedding"))).count()
    if missing:
        store.commit({"chunks": vectors.embed(rows, embedder, batch)}, vector_dirty=False)
    return missing


def ensure_index(store: Store) -> VectorIndex:
    """The vector index in force, built if there is none; NotEmbedded without embeddings."""
    store.begin()
    at = store.vector_index()
    if at is None:
        rows = store.read("chunks")
        if rows.where(~vectors.needs_embedding(F.col("embedding"))).isEmpty():
            raise vectors.NotEmbedded("no chunk is embedded; run embed first")
        made = f"indexes/{uuid.uuid4().hex}"
        VectorIndex.build(rows, f"{store.folder}/{made}")
        store.commit({}, index=made)
        at = f"{store.folder}/{made}"
    return VectorIndex(store.spark, at)
