"""Embedding and exact nearest-neighbour search."""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wovengraph.functions.text import cosine, needs_embedding
from wovengraph.schema import DIMENSIONS

Embedder = Callable[[list[str]], np.ndarray]


class NotEmbedded(Exception):
    """No chunk has an embedding yet."""


def hashed_features(texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for a trained model: signed feature hashing of lower-case words
    and their neighbours into DIMENSIONS, unit norm; the empty text is all zeros."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in enumerate(texts):
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        for feature in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
            out[row, h % DIMENSIONS] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out[row])
        if norm:
            out[row] /= norm
    return out


def embedder_named(name: str) -> Embedder:
    """The function that `module:function` names; executors must be able to import the module."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"no embedder {name}: {e}") from e


def embed(chunks: DataFrame, embedder: Embedder = hashed_features, batch: int = 256) -> DataFrame:
    """Chunks with embeddings for those that have none (null or all zeros); others are kept."""
    fields = "id string, embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(embedder(part["text"].fillna("").tolist()))})

    missing = chunks.where(needs_embedding(F.col("embedding")))
    fresh = missing.select("id", "text").mapInPandas(run, fields).withColumnRenamed("embedding", "fresh")
    return chunks.join(fresh, "id", "left").withColumn("embedding", F.coalesce("fresh", "embedding")).drop("fresh")


def nearest(chunks: DataFrame, query: list[float], k: int, threshold: float | None = None) -> DataFrame:
    """(id, score): the k most similar chunks by cosine, ties by id; the threshold applies to
    those k.  k = 0 gives none.  One scan and a top-k that each partition makes its own part of."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    rows = chunks.where(~needs_embedding(F.col("embedding"))).select("id", cosine(F.col("embedding"), vector).alias("score"))
    best = rows.orderBy(F.desc_nulls_last("score"), "id").limit(max(0, k))
    return best if threshold is None else best.where(F.col("score") >= threshold)


def enriched(hits: DataFrame, chunks: DataFrame, documented_by: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits with their file, symbol name and line; '' where none, 0 for a missing line.  A chunk
    of a declaration carries that symbol's name; the line is the chunk's own."""
    lines = chunks.select("id", "text", F.col("start_line").alias("line"))
    files = documented_by.where("src_kind = 'File'").groupBy(F.col("chunk_id").alias("id")).agg(F.min("src").alias("file"))
    owners = documented_by.where("src_kind = 'Symbol'").select(F.col("chunk_id").alias("id"), F.col("src").alias("sid"))
    names = owners.join(symbols.select(F.col("id").alias("sid"), "name"), "sid").groupBy("id").agg(F.min("name").alias("symbol"))
    found = hits.join(lines, "id", "left").join(files, "id", "left").join(names, "id", "left")
    return found.select("id", "score", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("symbol", F.lit("")).alias("symbol"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("text", F.lit("")).alias("text"))


def similar(chunks: DataFrame, documented_by: DataFrame, symbols: DataFrame, text: str, k: int = 5, threshold: float = 0.5, embedder: Embedder = hashed_features, search: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Chunks like a text, enriched; `search` (vector, k, threshold) is an index's, else all are scanned.
    NotEmbedded where nothing is found as nothing is embedded."""
    vector = np.asarray(embedder([text])[0]).tolist()
    hits = search(vector, k, threshold) if search else nearest(chunks, vector, k, threshold)
    if hits.isEmpty() and chunks.where(~needs_embedding(F.col("embedding"))).isEmpty():
        raise NotEmbedded("no chunk is embedded; run embed first")
    return enriched(hits, chunks, documented_by, symbols).orderBy(F.desc("score"), "id")
