"""A cell index over embedded chunks, for searches that read part of them.

Centres are fitted on a bounded sample; then every row goes to the cell of its nearest centre, and
each cell states the widest angle of its rows.  By the triangle inequality on angles a cell can hold
no row closer to a query than its centre's angle less that width, so a search first reads the nearest
cells and then only cells whose bound reaches the k-th score so far: the answer equals the full scan's."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph.functions.text import needs_embedding
from wovengraph.operators.vectors import nearest

#: Most centres, and rows of the sample that they are fitted on for each; 4,096 centres of 384
#: dimensions are 6 MB, the largest sample 50 MB.
CELLS, FITTED_ON = 4096, 8
#: What a bound may be off by, as embeddings are of single precision.
SLACK = 1e-6
#: The cell of rows that no centre fits (another length, missing or endless numbers); always read.
ODD = -1


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scores = rows @ centres.T
    best = scores.argmax(axis=1)
    return best, np.arccos(np.clip(scores[np.arange(len(rows)), best], -1, 1))


def fit(rows: DataFrame, cells: int | None = None, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means on the FITTED_ON * cells rows of least hash of id; as many
    as the root of the number of rows if not given, CELLS at most.  None without rows."""
    if cells is None:
        cells = int(rows.count() ** 0.5) + 1
    cells = max(1, min(cells, CELLS))
    drawn = rows.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(cells * FITTED_ON).toPandas()["embedding"]
    lengths = drawn.map(len)
    if not len(drawn):
        return np.zeros((0, 0))
    usable = np.stack(drawn[lengths == lengths.mode()[0]].to_numpy()).astype(float)
    usable = _units(usable[np.isfinite(usable).all(axis=1)])
    centres = usable[:cells]
    for _ in range(rounds if len(centres) else 0):
        home, _ = _nearest_centre(usable, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, usable)
        held = np.linalg.norm(sums, axis=1) > 1e-12
        centres = np.where(held[:, None], _units(sums), centres)
    return centres


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, embedding, cell, angle) of every embedded row; ODD where no centre fits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell, angle = np.full(len(frame), ODD), np.zeros(len(frame))
            fits = np.array([len(e) == centres.shape[1] for e in frame["embedding"]], bool)
            if len(centres) and fits.any():
                there = np.flatnonzero(fits)
                some = np.stack(frame["embedding"].to_numpy()[there]).astype(float)
                whole = np.isfinite(some).all(axis=1)
                there = there[whole]
                cell[there], angle[there] = _nearest_centre(_units(some[whole]), centres)
            yield frame.assign(cell=cell.astype(np.int32), angle=angle)

    embedded = rows.where(~needs_embedding(F.col("embedding"))).select("id", "embedding")
    return embedded.mapInPandas(run, "id string, embedding array<float>, cell int, angle double")


@dataclass
class VectorIndex:
    """An index in a folder: `rows`, sorted by cell so that a filter on cells skips row groups, and `cells`."""

    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, chunks: DataFrame, folder: str, cells: int | None = None) -> VectorIndex:
        """Fit on a sample, index every embedded row.  Rows are dealt by ranges of (cell, hash), so a
        cell with many rows is spread over tasks and files.  Without rows the index is empty."""
        embedded = chunks.where(~needs_embedding(F.col("embedding"))).select("id", "embedding")
        centres = fit(embedded, cells)
        dealt = assigned(embedded, centres).withColumn("h", F.xxhash64("id")).repartitionByRange("cell", "h")
        dealt.sortWithinPartitions("cell").drop("h").write.parquet(f"{folder}/rows")
        spark = chunks.sparkSession
        wide = spark.read.parquet(f"{folder}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("width"))
        points = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        wide.join(F.broadcast(points), "cell", "left").coalesce(1).write.parquet(f"{folder}/cells")
        return cls(spark, folder)

    def search(self, query: list[float], k: int, threshold: float | None = None, probes: int = 8, exact: bool = True) -> DataFrame:
        """(id, score) like `nearest` over all rows.  Without `exact` only the `probes` nearest cells are
        read, and close rows of other cells may be missed."""
        rows = self.spark.read.parquet(f"{self.folder}/rows")
        cells = self.spark.read.parquet(f"{self.folder}/cells").collect()  # CELLS + 1 rows at most
        vector = np.asarray(query, float)
        size = np.linalg.norm(vector)
        usable = [c for c in cells if c.centre is not None and len(c.centre) == len(vector)]
        if not np.isfinite(size) or not size or not usable or k <= 0:
            return nearest(rows, query, k, threshold)
        angle = np.arccos(np.clip(np.array([c.centre for c in usable]) @ (vector / size), -1, 1))
        best = np.cos(np.maximum(0, angle - np.array([c.width for c in usable]))) + SLACK
        order = np.argsort(angle, kind="stable")
        always = [c.cell for c in cells if c.centre is None]
        chosen = [usable[i].cell for i in order[:probes]] + always
        first = nearest(rows.where(F.col("cell").isin(chosen)), query, k)
        if exact:
            so_far = [r.score for r in first.select("score").collect()]  # k rows
            floor = so_far[-1] if len(so_far) == k and so_far[-1] is not None and np.isfinite(so_far[-1]) else -np.inf
            floor = max(floor, -np.inf if threshold is None else threshold)
            more = [usable[i].cell for i in order[probes:] if best[i] >= floor]
            if more:
                first = nearest(rows.where(F.col("cell").isin(chosen + more)), query, k)
        return first if threshold is None else first.where(F.col("score") >= threshold)
