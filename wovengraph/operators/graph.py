"""Iterative graph operators.

Each loop keeps its state as a table with one row a vertex, cuts lineage with reliable
checkpoints, and does only aggregates with map-side combination and equi joins in a round."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset and all runs on
    this machine."""
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="wovengraph-")
            atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def work_folder(spark: SparkSession) -> Iterator[str]:
    """A name for a folder of intermediate tables in the shared folder, removed at the end."""
    fs = spark._jvm.org.apache.hadoop.fs
    path = fs.Path(f"{_shared(spark)}/work-{uuid.uuid4().hex}")
    try:
        yield path.toString()
    finally:
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Targets of one source in a row, about.
_BLOCK = 4096

#: Rows of a frontier that every task can hold.
_FEW = 50_000


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, epsilon: float = 1e-6, max_iterations: int = 100) -> DataFrame:
    """(id, pagerank) by power iteration over the distinct edges (src, dst) between `vertices` (id).

    Scores begin at 1/n; a vertex without out-edges shares its score among all; a self loop
    counts in the out-degree but its share is lost.  Rounds end when the scores change by less
    than `epsilon` in sum; n = 0 gives an empty table.  Each round's scores are checkpointed: a round reads
    them three times, so a plan of several rounds would triple with each.

    Within the loop vertices are numbers, and a row holds up to some `_BLOCK` targets of a source: a round
    moves a number and a share a link, instead of two ids a link there and back."""
    numbered = checkpoint(vertices.select("id").distinct().withColumn("v", F.monotonically_increasing_id()))
    n = numbered.count()
    if not n:
        return numbered.select("id", F.lit(0.0).alias("pagerank"))
    ends = edges.select("src", "dst").join(numbered.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(numbered.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    known = checkpoint(ends.select("a", "b").distinct())
    degree = checkpoint(known.groupBy("a").agg(F.count("*").alias("degree")))
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / _BLOCK)).alias("block")
    links = checkpoint(known.where("a <> b").join(degree, "a").groupBy("a", "degree", block).agg(F.collect_list("b").alias("to")).drop("block"))
    scores = checkpoint(numbered.select("v").join(degree.withColumnRenamed("a", "v"), "v", "left").select("v", "degree", F.lit(1.0 / n).alias("score")))
    rest = (1 - damping) / n
    for _ in range(max_iterations):
        lost = F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("score"))), F.lit(0.0))
        dangling = scores.agg(lost.alias("dangling"))
        sends = links.join(scores.select(F.col("v").alias("a"), "score"), "a").select(F.explode("to").alias("v"), (F.col("score") / F.col("degree")).alias("share"))
        shares = sends.groupBy("v").agg(F.sum("share").alias("sent"))
        moved = F.lit(rest) + damping * (F.coalesce("sent", F.lit(0.0)) + F.col("dangling") / n)
        after = scores.join(shares, "v", "left").crossJoin(F.broadcast(dangling)).select("v", "degree", moved.alias("score"), F.abs(moved - F.col("score")).alias("change"))
        after = checkpoint(after)
        scores = after.drop("change")
        if epsilon > 0 and after.agg(F.sum("change")).collect()[0][0] < epsilon:
            break
    return numbered.join(scores, "v").select("id", F.col("score").alias("pagerank"))


def dangling_mass(scores: DataFrame, calls: DataFrame) -> DataFrame:
    """The summed score of vertices without out-edges."""
    ends = scores.join(calls.select(F.col("src").alias("id")), "id", "left_anti")
    return ends.agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("dangling_mass"))


def l1_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """The summed absolute change between two score tables."""
    both = old.select("id", F.col("pagerank").alias("a")).join(new.select("id", F.col("pagerank").alias("b")), "id")
    return both.agg(F.sum(F.abs(F.col("b") - F.col("a"))).alias("l1_delta"))


def score_stats(scores: DataFrame) -> DataFrame:
    return scores.agg(F.min("pagerank").alias("min_score"), F.max("pagerank").alias("max_score"), F.sum("pagerank").alias("sum_score"))


def impact(calls: DataFrame, symbols: DataFrame, target: str, max_depth: int | None = None) -> DataFrame:
    """(id, depth): every symbol that reaches `target` over calls, with its least distance.

    The target is left out.  Callers without a symbol row are skipped and not followed.  Each
    round joins the frontier with the edges and takes away what has been seen; a small frontier goes
    to the edges, which then stay where they are."""
    edges = checkpoint(calls.select("src", "dst").distinct().join(symbols.select(F.col("id").alias("src")).distinct(), "src", "left_semi"))
    spark = calls.sparkSession
    start = spark.range(1).select(F.lit(target).alias("id"), F.lit(0).alias("depth"))
    seen = frontier = start
    depth, size = 0, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        asked = frontier.select(F.col("id").alias("dst"))
        reached = edges.join(F.broadcast(asked) if size <= _FEW else asked, "dst").select(F.col("src").alias("id")).distinct()
        frontier = checkpoint(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        size = frontier.count()
        if not size:
            break
        seen = checkpoint(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
    return seen.where("depth > 0")


def containment_closure(contains: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(ancestor, descendant, depth) over CONTAINS edges, one step or more; depth is the least."""
    edges = contains.select("src", "dst").distinct()
    level = edges.select(F.col("src").alias("ancestor"), F.col("dst").alias("descendant"), F.lit(1).alias("depth"))
    seen, depth = checkpoint(level), 1
    level = seen
    while max_depth is None or depth < max_depth:
        depth += 1
        further = level.join(edges, F.col("descendant") == F.col("src")).select("ancestor", F.col("dst").alias("descendant")).distinct()
        level = checkpoint(further.join(seen, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def contained_symbols(contains: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """Symbols at any depth under a file: (id, name, kind, start_line)."""
    spark = contains.sparkSession
    frontier = spark.range(1).select(F.lit(path).alias("src"))
    seen = None
    while True:
        step = contains.join(frontier, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        fresh = checkpoint(step if seen is None else step.join(seen, "id", "left_anti"))
        if fresh.isEmpty():
            break
        seen = fresh if seen is None else checkpoint(seen.unionByName(fresh))
        frontier = fresh.select(F.col("id").alias("src"))
    return symbols.join(fresh if seen is None else seen, "id", "left_semi").select("id", "name", "kind", "start_line")
