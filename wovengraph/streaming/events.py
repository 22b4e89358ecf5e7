"""File events: what is watched, and how events become batches of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wovengraph.functions.text import parse_eligible

#: path string (absolute), kind string (access, modify, create, remove), ts timestamp
EVENT = "event_id bigint, ts timestamp, path string, kind string"


def watched(events: DataFrame, database: str) -> DataFrame:
    """Events that may change the graph: no accesses, absolute paths of parseable files, and
    nothing whose name begins with the database's."""
    name = F.substring_index("path", "/", -1)
    return events.where((F.col("kind") != "access") & F.col("path").startswith("/") & ~name.startswith(database) & parse_eligible(F.col("path")))


def pending(events: DataFrame) -> DataFrame:
    """Each path once."""
    return events.select("path").distinct()


#: Gaps of time that make one bucket of `batches`.
BUCKET = 64


def batches(events: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """Event-time replay of debouncing: runs of events without a longer gap, as (first_ts, last_ts,
    paths, events).

    Events are dealt into buckets of BUCKET gaps; runs are numbered within each, and one row a
    bucket (its first and last time and its number of runs) tells which runs go on over the
    border, so no task sees all events.  Events without a time are left out."""
    zero = "timestamp'1970-01-01 00:00:00'"
    width = F.expr(f"unix_micros({zero} + interval {gap}) - unix_micros({zero})")
    if events.schema["ts"].dataType.typeName() == "timestamp_ntz":  # read off the clock, without a zone
        at = F.expr("unix_date(cast(ts as date)) * 86400000000 + cast((hour(ts) * 3600 + minute(ts) * 60 + extract(second from ts)) * 1000000 as bigint)")
    else:
        at = F.unix_micros("ts")
    rows = events.where("ts is not null").withColumn("bucket", F.floor(at / (width * BUCKET)))
    before = F.lag("ts").over(Window.partitionBy("bucket").orderBy("ts"))
    rows = rows.withColumn("new", (F.col("ts") > before + F.expr(f"interval {gap}")).cast("int"))
    running = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("nth", running)
    edges = rows.groupBy("bucket").agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.max("nth").alias("more"))
    order = Window.orderBy("bucket")  # one row a bucket
    apart = F.coalesce((F.col("low") > F.lag("high").over(order) + F.expr(f"interval {gap}")).cast("long"), F.lit(0))
    edges = edges.withColumn("apart", apart).withColumn("runs", F.col("more") + F.col("apart"))
    edges = edges.select("bucket", (F.sum("runs").over(order) - F.col("more")).alias("base"))
    named = rows.join(edges, "bucket").withColumn("run", F.col("base") + F.col("nth"))
    return named.groupBy("run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("path").alias("paths"), F.count("*").alias("events")).drop("run")


def actions(events: DataFrame) -> DataFrame:
    """What a batch does to each path, by its last event: remove or upsert."""
    last = events.groupBy("path").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"))
    return last.select("path", F.when(F.col("kind") == "remove", "remove").otherwise("upsert").alias("action"))
