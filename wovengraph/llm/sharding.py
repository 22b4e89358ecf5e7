"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots, far more than shards.  Bytes are summed per slot,
and a versioned map sends slots to shards.  Rebalancing loads the map in force and edits it: it
moves as few bytes as it takes to bring every shard near the mean, and the edited map gets the
next version, so that old versions stay readable and a record's slot never changes.  Where
nothing has to move the version in force stays.

The law that holds is `bytes`: shards are near equal in size.  The map has a row a slot, a
number fixed by parameter, so it is small enough for the driver and the executors whatever
the input.  A record's place in its shard follows from counts per cell (slot and part of
the hash), so no task numbers the rows of a whole shard.

Rows: a null text has no bytes.  Null ids hash like any other value.  A record's slot follows
from its id and text; repeated rows, which these can't tell apart, are spread over the slots
by a serial number, so that however often a row is repeated the law holds.  A text larger than
a shard's share makes its shard that large.  An empty table gives an empty result; only the
named columns are read."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wovengraph.llm.common import checkpoint

#: Virtual slots; cells a slot for numbering; bytes that a record takes beside its text.
SLOTS, CELLS, OVERHEAD = 8192, 8, 8


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: `shard[s]` is slot s's shard."""

    version: int
    shards: int
    shard: tuple[int, ...]

    @staticmethod
    def first(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots dealt round robin, before any size is known."""
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, size: np.ndarray, shards: int | None = None, tolerance: float = 0.0005) -> SlotMap:
        """The next version, for slots of `size` bytes and perhaps another number of shards:
        slots of shards that are gone, then of the fullest, move to the emptiest until all lie
        within `tolerance` of the mean or no move of one slot or swap of two helps."""
        shards = shards or self.shards
        at = np.array(self.shard, np.int64)
        weight = np.asarray(size, np.int64)
        load = np.bincount(at[at < shards], weight[at < shards], shards).astype(np.int64)
        queue = [(int(load[k]), k) for k in range(shards)]
        heapq.heapify(queue)
        lost = np.flatnonzero(at >= shards)
        for s in lost[np.argsort(-weight[lost], kind="stable")]:
            _, k = heapq.heappop(queue)
            at[s] = k
            load[k] += weight[s]
            heapq.heappush(queue, (int(load[k]), k))
        mean = weight.sum() / shards
        for _ in range(50 * shards):
            full, empty = int(load.argmax()), int(load.argmin())
            gap = int(load[full] - load[empty])
            if gap <= 1 or max(load[full] - mean, mean - load[empty]) <= tolerance * mean:
                break
            # The move, or swap, that takes closest to half the gap from the fullest to the emptiest.
            mine, theirs = np.flatnonzero(at == full), np.flatnonzero((at == empty) & (weight > 0))
            mine = mine[weight[mine] > 0]
            other = np.concatenate([[0], np.sort(weight[theirs])])
            k = np.clip(np.searchsorted(other, weight[mine] - gap / 2), 1, len(other)) - 1
            k = np.stack([k, np.minimum(k + 1, len(other) - 1)])
            miss = np.abs(weight[mine] - other[k] - gap / 2)
            row, col = np.unravel_index(int(miss.argmin()), miss.shape)
            moved = int(weight[mine[col]] - other[k[row, col]])
            if not 0 < moved < gap:
                break
            at[mine[col]] = empty
            if back := other[k[row, col]]:
                at[theirs[weight[theirs] == back][0]] = full
            load[full] -= moved
            load[empty] += moved
        return SlotMap(self.version + 1, shards, tuple(int(x) for x in at))

    def moved(self, other: SlotMap) -> int:
        """Slots that lie elsewhere in the other version."""
        return sum(a != b for a, b in zip(self.shard, other.shard, strict=True))

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to a folder of versions; a version is never written over."""
        row = json.dumps({"version": self.version, "shards": self.shards, "shard": self.shard})
        spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("error").text(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A stored version; the last unless one is named."""
        if version is None:
            version = max(SlotMap.versions(spark, folder))
        x = json.loads(spark.read.text(f"{folder}/version={version}").collect()[0].value)
        return SlotMap(x["version"], x["shards"], tuple(x["shard"]))

    @staticmethod
    def versions(spark: SparkSession, folder: str) -> list[int]:
        """The versions stored in a folder, none if it isn't there."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        names = [x.getPath().getName() for x in files.listStatus(where)]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def in_force(spark: SparkSession, folder: str, shards: int, slots: int = SLOTS) -> SlotMap:
    """The last version in the folder; where there is none, version 1, which is stored."""
    if SlotMap.versions(spark, folder):
        return SlotMap.load(spark, folder)
    made = SlotMap.first(shards, slots)
    made.save(spark, folder)
    return made


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, serial, virtual_slot, cell) of every record."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(doc_id, text).alias("h"),
        F.monotonically_increasing_id().alias("serial"),
    )
    rows = checkpoint(rows)  # some 40 bytes a row; from here on a row keeps its serial number
    often = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(True).alias("often"))
    key = F.when(F.col("often"), F.xxhash64("h", "serial")).otherwise(F.col("h"))
    return (
        rows.join(often, "h", "left")
        .withColumn("h", key)
        .select("doc_id", "size", "text_crc32", "serial", F.pmod("h", F.lit(slots)).cast("int").alias("virtual_slot"), F.pmod(F.shiftrightunsigned("h", 32), F.lit(CELLS)).cast("int").alias("cell"))
    )


def place(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, start: SlotMap | None = None, folder: str | None = None) -> DataFrame:
    """A row for each record: doc_id, size, text_crc32, law, shard, slot (its place in the shard,
    gapless from 0), grown_shard (null under this law), virtual_slot and map_version.

    `start` is the map to edit; else the one in force in `folder`, else version 1.  An edited map
    is stored in `folder` if one is given."""
    spark = docs.sparkSession
    start = start or (in_force(spark, folder, shards, slots) if folder else SlotMap.first(shards, slots))
    rows = checkpoint(records(docs, doc_id, text, slots))
    cells = rows.groupBy("virtual_slot", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    counted = cells.toPandas().sort_values(["virtual_slot", "cell"])  # slots * CELLS rows at most
    size = np.bincount(counted.virtual_slot.to_numpy(np.int64), counted.bytes.to_numpy(np.int64), slots).astype(np.int64)
    made = start.rebalanced(size, shards)
    if made.shard == start.shard and made.shards == start.shards:
        made = start
    elif folder:
        made.save(spark, folder)
    shard = np.array(made.shard, np.int64)
    before = np.zeros(slots * CELLS, np.int64)
    n = np.zeros(slots * CELLS, np.int64)
    n[counted.virtual_slot.to_numpy(np.int64) * CELLS + counted.cell.to_numpy(np.int64)] = counted.n
    order = np.argsort(np.repeat(shard, CELLS), kind="stable")
    sums = np.cumsum(n[order]) - n[order]
    of = np.repeat(shard, CELLS)[order]
    begin = np.searchsorted(of, np.arange(shards))
    before[order] = sums - sums[np.minimum(begin[of], len(sums) - 1)]
    table = F.broadcast(spark.createDataFrame([(k // CELLS, k % CELLS, int(shard[k // CELLS]), int(before[k])) for k in np.flatnonzero(n).tolist()], "virtual_slot int, cell int, shard int, before long"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "text_crc32", "size", "serial")) - 1
    return (
        rows.withColumn("nth", nth)
        .join(table, ["virtual_slot", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(made.version).alias("map_version"))
    )
