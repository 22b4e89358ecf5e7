"""Shared plumbing: checkpoints in the cluster's folder, Arrow batches in bounded
chunks, and vectorised hashing of words over UTF-8 buffers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step holds at once (a single longer text is one step).
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a folder of our own if all
    runs on this machine; on a cluster that is an error, as executors wouldn't share it."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="wovengraph-ckpt-")
        atexit.register(shutil.rmtree, where, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that every executor can read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the cluster's file system, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker, which later stages use again, gives free memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def strings(column: pa.Array) -> pa.Array:
    """A string array without nulls (null becomes the empty text), 32-bit offsets."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut record batches so that each piece has about `limit` bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = strings(batch.column(batch.schema.get_field_index(text)))
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset + 1 : column.offset + len(column) + 1].astype(np.int64)
        at, base = 0, int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at), column.slice(at, to - at)
            at, base = to, int(ends[to - 1])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~_SPACE

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(30)
    return x


#: Bytes from which a span is hashed by itself and not in step with the others.
LONG_SPAN = 256
#: Masks of the first 0 to 8 bytes of a lane.
_LOW_BYTES = np.append((np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1), ~np.uint64(0))


class Spans:
    """64-bit hashes of spans of a byte buffer.

    Each eight bytes go through a bijective finaliser that the state so far is mixed into, all
    spans in step, so that no family of byte strings collides by construction: two spans agree
    by chance only (one pair in 2^64).  Long spans go through XXH64."""

    def __init__(self, data: np.ndarray) -> None:
        self._data = np.concatenate([data, np.zeros(8, np.uint8)])
        self._lanes = np.ndarray(len(data) + 1, "<u8", self._data, strides=(1,))

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        lane = self._lanes[starts]
        lane &= _LOW_BYTES[np.minimum(size, 8)]
        lane ^= size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15)
        out = mix(lane)
        left = np.flatnonzero(size > 8)
        at, n = starts[left] + 8, size[left] - 8
        for k in left[n > LONG_SPAN].tolist():
            out[k] = mix(out[k : k + 1] ^ np.uint64(xxhash.xxh64_intdigest(self._data[starts[k] : ends[k]], 17)))[0]
        if len(left) and n.max() > LONG_SPAN:
            short = n <= LONG_SPAN
            left, at, n = left[short], at[short], n[short]
        while len(left):
            lane = self._lanes[at]
            lane &= _LOW_BYTES[np.minimum(n, 8)]
            lane ^= out[left]
            out[left] = mix(lane)
            more = n > 8
            left, at, n = left[more], at[more] + 8, n[more] - 8
        return out


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, never across a text's border."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A border between two members ends one run and starts another.
    change = np.empty(n + 1, bool)
    change[0], change[n] = member[0], member[-1]
    np.not_equal(member[1:], member[:-1], out=change[1:n])
    inner = np.unique(offsets[(offsets > 0) & (offsets < n)])
    inner = inner[member[inner] & member[inner - 1]]
    at = np.flatnonzero(change)
    if len(inner):
        at = np.sort(np.concatenate([at, inner, inner]))
    return at[::2], at[1::2]


def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive `edges`."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[edges[1:]] - sums[edges[:-1]]


def repeats(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: whether its key occurs twice or more in its group, and whether it
    occurs earlier there.  `group` must be ascending."""
    n = len(keys)
    often, later = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        order = np.lexsort((keys, group))
        same = (keys[order][1:] == keys[order][:-1]) & (group[order][1:] == group[order][:-1])
        later[order[1:][same]] = True
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
    return often, later
