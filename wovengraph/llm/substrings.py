"""Substring deduplication by level-wise doubling of repeated word windows.

A window's hash is built by doubling (5, 10, 20 words ...).  At the first level (half the
window) each whole window is represented by one of its sub-windows, the one with the least
hash, so that equal windows are represented alike and only about one word in six starts a
row.  Only sub-windows repeated at that level alone are extended to twice the length; of
these whole windows the least document that has each is found, and every other occurrence,
and every later one within a document, is covered for removal.  `longest` goes on doubling
until no candidates survive.

The text crosses the network once, to meet its document's candidates; what else is shuffled
are hashes of candidates.  Counts and minima combine on the map side, so a passage in a
third of all documents is no hot key there, and the semi join on it is one Spark splits.

Rows: null and empty texts have no words.  Texts of any length are taken whole.  A null id
sorts before all others.  Rows with the same id and text are one document and each gets its
result; rows with the same id and other text are ordered by the text's hash.  Only the named
columns are read; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.llm.common import NOT_SPACE, Spans, buffers, checkpoint, chunks, mix, per_text, repeats, runs

WINDOW = 20


def _join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(a * np.uint64(0xD1342543DE82EF95) + (b ^ (b >> np.uint64(32))) * np.uint64(0xAF251AF3B0F025B5) + np.uint64(salt))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words (size >= 1) from the words' hashes, by doubling."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    if size == 1:
        return h
    half = size // 2
    low = window_hashes(h, half)
    high = low if half * 2 == size else window_hashes(h, size - half)
    n = len(h) - size + 1
    return _join(low[:n], high[half : half + n], size)


class Windows:
    """The word windows of a chunk of texts, with the sub-window that stands for each."""

    def __init__(self, column: pa.Array, size: int) -> None:
        data, offsets = buffers(column)
        starts, ends = runs(NOT_SPACE[data], offsets)
        self.first = np.searchsorted(starts, offsets)
        self.n_words = np.diff(self.first)
        self.size, half = size, size // 2
        h = Spans(data).hash(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        n = max(0, len(h) - size + 1)
        text = np.repeat(np.arange(len(column)), self.n_words)
        #: Flat word positions at which a whole window starts, and their texts.
        self.at = np.flatnonzero(text[:n] == text[size - 1 : size - 1 + n]) if n else np.zeros(0, np.int64)
        self.text = text[self.at]
        if not len(self.at):
            self.half = self.whole = np.zeros(0, np.uint64)
            self.anchor = np.zeros(0, np.int64)
            return
        self.half = window_hashes(h, half)
        low = self.half[: n + size - half]
        least = low[:n].copy()
        for k in range(1, size - half + 1):
            np.minimum(least, low[k : k + n], out=least)
        offset = np.zeros(n, np.int64)
        for k in range(size - half, -1, -1):
            offset[low[k : k + n] == least] = k
        self.whole = _join(low[:n], self.half[half : half + n] if size == 2 * half else window_hashes(h, size - half)[half : half + n], size)[self.at]
        self.anchor = self.at + offset[self.at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, word position in the text) of the sub-windows that stand for a window."""
        at, one = np.unique(self.anchor, return_index=True)
        text = self.text[one]
        return self.half[at], text, at - self.first[text]

    def candidates(self, lists: pa.Array) -> np.ndarray:
        """Indices of the windows whose sub-window's position is in the text's list."""
        wanted = np.zeros(int(self.first[-1]) + 1, bool)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
        wanted[np.repeat(self.first[:-1], sizes) + flat] = True
        return np.flatnonzero(wanted[self.anchor])

    def check(self, rows: np.ndarray) -> np.ndarray:
        """A second, 32-bit hash of windows (of the sub-window), so that both make 96 bits."""
        return (self.half[self.anchor[rows]] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[str], bool]:
    """The documents with columns that tell them apart.  The id alone does unless ids are
    null or repeat, which one count over the ids finds out."""
    ids = docs.groupBy(F.col(doc_id).alias("doc_id")).count()
    plain = ids.where("count > 1 or doc_id is null").isEmpty()
    if plain:
        return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], True
    kind = docs.schema[doc_id].dataType
    some = F.coalesce(F.col(doc_id), F.lit("0").cast(kind))
    return docs.select(F.col(doc_id).isNotNull().alias("there"), some.alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")), ["there", "doc_id", "th"], False


def _types(frame: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {frame.schema[n].dataType.simpleString()}" for n in names)


def _named(batch: pa.RecordBatch, names: list[str], rows: np.ndarray) -> list[pa.Array]:
    taken = pa.array(rows)
    return [batch.column(batch.schema.get_field_index(n)).take(taken) for n in names]


def _candidates(docs: DataFrame, doc_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame, list[str], bool]:
    """(documents, candidate positions per document as `at`, key columns, whether the id is the key)."""
    keyed, key, plain = _keyed(docs, doc_id, text)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, "text"):
            h, rows, at = Windows(column, window).anchors()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *_named(batch, key, rows), pa.array(at.astype(np.int32))], ["h", *key, "at"])

    found = keyed.mapInArrow(anchors, f"h long, {_types(keyed, key)}, at int")
    # The second key, which says nothing new, keeps the join from sharing the count's
    # partitioning, so that Spark can split a passage in a third of all documents.
    part = (F.col("h") > 0).alias("part")
    often = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", part)
    lists = found.select("*", part).join(often, ["h", "part"], "left_semi").groupBy(*key).agg(F.collect_set("at").alias("at"))
    return keyed, lists, key, plain


def _least(key: list[str]) -> Column:
    return F.min(key[0]) if len(key) == 1 else F.min(F.struct(*key))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed (long), kept_sha256, and kept: the words
    left, joined by one space.  A word goes if a window of `window` words covers it that also
    starts earlier: in a smaller document, or before in the same."""
    keyed, lists, key, plain = _candidates(docs, doc_id, text, window)
    kinds = _types(keyed, key)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, "text"):
            lists = batch.column(batch.schema.get_field_index("at"))
            if lists.null_count == len(lists):
                continue
            w = Windows(column, window)
            rows = w.candidates(lists)
            _, later = repeats(w.text[rows], w.whole[rows])
            rows = rows[~later]
            yield pa.RecordBatch.from_arrays([pa.array(w.whole[rows].view(np.int64)), pa.array(w.check(rows)), *_named(batch, key, w.text[rows])], ["h", "c", *key])

    met = keyed.join(lists, key, "left").select(*key, "text", "at")
    least = met.mapInArrow(whole, f"h long, c int, {kinds}").groupBy("h", "c").agg(_least(key).alias("least"))
    owned = least.select("h", *([F.col("least").alias("doc_id")] if len(key) == 1 else [F.col(f"least.{k}").alias(k) for k in key]))
    own = owned.groupBy(*key).agg(F.collect_set("h").alias("own"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, "text"):
            texts = [t.split() for t in column.cast(pa.binary()).to_pylist()]
            n_words = np.array([len(t) for t in texts], np.int64)
            n_removed = np.zeros(len(column), np.int64)
            lists, mine = (batch.column(batch.schema.get_field_index(c)) for c in ("at", "own"))
            if lists.null_count < len(lists):
                w = Windows(column, window)
                rows = w.candidates(lists)
                _, later = repeats(w.text[rows], w.whole[rows])
                sizes = np.array([0 if x is None else x for x in mine.value_lengths().to_pylist()], np.int64)
                flat = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                # A window stays if its document's list has its hash: both sides keyed by text.
                salt = mix(np.arange(len(column), dtype=np.uint64) + np.uint64(1))
                kept = np.isin(w.whole[rows] ^ salt[w.text[rows]], flat ^ np.repeat(salt, sizes))
                gone = w.at[rows[later | ~kept]]
                change = np.zeros(int(w.first[-1]) + 1, np.int64)
                np.add.at(change, gone, 1)
                np.add.at(change, gone + window, -1)
                stays = np.cumsum(change)[:-1] == 0
                n_removed = n_words - per_text(stays, w.first)
                for k in np.flatnonzero(n_removed):
                    texts[k] = list(compress(texts[k], stays[w.first[k] : w.first[k + 1]].tolist()))
            left = [b" ".join(t) for t in texts]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            if not plain:
                there = batch.column(batch.schema.get_field_index("there"))
                ids = pa.array([i if t else None for i, t in zip(ids.to_pylist(), there.to_pylist(), strict=True)], ids.type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_removed), pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string()), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    both = lists.join(own, key, "left")
    schema = f"{_types(keyed, ['doc_id'])}, n_words long, n_removed long, kept_sha256 string, kept string"
    return keyed.join(both, key, "left").select(*key, "text", "at", "own").mapInArrow(rest, schema)


def longest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key columns, start, words): every start of a repeated window with the longest length of
    `window` times a power of two at which it is repeated."""
    keyed, lists, key, _ = _candidates(docs, doc_id, text, window)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, "text"):
            w = Windows(column, window)
            rows = w.candidates(batch.column(batch.schema.get_field_index("at")))
            yield pa.RecordBatch.from_arrays([pa.array(w.whole[rows].view(np.int64)), *_named(batch, key, w.text[rows]), pa.array((w.at[rows] - w.first[w.text[rows]]).astype(np.int32))], ["h", *key, "start"])

    level = keyed.join(lists, key, "left").select(*key, "text", "at").mapInArrow(whole, f"h long, {_types(keyed, key)}, start int").distinct()
    found, words = None, window
    while True:
        often = level.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        level = checkpoint(level.join(often, "h", "left_semi"))
        if level.isEmpty():
            break
        rows = level.select(*key, "start", F.lit(words).alias("words"))
        found = rows if found is None else found.union(rows)
        after = level.select(*key, (F.col("start") - words).alias("start"), F.col("h").alias("h2"))
        level = level.join(after, [*key, "start"]).select(*key, "start", F.xxhash64("h", "h2").alias("h"))
        words *= 2
    if found is None:
        return level.select(*key, "start", F.lit(words).alias("words"))
    return found.groupBy(*key, "start").agg(F.max("words").alias("words"))
