"""Sequence packing by non-negative least squares over the length histogram.

Documents become token ids and are cut at the window; the last piece of each is what has to
be packed.  Lengths are rounded up to units, all combinations of up to `depth` units that
fill a window are enumerated, and their repeat counts are the non-negative least-squares
solution against the histogram of pieces, rounded so that no piece is used twice.  What is
left is packed greedily, largest first, into the best-fitting room.

Only the histogram (one row a unit) reaches the driver, and only the plan (a few patterns a
unit) goes back.  A piece's place follows from its rank among the pieces of its unit; ranks
come from cells of (unit, salt), so no task holds all pieces of one length.

Rows: a null or empty text is the closing id alone.  Repeated rows are packed each on their
own.  Texts of any length are cut into as many pieces as needed.  An empty table gives an
empty result; only the named columns are read."""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wovengraph.llm.common import Spans, buffers, checkpoint, chunks, released, runs
from wovengraph.llm.lexicon import Lexicon, spread
from wovengraph.llm.merges import RankMerger

WINDOW, UNIT, DEPTH = 2048, 8, 3
#: Rows of one ranking cell, about.
CELL_ROWS = 500_000
#: Text bytes encoded at once.
ENCODE_BYTES = 1 << 20


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARKS = b",.;:!?"
_MARK = np.zeros(256, bool)
_MARK[list(_MARKS)] = True


class Encoder:
    """Ids of a byte-level word-end BPE tokenizer that drops white space.

    The tokenizer's pre-tokens never hold white space and its normalisation doesn't reach
    across it, so a text's ids are those of its parts between spaces, tabs and line ends.
    Parts made of letters up to U+00FF, with or without a mark at the end, are lower-cased
    and merged here in batches (letters and marks are pre-tokens of their own); all others
    go to the library.  A worker keeps the ids of parts seen, by 64-bit hash."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known = Lexicon()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [np.array([vocabulary[x] for x in side], np.int64) for side in (*zip(*pairs, strict=True), [a + b for a, b in pairs])]
        beside = [(vocabulary[a[-1]], vocabulary[b if b[1:] == "</w>" else b[0]]) for a, b in pairs]
        self._merger = RankMerger(ids[0], ids[1], np.arange(len(pairs)), ids[2], np.array(beside, np.int64))
        symbols = _byte_symbols()
        self._inner = np.array([vocabulary[c] for c in symbols], np.int64)
        self._last = np.array([vocabulary[c + "</w>"] for c in symbols], np.int64)
        self._mark_id = np.zeros(256, np.int64)
        for b in _MARKS:
            (self._mark_id[b],) = self._tokenizer.encode(chr(b), add_special_tokens=False).ids

    def _learn(self, data: np.ndarray, low: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, simple: np.ndarray) -> None:
        """Encode parts not seen before."""
        s, e = starts[simple], ends[simple]
        if len(s):
            first = np.concatenate([[0], np.cumsum(e - s)])
            flat = low[spread(s, e - s)]
            symbols = self._inner[flat]
            symbols[first[1:] - 1] = self._last[flat[first[1:] - 1]]
            ids, edges = self._merger.merge(symbols, first)
            self._known.add(keys[simple], np.diff(edges), ids)
        rest = np.flatnonzero(~simple)
        if len(rest):
            raw = data.tobytes()
            parts = [raw[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            found = [e.ids for at in range(0, len(parts), 4096) for e in self._tokenizer.encode_batch_fast(parts[at : at + 4096], add_special_tokens=False)]
            self._known.add(keys[rest], np.array([len(i) for i in found], np.int64), np.array([x for i in found for x in i], np.int64))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (and the total).
        `data` holds the UTF-8 texts, text k from offsets[k] to offsets[k + 1]."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        letter = _ASCII_LETTER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        follow = data[lead + 1]
        # U+00C0 to U+00FF without the two signs; of these the first 31 are capitals.
        good = (follow != 0x97) & (follow != 0xB7)
        letter[lead[good]] = letter[lead[good] + 1] = True
        low[lead[good & (follow < 0x9F)] + 1] += 32
        starts, ends = runs(~_BLANK[data], offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        letters = np.zeros(len(data) + 1, np.int32)
        np.cumsum(letter, out=letters[1:])
        inside, length, last = letters[ends] - letters[starts], ends - starts, data[ends - 1]
        marked = (inside == length - 1) & _MARK[last] & (length > 1)
        simple = marked | (inside == length)
        stops = ends - marked
        keys = np.empty(len(starts), np.uint64)
        keys[simple] = Spans(low).hash(starts[simple], stops[simple])
        keys[~simple] = ~Spans(data).hash(starts[~simple], stops[~simple])
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self._known.keys) + len(distinct) > self._known.limit:
            self._known.clear()
        new = at[self._known.missing(distinct)]
        if len(new):
            self._learn(data, low, keys[new], starts[new], stops[new], simple[new])
        first, size = (x[which] for x in self._known.find(distinct))
        total = size + marked
        begin = np.cumsum(total) - total
        ids = np.empty(int(total.sum()), np.int32)
        ids[spread(begin, size)] = self._known.values[spread(first, size)]
        ids[(begin + size)[marked]] = self._mark_id[last[marked]]
        edges = np.concatenate([begin, [len(ids)]])[np.searchsorted(starts, offsets)]
        return ids, edges


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker's encoder, made once."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document cut at the window."""
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, text, ENCODE_BYTES):
            rows, start, length, crc, total = [], [], [], [], []
            ids, edges = encoder(path).encode(*buffers(column))
            raw, edges = ids.astype("<u4").tobytes(), edges.tolist()
            for k in range(len(column)):
                own = raw[4 * edges[k] : 4 * edges[k + 1]] + end
                n = len(own) // 4
                for at in range(0, n, window):
                    rows.append(k)
                    start.append(at)
                    length.append(min(window, n - at))
                    crc.append(zlib.crc32(own[4 * at : 4 * (at + window)]))
                    total.append(n)
            own = batch.column(batch.schema.get_field_index(doc_id)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(doc_id, text).mapInArrow(released(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(units: int, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to `depth` (1 to 3) unit counts, descending and padded by 0, with sum `units`."""
    found = [(units, 0, 0)]
    if depth > 1:
        found += [(units - b, b, 0) for b in range(1, units // 2 + 1)]
    if depth > 2:
        found += [(units - b - c, b, c) for c in range(1, units // 3 + 1) for b in range(c, (units - c) // 2 + 1)]
    return np.array(found, np.int64)


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None, tolerance: float = 1e-9) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |ax - b| with x >= 0."""
    n = a.shape[1]
    x, passive = np.zeros(n), []
    scale = tolerance * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(most or 4 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= scale:
            break
        passive.append(best)
        while passive:
            z = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (z > scale).all():
                x[:] = 0
                x[passive] = z
                break
            now = x[passive]
            low = z <= scale
            step = float(np.min(now[low] / np.maximum(now[low] - z[low], 1e-300)))
            now = now + step * (z - now)
            x[:] = 0
            x[passive] = np.maximum(now, 0)
            passive = [p for p in passive if x[p] > scale]
    return x


@dataclass(frozen=True)
class Plan:
    """Patterns of units with how often each is made; for each unit, where its ranks go."""

    patterns: list[tuple[tuple[int, ...], int]]

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each unit: the first rank of each interval, its first sequence, its slot."""
        used: dict[int, int] = {}
        out: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for pattern, times in self.patterns:
            for slot, unit in enumerate(pattern):
                out.setdefault(unit, []).append((used.get(unit, 0), base, slot))
                used[unit] = used.get(unit, 0) + times
            base += times
        return {u: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for u, rows in out.items()}


def plan(histogram: np.ndarray, depth: int = DEPTH) -> Plan:
    """`histogram[u]`: pieces of u units, u from 1 to the window's units (index 0 unused)."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    made: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        ways = combinations(units, depth)
        ways = ways[((left[ways] > 0) | (ways == 0)).all(1)]
        if len(ways):
            a = np.zeros((units, len(ways)))
            for k in range(3):
                rows = np.flatnonzero(ways[:, k])
                np.add.at(a, (ways[rows, k] - 1, rows), 1)
            x = nnls(a, left[1:].astype(float))
            for w in np.argsort(-x, kind="stable"):
                parts = [int(p) for p in ways[w] if p]
                times = min(int(np.rint(x[w])), *(left[p] // parts.count(p) for p in parts))
                if times > 0:
                    for p in parts:
                        left[p] -= times
                    made.append((tuple(parts), int(times)))
    # The residual: largest first, then whatever fits best into the room that is left.
    while left.any():
        room, pattern, free = units, [], left.copy()
        while room:
            fits = np.flatnonzero(free[1 : room + 1])
            if not len(fits):
                break
            u = int(fits[-1]) + 1
            n = min(int(free[u]), room // u)
            pattern += [u] * n
            free[u] -= n
            room -= n * u
        times = int(min(left[u] // pattern.count(u) for u in set(pattern)))
        for u in set(pattern):
            left[u] -= times * pattern.count(u)
        made.append((tuple(pattern), times))
    return Plan(made)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, end_id: int = 1) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = checkpoint(pieces(docs, path, doc_id, text, window, end_id)).withColumn("unit", F.ceil(F.col("length") / unit).cast("int"))
    counts = {r[0]: r[1] for r in cut.groupBy("unit").count().collect()}  # at most window / unit rows
    histogram = np.zeros(window // unit + 1, np.int64)
    for u, n in counts.items():
        histogram[u] = n
    places = plan(histogram, depth).places()
    salts = int(histogram.sum()) // CELL_ROWS + 64
    cells = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    sizes = cells.groupBy("unit", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("unit", "salt", (F.sum("n").over(Window.partitionBy("unit").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("unit", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cells.withColumn("within", within).join(before, ["unit", "salt"]).select(*cut.columns, (F.col("before") + F.col("within") - 1).alias("rank"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("unit", "rank"))
            sequence, slot = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
            for one in np.unique(u):
                rows = np.flatnonzero(u == one)
                first, base, slots = places[int(one)]
                k = np.searchsorted(first, r[rows], "right") - 1
                sequence[rows], slot[rows] = base[k] + r[rows] - first[k], slots[k]
            keep = [batch.column(k) for k, c in enumerate(batch.schema.names) if c not in ("unit", "rank")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(slot)], [*(c for c in batch.schema.names if c not in ("unit", "rank")), "sequence_id", "slot"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(put, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0).cast("long"))).drop("slot")
