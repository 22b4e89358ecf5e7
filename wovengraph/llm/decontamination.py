"""Benchmark decontamination with an Aho-Corasick automaton.

Texts and items are normalised to words, and words to the numbers of the benchmark's
vocabulary.  A window of 13 words of an item always holds one of the item's pieces of seven
words that start at a multiple of seven, so one automaton over these pieces (short items
whole) finds every candidate in a single scan of a text, and comparing up to six words to
either side of a piece, in all places where items have it, tells whether a window occurs.
The automaton has about a node a benchmark word: 11 MB of items take some 250 MB of a worker
with the tables beside it, measured.  A hit word's number leads back to its byte
offsets in the original.

The items travel to the executors as a broadcast of bounded size.  A benchmark of more than
BLOCK_BYTES is dealt into blocks; then the texts pass once for each block, with a checkpoint
between, so that no worker and no driver holds more than one block.

Rows: null text has no words.  An item without words has no window; one of fewer words
than a window is one window.  Items with a null id hit words but are not listed.  Repeated
items and windows count once; repeated documents are judged each on their own.  Only the
named columns are read.  An empty benchmark leaves every document clean."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wovengraph.llm.common import NOT_SPACE, checkpoint, chunks, released

WINDOW = 13
#: Bytes of item text that one automaton is made from, at most (one longer item is cut at this size, overlapping by a window).
BLOCK_BYTES = 16 << 20
#: The share of words hit from which a document counts as contaminated: 1 in 20.
SHARE = 20

#: The number of a word that no item has.
_UNKNOWN = 0x7FFFFFFF

_NORMAL = bytearray(b" " * 256)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _NORMAL[_b] = ord(chr(_b).lower()) if _b < 128 else _b
_NORMAL = bytes(_NORMAL)


def normal_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters and digits and all other characters, A-Z lower-cased."""
    return text.translate(_NORMAL).split()


class Automaton:
    """An automaton over the items' pieces, and where in the items each piece stands."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.window, self.size = window, (window + 1) // 2
        self.names: list[str | None] = []
        self.words: dict[bytes, int] = {}
        flat: list[int] = []
        starts: list[int] = []
        places: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            own = [self.words.setdefault(w, len(self.words)) for w in normal_words(text)]
            if not own:
                continue
            at = len(flat)
            starts.append(at)
            self.names.append(item)
            flat += own
            flat.append(-1)  # no word runs on into the next item
            if len(own) < window:
                places.setdefault((-1, *own), []).append(at)
            else:
                for k in range(0, len(own) - self.size + 1, self.size):
                    places.setdefault(tuple(own[k : k + self.size]), []).append(at + k)
        margin = [-1] * window
        self.flat = np.array(margin + flat + margin, np.int32)
        self.starts = np.array(starts, np.int64)
        self.places: list[tuple[bool, int, np.ndarray]] = []
        keys: dict[tuple[int, ...], list[int]] = {}
        for key, at in places.items():
            whole = key[0] == -1
            keys.setdefault(key[1:] if whole else key, []).append(len(self.places))
            self.places.append((whole, len(key) - whole, np.array(at, np.int64)))
        self.scanner = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in keys.items():
            self.scanner.add_word(key, tuple(found))
        if keys:
            self.scanner.make_automaton()

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set, bool]:
        """(sorted indices of the words hit, ids of the items found, whether a whole window was)."""
        known = self.words.get
        text = tuple(known(w, _UNKNOWN) for w in words)
        found = list(self.scanner.iter(text)) if self.places and text else []
        if not found:
            return np.zeros(0, np.int64), set(), False
        reach = self.window - self.size
        own = np.concatenate([np.full(reach, -2, np.int32), np.array(text, np.int32), np.full(reach, -2, np.int32)])
        hit, ids, full = np.zeros(len(words) + 1, np.int64), set(), False
        for end, which in found:
            for k in which:
                whole, size, at = self.places[k]
                first = end - size + 1
                if whole:
                    low, high = first, end + 1
                else:
                    # How far the text and each place agree before and after the piece.
                    before, after = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    for step, reached in ((-1, before), (1, after)):
                        live = np.arange(len(at))
                        for j in range(1, reach + 1):
                            here = own[reach + (first - j if step < 0 else end + j)]
                            there = self.flat[self.window + at[live] + (-j if step < 0 else size - 1 + j)]
                            live = live[there == here]
                            if not len(live):
                                break
                            reached[live] = j
                    enough = before + size + after >= self.window
                    if not enough.any():
                        continue
                    at, full = at[enough], True
                    low, high = first - int(before[enough].max()), end + 1 + int(after[enough].max())
                    if len(at) > 1:  # the longest reach to either side need not be one place's
                        for x, y in set(zip(before[enough].tolist(), after[enough].tolist(), strict=True)):
                            hit[first - x] += 1
                            hit[end + 1 + y] -= 1
                        low = high
                if low < high:
                    hit[low] += 1
                    hit[high] -= 1
                ids |= {self.names[i] for i in np.unique(np.searchsorted(self.starts, at, "right") - 1)}
        return np.flatnonzero(np.cumsum(hit)[:-1] > 0), ids, full


_made: dict[str, Automaton] = {}


def _loaded(shared: Broadcast, window: int) -> Automaton:
    """The automaton of a broadcast block, built once in a worker, which keeps the last one."""
    name, items = shared.value
    if name not in _made:
        _made.clear()
        _made[name] = Automaton(items, window)
    return _made[name]


def original_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of runs of hit words in the original text."""
    if not len(hit):
        return []
    plain = np.frombuffer(text.translate(_NORMAL), np.uint8)
    inside = np.zeros(len(plain) + 2, bool)
    inside[1:-1] = NOT_SPACE[plain]
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    cut = np.flatnonzero(np.diff(hit) > 1)
    return [(int(starts[hit[i]]), int(ends[hit[j]])) for i, j in zip([0, *(cut + 1)], [*cut, len(hit) - 1], strict=True)]


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark's distinct items in blocks of bounded size; the driver holds one block."""
    block, size = [], 0
    for item, body in benchmark.select(F.col(item_id).cast("string"), F.col(text)).where(F.col(text).isNotNull()).distinct().toLocalIterator():
        words = normal_words(body.encode())
        if not words:
            continue
        step = max(1, limit // (1 + max(map(len, words))) - window)
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = b" ".join(words[at : at + step + window - 1])
            if block and size + len(piece) > limit:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += len(piece)
    if block:
        yield block


def _contaminated(n_words: int, n_hit: int, share: int) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


#: What is known of a text so far: words hit, items found, whether a whole window was.
_STATE = pa.struct([("hit", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("full", pa.bool_())])


def _scanned(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, finish: Callable, schema: str | T.StructType) -> DataFrame:
    """`finish` makes the rows of `schema` from a batch of `docs`, its texts as bytes, and of each
    text (number of words, words hit, items found, whether a whole window was)."""
    state = "__found"
    while state in docs.columns:
        state += "_"

    def step(block: Broadcast | None, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, column in chunks(batches, text):
                texts, found = column.cast(pa.binary()).to_pylist(), []
                k = batch.schema.get_field_index(state)
                before = batch.column(k).to_pylist() if k >= 0 else [None] * len(texts)
                for t, old in zip(texts, before, strict=True):
                    words = normal_words(t)
                    hit, items, full = _loaded(block, window).find(words) if block else (np.zeros(0, np.int64), set(), False)
                    if old:
                        hit, items, full = np.union1d(hit, np.array(old["hit"], np.int64)), items | set(old["items"]), full or old["full"]
                    found.append((len(words), hit, items, full))
                if k >= 0:
                    batch = batch.remove_column(k)
                if last:
                    yield finish(batch, texts, found)
                else:
                    kept = pa.array([{"hit": h, "items": sorted(i, key=str), "full": w} for _, h, i, w in found], _STATE)
                    yield pa.RecordBatch.from_arrays([*batch.columns, kept], [*batch.schema.names, state])

        return run

    between = T.StructType([*docs.schema.fields, T.StructField(state, T.StructType.fromDDL("hit array<bigint>, items array<string>, full boolean"))])
    context, held = docs.sparkSession.sparkContext, None
    for items in item_blocks(benchmark, item_id, item_text, window):
        if held:
            docs = checkpoint(docs.mapInArrow(released(step(held, False)), between))
            held.unpersist()
        held = context.broadcast((uuid.uuid4().hex, items))
    return docs.mapInArrow(released(step(held, True)), schema)


def judge(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items (ids sorted as strings),
    items_sha256, contaminated (n_hit > 0, and one word in `share` at least is hit), and spans: the
    hit runs as byte offsets of the original text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def finish(batch: pa.RecordBatch, texts: list[bytes], found: list) -> pa.RecordBatch:
        items = [sorted(i for i in ids if i is not None) for _, _, ids, _ in found]
        spans = [[{"start": a, "end": b} for a, b in original_spans(t, h)] for t, (_, h, _, _) in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index(doc_id)),
                pa.array([n for n, _, _, _ in found], pa.int64()),
                pa.array([len(h) for _, h, _, _ in found], pa.int64()),
                pa.array([len(i) for i in items], pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                pa.array([_contaminated(n, len(h), share) for n, h, _, _ in found], pa.bool_()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"],
        )

    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
    return _scanned(docs.select(doc_id, text), benchmark, text, item_id, item_text, window, finish, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark passage: a whole window
    of an item anywhere, however long the document, or so many short items that one word in
    `share` is hit (a short item may be an everyday phrase).  Null and empty texts, and texts
    that hit nothing, stay; repeated rows stay or go together."""

    def finish(batch: pa.RecordBatch, texts: list[bytes], found: list) -> pa.RecordBatch:
        return batch.filter(pa.array([not (full or _contaminated(n, len(h), share)) for n, h, _, full in found], pa.bool_()))

    return _scanned(docs, benchmark, text, item_id, item_text, window, finish, docs.schema)
