"""Token counts of a byte-fallback BPE piece model by rank-synchronous array merging.

Texts are cut into pre-tokens: a run of spaces with the word that follows (no piece of such
a model holds a space mark after another character, which is checked), and line ends, of
which each is a byte token (checked too).  A worker's distinct pre-tokens are merged in
batches held as ragged arrays (`merges`), the surviving symbols of each are counted (one for
a piece, its UTF-8 bytes for an unknown character), and the counts are kept by hash.

Rows: null and empty texts have no tokens.  Texts of any length are counted whole.  Repeated rows are counted each.  Only the
named columns are read; an empty table gives an empty result."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wovengraph.llm.common import Spans, buffers, chunks, mix, released, runs
from wovengraph.llm.lexicon import Lexicon, spread
from wovengraph.llm.merges import RankMerger

SPACE = "▁"
#: Text bytes counted at once.
COUNT_BYTES = 1 << 20


class Counter:
    """Counts tokens as the library does without begin or end tokens."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError("a piece holds a space mark after another character, or a line end")
        if [model.id_to_piece(i) for i in model.encode("a  b")][:1] != [f"{SPACE}a"] or len(model.encode(" " * 99)) < 2:
            raise ValueError("the model has no space mark before a text or drops spaces")
        chars = sorted({c for p in pieces for c in p})
        symbol = {c: k for k, c in enumerate(chars)}
        for p in pieces:
            symbol.setdefault(p, len(symbol))
        self._of_char = np.full(0x110000, -1, np.int64)
        self._of_char[[ord(c) for c in chars]] = np.arange(len(chars))
        # A character of longer pieces need not be a piece itself; alone it falls back to bytes.
        self._cost = np.ones(len(symbol), np.int64)
        for c in chars:
            if c not in pieces:
                self._cost[symbol[c]] = len(c.encode())
        _, order = np.unique([-s for s in pieces.values()], return_inverse=True)
        rows = [(symbol[p[:i]], symbol[p[i:]], int(k), symbol[p]) for p, k in zip(pieces, order, strict=True) for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
        beside = {(symbol[a], symbol[b]) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self._merger = RankMerger(*np.array(rows, np.int64).T, np.array(sorted(beside), np.int64))
        self._known = Lexicon()

    def _merged(self, words: bytes, chars: np.ndarray, spaces: np.ndarray) -> np.ndarray:
        """Tokens of pre-tokens: `spaces[k]` space marks and the next `chars[k]` characters of `words`."""
        points = np.frombuffer(words.decode().encode("utf-32-le"), np.uint32)
        size = spaces + chars
        first = np.concatenate([[0], np.cumsum(size)])
        all_points = np.full(int(first[-1]), ord(SPACE), np.int64)
        all_points[spread(first[:-1] + spaces, chars)] = points
        symbols = self._of_char[all_points]
        # Unknown characters never merge; -1 less the bytes tells how many tokens each makes.
        width = 1 + (all_points > 0x7F) + (all_points > 0x7FF) + (all_points > 0xFFFF)
        symbols = np.where(symbols < 0, -1 - width, symbols)
        left, edges = self._merger.merge(symbols, first)
        cost = np.where(left < 0, -1 - left, self._cost[np.maximum(left, 0)])
        sums = np.concatenate([[0], np.cumsum(cost)])
        return sums[edges[1:]] - sums[edges[:-1]]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; `data` holds the UTF-8 texts, text k from offsets[k] to offsets[k + 1]."""
        n_texts = len(offsets) - 1
        if not len(data):
            return np.zeros(n_texts, np.int64)
        space, line = data == 32, data == 10
        if SPACE.encode() in data.tobytes():  # the mark itself counts as a space
            raw = data.tobytes()
            texts = [raw[a:b].replace(SPACE.encode(), b" ") for a, b in zip(offsets, offsets[1:], strict=False)]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            space, line = data == 32, data == 10
        begins = offsets[:-1][offsets[1:] > offsets[:-1]]  # where texts with characters begin
        starts, ends = runs(~(space | line), offsets)
        left, right = runs(space, offsets)
        size = right - left + np.isin(left, begins)
        # Spaces before each word, with the one that every text has before it.
        spaces = np.zeros(len(starts), np.int64)
        taken = np.zeros(len(left), bool)
        if len(left):
            k = np.minimum(np.searchsorted(right, starts), len(left) - 1)
            near = (right[k] == starts) & ~np.isin(starts, begins)
            spaces[near] = size[k[near]]
            taken[k[near]] = True
        spaces[np.isin(starts, begins)] = 1
        # Spaces without a word after them, and texts that begin with a line end.
        bare = begins[line[begins]]
        starts = np.concatenate([starts, right[~taken], bare])
        ends = np.concatenate([ends, right[~taken], bare])
        spaces = np.concatenate([spaces, size[~taken], np.ones(len(bare), np.int64)])
        text = np.concatenate([np.searchsorted(offsets, starts[: len(starts) - len(bare) - int((~taken).sum())], "right") - 1, np.searchsorted(offsets, left[~taken], "right") - 1, np.searchsorted(offsets, bare, "right") - 1])
        keys = mix(Spans(data).hash(starts, ends) + spaces.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self._known.keys) + len(distinct) > self._known.limit:
            self._known.clear()
        new = at[self._known.missing(distinct)]
        if len(new):
            s, e = starts[new], ends[new]
            before = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=before[1:])
            found = self._merged(data[spread(s, e - s)].tobytes(), before[e] - before[s], spaces[new])
            self._known.add(keys[new], np.ones(len(new), np.int64), found)
        first, _ = self._known.find(distinct)
        each = self._known.values[first][which]
        out = np.bincount(text, each, n_texts).astype(np.int64)
        lines = np.zeros(len(data) + 1, np.int64)
        np.cumsum(line, out=lines[1:])
        return out + lines[offsets[1:]] - lines[offsets[:-1]]


@functools.cache
def counter(path: str) -> Counter:
    """A worker's counter, made once."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens (long), over_limit (boolean)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, text, COUNT_BYTES):
            data, offsets = buffers(column)
            n = counter(path).count(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(doc_id)), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(doc_id, text).mapInArrow(released(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
