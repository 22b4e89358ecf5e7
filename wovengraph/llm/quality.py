"""Quality rules as a short-circuit cascade.

Each rule is a measure of a text and a test that rejects it.  The cascade estimates
each rule's cost (seconds a text) and selectivity (share rejected) on a random sample of
bounded size that is drawn from all partitions and measured on the executors, then applies
the rules in the order of rejections per cost, and measures a text for a rule only while no
earlier rule has rejected it.  The order changes the time taken and never the verdict, since
a text is kept if no rule rejects it.

Rows: null text has no words, like the empty text.  Texts of any length are measured
whole.  Repeated rows are judged each on their own; an empty table gives an empty result.
Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wovengraph.llm.common import NOT_SPACE, Spans, buffers, chunks, per_text, released, repeats, runs

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BULLET = np.zeros(256, bool)
_BULLET[list(b"-*")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Rows, about, on which costs and selectivities are estimated, tasks that measure them, and bytes measured at once.
SAMPLE_ROWS, SAMPLE_TASKS, SAMPLE_BYTES = 2000, 4, 1 << 20
#: Measures of a text that stay with it when a rule leaves fewer texts.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Texts:
    """A chunk of texts with measures computed on demand, each at most once."""

    def __init__(self, column: pa.Array) -> None:
        self.column = column
        self.data, self.offsets = buffers(column)
        self._made: dict[str, object] = {}

    def _once(self, name: str, make: Callable):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def take(self, rows: np.ndarray) -> Texts:
        """Some of the texts, with what was measured of them."""
        some = Texts(self.column.take(pa.array(rows)))
        some._made = {k: v[rows] for k, v in self._made.items() if k in MEASURES}
        return some

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and the index of each text's first word (and the total)."""

        def make():
            starts, ends = runs(NOT_SPACE[self.data], self.offsets)
            return starts, ends, np.searchsorted(starts, self.offsets)

        return self._once("words", make)

    @property
    def spans(self) -> Spans:
        return self._once("spans", lambda: Spans(self.data))

    @property
    def n_words(self) -> np.ndarray:
        return self._once("n_words", lambda: np.diff(self.words[2]))

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines (between line feeds) that have a word."""

        def make():
            starts, ends = runs(self.data != 10, self.offsets)  # lines without a character have no word
            words = np.zeros(len(self.data) + 1, np.int64)
            np.cumsum(NOT_SPACE[self.data], out=words[1:])
            used = words[ends] > words[starts]
            return starts[used], ends[used]

        return self._once("lines", make)

    def lines_with(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, how many of its `lines` are marked, and how many there are."""
        edges = np.searchsorted(self.lines[0], self.offsets)
        return per_text(marked, edges), np.diff(edges)

    @property
    def word_chars(self) -> np.ndarray:
        return self._once("word_chars", lambda: per_text(NOT_SPACE[self.data] & ((self.data & 0xC0) != 0x80), self.offsets))

    @property
    def n_symbols(self) -> np.ndarray:
        return self._once("n_symbols", lambda: per_text(_SYMBOL[self.data], self.offsets))

    @property
    def n_dup_lines(self) -> np.ndarray:
        """Lines (between line feeds) with a word that equal an earlier line."""

        def make():
            starts, ends = self.lines
            text = np.searchsorted(self.offsets, starts, "right") - 1
            _, later = repeats(text, self.spans.hash(starts, ends))
            return per_text(later, np.searchsorted(starts, self.offsets))

        return self._once("n_dup_lines", make)

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words within three-word windows that occur twice or more in the text."""

        def make():
            starts, ends, first = self.words
            n = len(starts)
            if n < 3:
                return np.zeros(len(self.column), np.int64)
            h = self.spans.hash(starts, ends)
            text = np.repeat(np.arange(len(self.column)), np.diff(first))
            whole = text[:-2] == text[2:]
            windows = h[:-2] * np.uint64(0xD1342543DE82EF95) + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * np.uint64(0xAF251AF3B0F025B5) + (h[2:] ^ (h[2:] >> np.uint64(32))) * np.uint64(0xB564EF22EC7AECE5)
            often, _ = repeats(text[:-2][whole], windows[whole])
            at = np.flatnonzero(whole)[often]
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[at + k] = True
            return per_text(covered, first)

        return self._once("n_repeat_words", make)


@dataclass(frozen=True)
class Rule:
    """`rejects` maps a chunk of texts to True where the text fails."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _short(t: Texts) -> np.ndarray:
    return t.n_words < 50


def _repetitive(t: Texts) -> np.ndarray:
    return 100 * t.n_repeat_words > 50 * t.n_words


def _symbols(t: Texts) -> np.ndarray:
    return 10 * t.n_symbols > t.n_words


def _word_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)


def _same_lines(t: Texts) -> np.ndarray:
    lines = per_text(t.data == 10, t.offsets) + 1
    return 10 * t.n_dup_lines > 3 * lines


def _few_letters(t: Texts) -> np.ndarray:
    """Of ten words fewer than seven have a letter (ASCII, or any character beyond)."""
    starts, ends, first = t.words
    letters = np.zeros(len(t.data) + 1, np.int32)
    np.cumsum(_LETTER[t.data], out=letters[1:])
    return 10 * per_text(letters[ends] > letters[starts], first) < 7 * t.n_words


def _bullets(t: Texts) -> np.ndarray:
    """Of ten lines with a word more than nine begin with a hyphen or an asterisk."""
    marked, n = t.lines_with(_BULLET[t.data[t.lines[0]]])
    return 10 * marked > 9 * n


def _cut_lines(t: Texts) -> np.ndarray:
    """Of ten lines with a word more than three end with three dots."""
    starts, ends = t.lines
    dots = ends - starts >= 3
    for k in (1, 2, 3):
        dots &= t.data[ends - np.minimum(k, ends - starts)] == 46
    marked, n = t.lines_with(dots)
    return 10 * marked > 3 * n


BASE = (Rule("few words", _short), Rule("repeated windows", _repetitive))
DEFAULT = (*BASE, Rule("symbols", _symbols), Rule("word length", _word_length), Rule("same lines", _same_lines), Rule("few letters", _few_letters), Rule("bullets", _bullets), Rule("cut lines", _cut_lines))


def estimate(column: pa.Array, rules: tuple[Rule, ...], known: bool = False, runs_each: int = 3) -> list[tuple[str, float, int]]:
    """(name, seconds, texts rejected) of each rule on some texts; `known`: MEASURES have been taken before."""
    found = []
    for rule in rules:
        took, bad = [], 0
        for _ in range(runs_each):
            t = Texts(column)
            if known:
                for m in MEASURES:
                    getattr(t, m)
                t = t.take(np.arange(len(column)))
            began = time.perf_counter()
            bad = int(rule.rejects(t).sum())
            took.append(time.perf_counter() - began)
        found.append((rule.name, min(took), bad))
    return found


def plan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT, known: bool = False, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> tuple[Rule, ...]:
    """The rules ordered by rejections per cost, as estimated on about `sample_rows` rows, drawn
    at random from the whole table and measured by SAMPLE_TASKS tasks; the driver gets a row
    a rule from each."""
    share = min(1.0, sample_rows / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, column in chunks(batches, "text", SAMPLE_BYTES):
            rows = estimate(column, rules, known)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["rule", "seconds", "bad"])

    few = docs.select(F.col(text).alias("text")).sample(share, seed).repartition(SAMPLE_TASKS)
    sums = few.mapInArrow(run, "rule string, seconds double, bad long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("bad").alias("n"))
    worth = {r.rule: r.n / max(r.s, 1e-9) for r in sums.collect()}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, 0.0)))


def verdicts(column: pa.Array | Texts, rules: tuple[Rule, ...], left: np.ndarray | None = None) -> np.ndarray:
    """Index of the rule that rejected each text (-1: none, or not among `left`, the rows to
    judge); later rules see only the texts left."""
    texts = column if isinstance(column, Texts) else Texts(column)
    failed = np.full(len(texts.column), -1, np.int64)
    if left is None:
        left = np.arange(len(failed))
    elif len(left) < len(failed):
        texts = texts.take(left)
    for k, rule in enumerate(rules):
        if not len(left):
            break
        bad = rule.rejects(texts)
        if bad.any():
            failed[left[bad]] = k
            left, texts = left[~bad], texts.take(np.flatnonzero(~bad))
    return failed


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of `docs`, all columns, that no rule rejects."""
    ordered = plan(docs, text, rules or DEFAULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, text):
            yield batch.filter(pa.array(verdicts(column, ordered) < 0))

    return docs.mapInArrow(released(run), docs.schema)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Every row's measures and verdict: the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed and kept (boolean).

    The measures and the base rules are wanted for every text.  All other rules run as the
    cascade, on texts that no base rule and no earlier rule has rejected; its order is
    estimated with the measures known."""
    base, rest = [r for r in rules or DEFAULT if r in BASE], tuple(r for r in rules or DEFAULT if r not in BASE)
    ordered = plan(docs, text, rest, known=True) if rest else ()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, text):
            t = Texts(column)
            failed = np.zeros(len(column), bool)
            for rule in base:
                failed |= rule.rejects(t)
            measured = [getattr(t, m).astype(np.int64) for m in MEASURES]
            kept = ~failed & (verdicts(t, ordered, np.flatnonzero(~failed)) < 0)
            out = [batch.column(batch.schema.get_field_index(doc_id))]
            out += [pa.array(x) for x in (*measured, failed, kept)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(doc_id, text).mapInArrow(released(run), schema)
