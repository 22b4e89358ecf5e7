"""A counterfactual-regularised toxicity classifier.

A text's features are its distinct words and word beginnings, lower-cased and hashed.  On a
bounded, stratified sample of labelled texts the features that tell the classes apart best
are chosen, and a sparse logistic model is fitted by proximal gradient steps.  For every
labelled text that mentions an identity term, each term is swapped, wherever it stands in the
text, for another of its set and for a word that names no group, and the squared change of the
whole text's score (on the logit scale) is a penalty of the fit, so that mentioning a group
doesn't carry weight by itself, whatever the labels suggest.

The sample's size is a parameter (POSITIVES and NEGATIVES rows); features are counted on the
executors, and the driver holds the FEATURES chosen and the sample's rows over them.  The
offset is corrected for the share of each class that was sampled.  Scoring takes whole texts.

Rows: null and empty texts have no features and score as the offset alone.  Labels with a
null id or null mark are left out; of repeated labels the highest counts.  Repeated documents
are scored each on their own; for fitting one text of each id counts, the least.  Labels that
are missing or of one class alone give a score of next to nothing (4e-18) to every text.  Very
long texts are read whole; only the named columns are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.llm.common import Spans, buffers, checkpoint, chunks, runs

#: Labelled rows of either class used for fitting, at most, and features chosen.
POSITIVES, NEGATIVES, FEATURES = 3000, 6000, 2000
#: Bytes of a word's beginning that make a feature, for longer words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Documents of the sample that a feature must occur in.
LEAST_DOCS = 3
#: Weights of the counterfactual and the sparsity penalty.
COUNTERFACTUAL, SPARSITY = 1.0, 0.0005

IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "frauen", "männer", "mujeres", "hombres", "femmes", "hommes"),
    ("woman", "man", "girl", "boy", "frau", "mujer", "hombre", "femme", "homme"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and the Latin capitals to U+00DE in lower case."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    if len(data):
        lead = np.flatnonzero(data[:-1] == 0xC3)
        follow = data[lead + 1]
        low[lead[(follow < 0x9F) & (follow >= 0x80) & (follow != 0x97)] + 1] += 32
    return low


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature hash) of all words, then of each kind of beginning."""
    data, offsets = buffers(column)
    low = lowered(data)
    starts, ends = runs(_LETTER[low], offsets)
    if not len(starts):
        return
    text = np.searchsorted(offsets, starts, "right") - 1
    spans = Spans(low)
    yield text, spans.hash(starts, ends)
    for k in BEGINNINGS:
        long = ends - starts > k
        yield text[long], ~spans.hash(starts[long], starts[long] + k)


@dataclass(frozen=True)
class Model:
    """`hashes` ascending, their `weights`, and the offset."""

    hashes: np.ndarray
    weights: np.ndarray
    offset: float

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, index of a chosen feature), each pair once and in order, and how often it occurs."""
        pairs = [np.zeros(0, np.int64)]
        n = max(1, len(self.hashes))
        for text, h in features(column) if len(self.hashes) else ():
            at = np.minimum(np.searchsorted(self.hashes, h), n - 1)
            hit = self.hashes[at] == h
            pairs.append(text[hit] * n + at[hit])
        found, often = np.unique(np.concatenate(pairs), return_counts=True)
        return found // n, found % n, often

    def score(self, column: pa.Array) -> np.ndarray:
        text, feature, _ = self.present(column)
        z = np.bincount(text, self.weights[feature], len(column)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id: str) -> Column:
    """The fold that labels are never learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, mark: str, positives: int, negatives: int) -> tuple[DataFrame, float]:
    """The labelled texts for fitting as (text, y), and the correction of the offset."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(mark).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("labelled")).agg(F.max((F.col(mark) == 1).cast("int")).alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("labelled"), "labelled").limit(most) for y, most in ((1, positives), (0, negatives))]
    few = F.broadcast(drawn[0].union(drawn[1]))  # positives + negatives rows at most
    rows = docs.join(few, F.col(doc_id) == F.col("labelled")).groupBy("labelled").agg(F.min(text).alias("text"), F.first("y").alias("y")).select("text", "y")
    shares = [min(1.0, most / counts[y]) if counts.get(y) else 1.0 for y, most in ((1, positives), (0, negatives))]
    return rows, float(np.log(shares[1]) - np.log(shares[0]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, column in chunks(batches, "text"):
        y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
        found = list(features(column))
        if not found:
            continue
        h, which = np.unique(np.concatenate([h for _, h in found]), return_inverse=True)
        pairs = np.unique(np.concatenate([t for t, _ in found]) * len(h) + which)
        positive = np.bincount(pairs % len(h), y[pairs // len(h)], len(h)).astype(np.int64)
        docs = np.bincount(pairs % len(h), minlength=len(h))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(positive), pa.array(docs)], ["h", "p", "n"])


def choose(rows: DataFrame, most: int = FEATURES) -> np.ndarray:
    """Hashes of the features whose share of positive texts is furthest from that of all, by z value."""
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()[0]
    if not total.n or not total.p or total.p == total.n:
        return np.zeros(0, np.uint64)
    base = total.p / total.n
    seen = rows.mapInArrow(_counts, "h long, p long, n long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    z = (F.col("p") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    best = seen.select("h", F.abs(z).alias("z")).orderBy(F.desc("z"), "h").limit(most).collect()
    return np.sort(np.array([r.h for r in best], np.int64).view(np.uint64))


def fit(row: np.ndarray, column: np.ndarray, y: np.ndarray, k: int, swaps: tuple[np.ndarray, np.ndarray, np.ndarray], counterfactual: float = COUNTERFACTUAL, sparsity: float = SPARSITY, steps: int = 2000, enough: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of `k` features and the offset that minimise the logistic loss over texts with marks
    `y`, where text row[i] has feature column[i]; plus `counterfactual` times the mean squared change
    of the logit over the `swaps`; plus the l1 norm.  A swap makes feature swaps[1][i] come (1)
    or go (-1), as swaps[2][i] says, in swap number swaps[0][i]."""
    n = len(y)
    number, feature, change = swaps
    made = int(number.max()) + 1 if len(number) else 1

    def scores(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, w[column], n) + w[k]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, r[row], k), r.sum()) / n

    def pull(w: np.ndarray) -> np.ndarray:
        moved = np.bincount(number, change * w[feature], made)
        return np.append(2 * counterfactual / made * np.bincount(feature, change * moved[number], k), 0)

    v = np.ones(k + 1)  # the largest curvature, by power iteration
    for _ in range(30):
        v = back(scores(v)) / 4 + pull(v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (1.05 * float(v @ (back(scores(v)) / 4 + pull(v))) + 1e-6)
    w = ahead = np.zeros(k + 1)
    momentum, shrink = 1.0, np.append(np.full(k, rate * sparsity), 0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(scores(ahead), -40, 40)))
        new = ahead - rate * (back(p - y) + pull(ahead))
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        still = np.abs(new - w).max() <= enough * max(1e-3, np.abs(new).max()) * 0.1
        w, momentum = new, after
        if still:
            break
    return w[:-1], float(w[-1])


class Swaps:
    """The swaps of identity terms in texts: each term of a text for the next of its set, and for a
    word that names none (else a term that no label mentions could take on the others' weight)."""

    def __init__(self, model: Model, groups: tuple[tuple[str, ...], ...]) -> None:
        self.model = model
        self.words = [t for g in groups for t in g]
        text, feature, _ = model.present(pa.array(self.words, pa.string()))
        self.own = [feature[text == k] for k in range(len(self.words))]
        edges = np.cumsum([0, *map(len, groups)])
        self.next = [a + (k + 1 - a) % (b - a) for a, b in zip(edges, edges[1:], strict=False) for k in range(a, b)]
        self.term = np.full(len(model.hashes), -1, np.int64)  # of each feature, the term that is that word
        self.term[np.searchsorted(model.hashes, word_hashes(self.words))] = np.arange(len(self.words))

    def of(self, text: np.ndarray, feature: np.ndarray, often: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, features that come or go, 1 or -1) of each swap, from what `Model.present` gives."""
        n = len(self.model.hashes)
        keys = text * n + feature
        for at in np.flatnonzero(self.term[feature] >= 0).tolist():
            t, of, times = int(self.term[feature[at]]), int(text[at]), int(often[at])
            for to in (self.own[self.next[t]], np.zeros(0, np.int64)):
                moved = np.union1d(self.own[t], to)
                k = np.minimum(np.searchsorted(keys, of * n + moved), len(keys) - 1)
                count = np.where(keys[k] == of * n + moved, often[k], 0)
                after = (count - times * np.isin(moved, self.own[t]) > 0) | np.isin(moved, to)
                change = after.astype(np.int64) - (count > 0)
                yield of, moved[change != 0], change[change != 0]


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of single words, as `features` gives them."""
    return np.array([next(features(pa.array([w])))[1][0] for w in words], np.uint64)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES, most: int = FEATURES, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """The model, from labels outside the held-out fold."""
    rows, correction = sample(docs, labels, doc_id, text, mark, positives, negatives)
    rows = checkpoint(rows)
    chosen = choose(rows, most)
    names = word_hashes([t for g in groups for t in g])
    if len(chosen):
        chosen = np.union1d(chosen, names)  # the terms themselves are always features
    model = Model(chosen, np.zeros(len(chosen)), -40.0)
    if not len(chosen):
        return model

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps = Swaps(model, groups)
        for batch, column in chunks(batches, "text"):
            of, feature, often = model.present(column)
            edges = np.searchsorted(of, np.arange(len(column) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(feature.astype(np.int32)))
            own: list[list[dict]] = [[] for _ in range(len(column))]
            for k, moved, change in swaps.of(of, feature, often):
                own[k].append({"f": moved.tolist(), "d": change.tolist()})
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), lists, pa.array(own, kind)], ["y", "f", "swaps"])

    kind = pa.list_(pa.struct([("f", pa.list_(pa.int32())), ("d", pa.list_(pa.int32()))]))
    # A row for each sampled label: positives + negatives at most.
    got = rows.mapInArrow(over, "y int, f array<int>, swaps array<struct<f:array<int>,d:array<int>>>").toArrow()
    y = got["y"].to_numpy().astype(float)
    lists = got["f"].combine_chunks()
    column = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    made = got["swaps"].combine_chunks().flatten()
    changed = made.field("f")
    number = np.repeat(np.arange(len(made)), changed.value_lengths().to_numpy().astype(np.int64))
    swaps = (number, changed.flatten().to_numpy().astype(np.int64), made.field("d").flatten().to_numpy().astype(float))
    w, b = fit(row, column, y, len(chosen), swaps, counterfactual)
    return Model(chosen, w, b + correction)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, "text"):
            p = model.score(column)
            names = ("doc_id", "held_out")
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
