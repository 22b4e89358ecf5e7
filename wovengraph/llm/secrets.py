"""Secret scanning: pattern rules plus a character convolutional network.

The rules give the base findings, which always stay.  Every run of SHORTEST or more token
characters is a candidate, whatever it looks like and also where it overlaps a base finding;
the network reads it whole (long ones in pieces) with its surrounding context, and those whose
calibrated probability reaches a threshold are added, unless one base finding covers them.
The threshold is the most precise one that keeps a required recall.  The labelled findings are
generated from a fixed seed: credentials of many formats and look-alikes (words of letters,
numbers, links, identifiers) in prose, key-value lines and code; three fifths train the
network, one fifth calibrates it and one fifth sets the threshold.  Training takes seconds on
the driver and depends on nothing in the corpus; the weights (some 30 kB) travel in the closure.

Rows: null text is empty and has no findings.  Texts of any length are scanned whole, in time
linear in their length but for sorting.  Repeated rows are judged each on their own.  Only the
named columns are read."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wovengraph.llm.common import buffers, chunks, released, runs

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_HINTS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


def _class(chars: str) -> np.ndarray:
    member = np.zeros(256, bool)
    member[list(chars.encode())] = True
    return member


_HEX = _class("0123456789abcdef")
_TOKEN = _class(string.ascii_letters + string.digits + "+/_=-")

#: Shortest candidate; bytes of context before and after; bytes of a candidate that one window holds.
SHORTEST, BEFORE, AFTER, PIECE = 12, 24, 12, 64
_WIDTH = BEFORE + PIECE + AFTER
#: Labelled findings generated, and formats of credentials among them.
FINDINGS, FORMATS = 9000, 11
#: Share of labelled secrets that the threshold must keep.
RECALL = 0.98
REDACTED = "[REDACTED]"

# Character codes: letters and digits by themselves, the rest by kind; then one set per role.
_CODE = np.full(256, 1, np.int16)
for _k, _c in enumerate(string.ascii_letters + string.digits + "+/_=-.:'\"@#%&?"):
    _CODE[ord(_c)] = 4 + _k
for _c in " \t\n\r\x0b\x0c":
    _CODE[ord(_c)] = 2
_CODE[128:] = 3
_CODES = int(_CODE.max()) + 1


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded windows over the candidates [start, end) within the texts [low, high), and the
    candidate of each: every PIECE bytes of a candidate make a window."""
    pieces = np.maximum(1, -(-(ends - starts) // PIECE))
    of = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = starts[of] + nth * PIECE
    last = np.minimum(first + PIECE, ends[of])
    at = first[:, None] - BEFORE + np.arange(BEFORE + PIECE)[None, :]
    after = last[:, None] + np.arange(AFTER)[None, :]
    at = np.concatenate([at, after], axis=1)
    role = np.repeat(np.array([0, 1, 2]), [BEFORE, PIECE, AFTER])[None, :]
    there = (at >= lows[of][:, None]) & (at < highs[of][:, None]) & ((role != 1) | (at < last[:, None]))
    codes = _CODE[data[np.clip(at, 0, max(0, len(data) - 1))]] + role * _CODES
    return np.where(there, codes, 0).astype(np.int64), of


@dataclass
class Network:
    """Embedding, one convolution, max and mean pooling, one dense unit, then calibration."""

    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    SPAN = 5

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.table[codes]
        n, width, dim = x.shape
        steps = width - self.SPAN + 1
        unfolded = np.lib.stride_tricks.sliding_window_view(x, self.SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n, steps, self.SPAN * dim)
        made = np.maximum(unfolded @ self.filters + self.bias, 0)
        best = made.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(made, best[:, None], 1)[:, 0], made.mean(axis=1)], axis=1)
        return pooled @ self.dense + self.offset, (unfolded, made, best, pooled)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        out = [self.forward(codes[i : i + 256])[0] for i in range(0, len(codes), 256)]
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def _adam(params: list[np.ndarray], grads: list[np.ndarray], state: list, step: int, rate: float) -> None:
    for k, (p, g) in enumerate(zip(params, grads, strict=True)):
        m, v = state[k]
        m *= 0.9
        m += 0.1 * g
        v *= 0.99
        v += 0.01 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def fit(codes: np.ndarray, labels: np.ndarray, seed: int = 11, steps: int = 900, batch: int = 96, dim: int = 8, filters: int = 24, recall: float = RECALL) -> Network:
    """Train on three fifths of the labelled windows, calibrate on one fifth and choose the threshold on the last."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    fifth = len(order) // 5
    held, last, used = order[:fifth], order[fifth : 2 * fifth], order[2 * fifth :]
    net = Network(rng.normal(0, 0.3, (3 * _CODES, dim)), rng.normal(0, 0.15, (Network.SPAN * dim, filters)), np.zeros(filters), rng.normal(0, 0.1, 2 * filters))
    offset = np.zeros(1)
    params = [net.table, net.filters, net.bias, net.dense, offset]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        rows = used[rng.integers(0, len(used), batch)]
        z, (unfolded, made, best, pooled) = net.forward(codes[rows])
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / batch
        dpool = dz[:, None] * net.dense[None, :]
        dmade = np.repeat(dpool[:, None, filters:] / made.shape[1], made.shape[1], axis=1)
        np.put_along_axis(dmade, best[:, None], np.take_along_axis(dmade, best[:, None], 1) + dpool[:, None, :filters], 1)
        dmade *= made > 0
        flat = dmade.reshape(-1, filters)
        dunfold = (flat @ net.filters.T).reshape(batch, made.shape[1], Network.SPAN, dim)
        dx = np.zeros((batch, codes.shape[1], dim))
        for k in range(Network.SPAN):
            dx[:, k : k + made.shape[1]] += dunfold[:, :, k]
        dtable = np.zeros_like(net.table)
        np.add.at(dtable, codes[rows].ravel(), dx.reshape(-1, dim))
        grads = [dtable, unfolded.reshape(-1, unfolded.shape[2]).T @ flat, flat.sum(0), pooled.T @ dz, np.array([dz.sum()])]
        _adam(params, grads, state, step, 0.01)
        net.offset = float(offset[0])
    # Platt scaling on findings held out for it.
    z, y = np.concatenate([net.forward(codes[held[i : i + 256]])[0] for i in range(0, len(held), 256)]), labels[held]
    a, b = 1.0, 0.0
    for _ in range(300):
        e = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y
        a, b = a - 0.05 * (e * z).mean(), b - 0.05 * e.mean()
    net.scale, net.shift = float(a), float(b)
    p, y = net.probability(codes[last]), labels[last]
    # Recall falls as the threshold rises, so the most precise ones lie at the top of those allowed.
    allowed = np.sort(p[y == 1])[: max(1, int((1 - recall) * (y == 1).sum()) + 1)]
    precision = [(y[p >= t].mean(), t) for t in allowed]
    net.threshold = float(max(precision)[1])
    return net


def labelled_findings(n: int = FINDINGS, seed: int = 23, formats: tuple[int, ...] | None = None) -> tuple[list[str], list[int], list[int], list[int]]:
    """(texts, starts, ends, labels): credentials (of some FORMATS only, if named) and look-alikes
    in generated surroundings."""
    rng = random.Random(seed)
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ung", "keit", "schaft", "tion", "ment"]
    word = lambda k: "".join(rng.choices(syllables, k=k))
    # Words of no language: consonants by ones to sixes between vowels.
    made = lambda k: "".join(pick("bcdfghjklmnpqrstvwxyz", rng.choice([0, 1, 1, 1, 2, 2, 3, 4, 6])) + pick("aeiou", rng.choice([1, 1, 1, 2, 3])) for _ in range(k)) + pick("nrtshzf", rng.randint(0, 3))
    long = lambda: rng.choice([word(rng.randint(4, 9)), made(rng.randint(4, 9)), word(rng.randint(2, 4)) + made(rng.randint(2, 4))])
    secrets = [
        lambda: pick(alnum, rng.randint(20, 64)),
        lambda: pick(b64, rng.randint(24, 88)) + rng.choice(["", "=", "=="]),
        lambda: pick("0123456789abcdef", rng.randint(20, 31)),
        lambda: pick("0123456789ABCDEF", rng.choice([32, 40, 64])),
        lambda: rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "rk_test_", "npm_"]) + pick(alnum, rng.randint(20, 44)),
        lambda: f"eyJ{pick(alnum, rng.randint(20, 60))}",
        lambda: f"{pick(string.ascii_uppercase + string.digits, 4)}-{pick(string.ascii_uppercase + string.digits, 8)}-{pick(string.ascii_uppercase + string.digits, 8)}",
        lambda: pick(alnum + "_-", rng.randint(24, 43)),
        lambda: pick(alnum, rng.randint(12, 19)),
        lambda: pick(string.ascii_lowercase + string.digits, rng.randint(20, 40)),
        lambda: pick(string.ascii_uppercase + "234567", rng.randint(16, 52)),
    ]
    assert len(secrets) == FORMATS
    secrets = [secrets[k] for k in formats or range(FORMATS)]
    plain = [
        lambda: pick(string.digits, rng.randint(12, 24)),
        lambda: pick(string.digits, 16),
        long,
        long,
        lambda: long().upper(),
        lambda: long().capitalize(),
        lambda: "-".join(pick(string.digits, rng.choice([3, 4, 5])) for _ in range(rng.randint(4, 6))),
        lambda: "_".join(word(2) for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 99)),
        lambda: "-".join(word(2) for _ in range(rng.randint(3, 7))) + f"-{rng.randint(1, 2030)}",
        lambda: "/".join(word(rng.randint(1, 3)) for _ in range(rng.randint(3, 7))) + f"/{rng.randint(0, 9999)}",
        lambda: "".join(word(2).capitalize() for _ in range(rng.randint(3, 6))) + rng.choice(["", str(rng.randint(1, 99))]),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-00",
        lambda: rng.choice("=-_/+") * rng.randint(16, 60) + pick(string.digits, 2),
        lambda: word(rng.randint(6, 12)) + str(rng.randint(10, 99999)),
        lambda: f"www/{word(3)}/com/{word(2)}/{rng.randint(1, 20000)}",
    ]
    prose = lambda: " ".join(word(rng.randint(1, 3)) for _ in range(rng.randint(3, 9)))
    around = [
        lambda t: f"{prose()} {t} {prose()}",
        lambda t: f"{prose()}, {t}. {prose()}",
        lambda t: f'{word(2)} = "{t}";\n{prose()}',
        lambda t: f"{prose()}\n{word(1).upper()}_{word(1).upper()}={t}\n{prose()}",
        lambda t: f"https://{word(2)}.example.com/{t}?{word(1)}=1",
        lambda t: f"{{'{word(1)}': '{t}'}}",
        lambda t: t,
        lambda t: f"{prose()}{pick('*&%$#', rng.randint(1, 3))} {t}{pick('*&%$#', rng.randint(1, 3))} {made(2)}",
        lambda t: f"{made(2)}\u00fc {t} \u00e9{made(1)}",
    ]
    texts, starts, ends, labels = [], [], [], []
    while len(texts) < n:
        label = rng.random() < 0.5
        token = rng.choice(secrets if label else plain)()
        text = rng.choice(around)(token)
        at = text.find(token)
        if len(token) >= SHORTEST and at >= 0:
            texts.append(text)
            starts.append(at)
            ends.append(at + len(token))
            labels.append(int(label))
    return texts, starts, ends, labels


def coded(texts: list[str], starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    sizes = np.array([len(t) for t in raw])
    before = np.array([len(t[:a].encode()) - a for t, a in zip(texts, starts, strict=True)])  # tokens are ASCII
    lows = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(raw), np.uint8)
    return windows(data, lows + np.array(starts) + before, lows + np.array(ends) + before, lows, lows + sizes)


@functools.cache
def trained(n: int = FINDINGS, seed: int = 23) -> Network:
    """The network fitted to the generated findings; made once a process."""
    texts, starts, ends, labels = labelled_findings(n, seed)
    codes, of = coded(texts, starts, ends)
    return fit(codes, np.array(labels, float)[of])


Finding = tuple[int, int, int]  # start, end (bytes), index in KINDS


def base_findings(text: bytes, hexes: list[tuple[int, int]]) -> list[tuple[Finding, int]]:
    """The rules' findings, each with the start of the secret itself."""
    found = [((a, b, 2), a) for a, b in hexes]
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [((m.start(), m.end(), 0), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        found += [((m.start(), m.end(), 1), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def findings(column: pa.Array, net: Network) -> list[list[tuple[Finding, int]]]:
    """All findings of each text of a chunk, by start and kind, with the start of the secret."""
    data, offsets = buffers(column)
    texts = column.cast(pa.binary()).to_pylist()
    starts, ends = runs(_HEX[data], offsets)
    long = ends - starts >= 32
    starts, ends = starts[long], ends[long]
    edge = np.searchsorted(starts, offsets)
    base = [base_findings(t, [(int(a - offsets[i]), int(b - offsets[i])) for a, b in zip(starts[edge[i] : edge[i + 1]], ends[edge[i] : edge[i + 1]], strict=True)]) for i, t in enumerate(texts)]
    starts, ends = runs(_TOKEN[data], offsets)
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    if len(starts):
        text = np.searchsorted(offsets, starts, "right") - 1
        # How far the base findings that begin no later reach, over the whole chunk.
        own = [(a + offsets[i], b + offsets[i]) for i, f in enumerate(base) for (a, b, _), _ in f]
        own = np.array(own, np.int64).reshape(-1, 2)
        own = own[np.argsort(own[:, 0], kind="stable")]
        reach = np.concatenate([[0], np.maximum.accumulate(own[:, 1])]) if len(own) else np.zeros(1, np.int64)
        free = reach[np.searchsorted(own[:, 0], starts, "right")] < ends
        starts, ends, text = starts[free], ends[free], text[free]
        for at in range(0, len(starts), 1024):
            s, e, t = starts[at : at + 1024], ends[at : at + 1024], text[at : at + 1024]
            codes, of = windows(data, s, e, offsets[t], offsets[t + 1])
            p = np.zeros(len(s))
            np.maximum.at(p, of, net.probability(codes))
            for k in np.flatnonzero(p >= net.threshold):
                a, b = int(s[k] - offsets[t[k]]), int(e[k] - offsets[t[k]])
                base[t[k]].append(((a, b, 3), a))
    return [sorted(f, key=lambda x: (x[0][0], x[0][2])) for f in base]


def _points(text: bytes) -> np.ndarray | None:
    """Code points before each byte, or None where these are the bytes themselves."""
    if text.isascii():
        return None
    before = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return before


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", net: Network | None = None) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, n_model (long), base_sha256
    and spans (kind:start:end by start, then kind; code points, end exclusive)."""
    net = net or trained()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, text):
            found, counts, digests, told = findings(column, net), [[], [], [], []], [], []
            for t, own in zip(column.cast(pa.binary()), found, strict=True):
                at = _points(t.as_py()) if own else None
                said = [(k, f"{KINDS[k]}:{a if at is None else at[a]}:{b if at is None else at[b]}") for (a, b, k), _ in own]
                for k in range(4):
                    counts[k].append(sum(x == k for x, _ in said))
                digests.append(hashlib.sha256(",".join(s for k, s in said if k < 3).encode()).hexdigest())
                told.append(",".join(s for _, s in said))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(doc_id)), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(told, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"],
            )

    return docs.select(doc_id, text).mapInArrow(released(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")


def _redacted(text: bytes, found: list[tuple[Finding, int]]) -> str:
    out, at = [], 0
    for secret, end in sorted((s, b) for (_, b, _), s in found):
        if end <= at:
            continue
        if secret >= at:
            out += [text[at:secret].decode(), REDACTED]
        at = end
    return "".join(out) + text[at:].decode()


def redact(docs: DataFrame, text: str = "text", net: Network | None = None) -> DataFrame:
    """The documents, all rows and columns, with every secret found replaced by REDACTED."""
    net = net or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, text):
            found = findings(column, net)
            if any(found):
                k = batch.schema.get_field_index(text)
                nulls = batch.column(k).is_null().to_pylist()
                new = [None if no else (_redacted(t.as_py(), f) if f else t.as_py().decode()) for t, f, no in zip(column.cast(pa.binary()), found, nulls, strict=True)]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(released(run), docs.schema)
