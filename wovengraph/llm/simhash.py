"""Near-duplicates by SimHash, found with Golay-code fuzzy hashing.

Texts become 64-bit fingerprints, cut into three segments of 22, 21 and 21 bits, each a
shortened 23-bit word that a Golay code decodes to a codeword index.

`near_duplicates` links fingerprints at three or fewer differing bits.  Three errors over
three segments leave two segments with at most one error each, so for one of the three pairs
of segments both halves agree up to one bit.  A fingerprint is filed under its own pair of
codeword indices and asks under its neighbours' pairs too (36 at most, and only those not
below its own, as the other side asks for the rest).  Only distinct fingerprints take part,
so groups of copies cost one row.  A file (one pair of indices) with more than HOT
fingerprints isn't joined pair by pair: its members meet in blocks, and each two blocks give
a spanning forest of their links, which keeps the components and stays linear in the block.

`deduplicate` links texts whose word shingles are similar (Jaccard at SIMILARITY or more).
Edits of that many shingles differ in too many bits of a shingle fingerprint to be found by
a few keys, so the candidates come from fingerprints of the distinct words, which an edit
hardly changes.  There both sides are filed under all their neighbours' pairs, so words at
two differing bits still share a key: any two fingerprints at five or fewer bits meet, and
most up to WORD_DISTANCE.  Fingerprints that meet form coarse groups; within a coarse group
(in blocks, if it is large) every two texts are compared by the shingles themselves, and
only verified links count.

The keys only come first, as they put large families of copies together cheaply.  What they
miss is found by an exact prefix filter: of two texts of that similarity, each has a shingle
in common with the other among the first fifth (`prefix`) of its own shingles in any order
that is the same for all texts.  Here that is by hash, with shingles that a sample shows to be
common last.  Texts of one coarse group have been compared and needn't meet again; of the
others, pairs are dropped whose parities (bits of all shingles, `parities`) tell that they lack
too much of each other, then those whose prefixes share fewer shingles than the similarity
implies, and the rest are compared by all their shingle hashes (32 bits each, of texts of any length).

Equal texts are brought together first, on the map side where they can be, so all that comes
after has a row a distinct text; the texts themselves are read once for that and hashed once.

Rows: null and empty texts have fingerprint zero and link like any other (without words
they are alike); null ids take part and are passed over as component ids unless no other id
is there.  Repeated rows each get a row.  Texts of any length are taken whole; an empty table
gives an empty result."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wovengraph.llm.common import NOT_SPACE, Spans, buffers, checkpoint, chunks, released, remove, runs, shared_dir
from wovengraph.llm.components import components
from wovengraph.llm.golay import decoder, keys
from wovengraph.llm.substrings import window_hashes

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DISTANCE = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
HOT = 256
BLOCK = 512
#: Of `deduplicate`: the similarity that counts, bits that word fingerprints may differ in, texts of a block and bytes of their shingle hashes.
SIMILARITY, WORD_DISTANCE, TEXTS, BYTES = 0.8, 8, 1024, 4 << 20
#: For common shingles: of how many texts one is sampled (and texts sampled at least), texts of the
#: sample that make one common, most common ones kept; they only change the cost.
SHARE, SAMPLE, COMMON, KEPT = 20, 5000, 3, 500_000
#: Bits of a text's parities.
BITS = 512
#: Text bytes and pairs that one step holds at once.
PIECE, PAIRED = 1 << 19, 1 << 17


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of a UTF-8 text: bit by bit the majority over the XXH64
    (seed 42) of its word shingles, repeats included; zero for a text without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(stops), 65536):  # bounded memory for a text of any length
        h = np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=False)), np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(stops)).view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row, fp as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, text):
            fp = np.array([fingerprint(t, shingle) for t in column.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    text = "text"
    return picked.mapInArrow(run, f"doc_id {kind}, fp long")


def _pieces(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int32) for at, width in SEGMENTS]


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp): under which key of each pair of segments a fingerprint is filed."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = [decoder()[p].astype(np.int64) for p in _pieces(fp)]
        for pair, (x, y) in enumerate(PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array((pair << 24) | (own[x] << 12) | own[y]), pa.array(fp)], ["key", "fp"])


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp): under which keys each fingerprint asks, its own included."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            fp = whole.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
            found = [keys(p, width) for p, (_, width) in zip(_pieces(fp), SEGMENTS, strict=True)]
            for pair, (x, y) in enumerate(PAIRS):
                a, b = found[x].astype(np.int64), found[y].astype(np.int64)
                both = (a[:, :, None] << 12) | b[:, None, :]
                wanted = (a[:, :, None] >= 0) & (b[:, None, :] >= 0) & (both >= both[:, :1, :1])
                rows, i, j = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array((pair << 24) | both[rows, i, j]), pa.array(fp[rows])], ["key", "fp"])


def forest(nodes: np.ndarray, distance: int = DISTANCE) -> tuple[list[int], list[int]]:
    """Links that join what any two members at `distance` or less join, one fewer than members at most."""
    nodes = np.sort(nodes)  # lesser ones first, so that forests of overlapping groups share links
    bits, free, a, b = nodes.view(np.uint64), np.ones(len(nodes), bool), [], []
    for seed in range(len(nodes)):
        if not free[seed]:
            continue
        free[seed], todo = False, deque([seed])
        while todo:
            k = todo.popleft()
            rest = np.flatnonzero(free)
            near = rest[np.bitwise_count(bits[rest] ^ bits[k]) <= distance]
            free[near] = False
            a += [int(nodes[k])] * len(near)
            b += nodes[near].tolist()
            todo += near.tolist()
    return a, b


def _met(hot: DataFrame, distance: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each key of `hot` (key, fp), whose members
    are dealt into blocks; every two blocks of a key meet once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                x, y = forest(members.values.to_numpy(zero_copy_only=False).astype(np.int64), distance)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    member = hot.join(blocks, "key").withColumn("x", F.pmod(F.xxhash64("fp"), "n"))
    meets = member.withColumn("y", F.explode(F.expr("sequence(0, n - 1)"))).select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "fp")
    return meets.groupBy("key", "i", "j").agg(F.collect_set("fp").alias("members")).select("members").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links among the distinct fingerprints in column `fp` that connect exactly
    those that links at DISTANCE or fewer bits connect.

    Spark takes what the key functions return to have as many rows as their input, but some 46
    asks come of a fingerprint, so it would broadcast them: all joins with them are merge joins."""
    filed = distinct.select("fp").mapInArrow(_filed, "key long, fp long").hint("merge")
    asks = distinct.select("fp").mapInArrow(_asks, "key long, fp long").hint("merge")
    sizes = filed.groupBy("key").agg(F.count("*").alias("n"))
    cold = filed.join(sizes.where(F.col("n") <= HOT), "key").select(F.col("key").alias("k"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = asks.join(cold, (F.col("k") == F.col("key")) & (F.col("fp") != F.col("b")) & near).select(F.col("fp").alias("a"), "b")
    hot = asks.join(sizes.where(F.col("n") > HOT).select("key"), "key")
    return pairs.union(_met(hot.hint("merge"), DISTANCE)).distinct()


def grouped(fps: DataFrame) -> DataFrame:
    """`fps` (with doc_id and fp, read more than once) with component_id, the least id reachable."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(least.select("fp")))
    roots = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    fps = checkpoint(fingerprints(docs, doc_id, text, shingle))
    return grouped(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class Words:
    """The words of a chunk of texts, A-Z lower-cased, as hashes."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = buffers(column)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        starts, ends = runs(NOT_SPACE[low], offsets)
        self.first = np.searchsorted(starts, offsets)
        self.n = np.diff(self.first)
        self.hash = Spans(low).hash(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.text = np.repeat(np.arange(len(column)), self.n)


def word_fingerprints(words: Words) -> np.ndarray:
    """A fingerprint of each text's distinct words, as a signed long."""
    text, h = _distinct(words.text, words.hash)
    total = np.zeros((len(words.n), 64), np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for a text of any length
        own, begin = np.unique(text[at : at + 65536], return_index=True)
        bits = np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total[own] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    over = 2 * total > np.bincount(text, minlength=len(words.n))[:, None]
    return np.packbits(over, axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)


def shingle_hashes(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all word shingles, repeats included.  A text of fewer words is one
    shingle, and one without words has none."""
    h, text = words.hash, words.text
    whole = window_hashes(h, shingle)
    inside = text[: len(whole)] == text[len(h) - len(whole) :]
    values, of = [whole[inside]], [text[: len(whole)][inside]]
    for k in range(1, shingle):
        short = np.flatnonzero(words.n == k)
        if len(short):
            values.append(window_hashes(h, k)[words.first[short]])
            of.append(short)
    return np.concatenate(of), np.concatenate(values)


def sketches(words: Words, shingle: int) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Each text's distinct hashes of word shingles, ascending, as little-endian 32-bit numbers,
    how many these are, and their parities."""
    n = len(words.n)
    of, values = shingle_hashes(words, shingle)
    of, values = _distinct(of, values >> np.uint64(32))
    ends = 4 * np.searchsorted(of, np.arange(n + 1))
    made = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.astype("<u4").tobytes())])
    return made, np.diff(ends) // 4, parities(of, values, n)


def parities(of: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Of each of `n` texts BITS bits: whether an odd number of its distinct shingles fall on each.
    Two texts' bits differ in no more places than there are shingles that only one of them has."""
    odd = np.bincount(of * BITS + (values % np.uint64(BITS)).astype(np.int64), minlength=n * BITS).reshape(n, BITS) & 1
    packed = np.packbits(odd.astype(np.uint8), axis=1)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * (BITS // 8)).tobytes()), pa.py_buffer(packed.tobytes())])


def _distinct(text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs in order."""
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    return text[new], values[new]


def described(docs: DataFrame, common: np.ndarray, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """A row a distinct text: th (its hash), id (the least, as (is it null, the id)), fp (of its
    distinct words), n (distinct shingles), sketch (their hashes), odd (their parities), prefix
    (keys, see `prefix`)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    id_kind = f"struct<none:boolean,id:{kind}>"
    own = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))
    texts = docs.groupBy(F.xxhash64(text).alias("th")).agg(F.min(own).alias("id"), F.first(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in chunks(batches, "text", PIECE):
            words = Words(column)
            of, key, _ = prefix(words, shingle, common)
            edges = np.searchsorted(of, np.arange(len(column) + 1)).astype(np.int32)
            sketch, n, odd = sketches(words, shingle)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(key))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(word_fingerprints(words)), pa.array(n), sketch, odd, lists], ["th", "id", "fp", "n", "sketch", "odd", "prefix"])

    return texts.mapInArrow(released(run), f"th long, id {id_kind}, fp long, n long, sketch binary, odd binary, prefix array<bigint>")


def _all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp): all pairs of keys of each fingerprint's segments and their neighbours."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            fp = whole.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
            found = [keys(p, width).astype(np.int64) for p, (_, width) in zip(_pieces(fp), SEGMENTS, strict=True)]
            for pair, (x, y) in enumerate(PAIRS):
                a, b = found[x][:, :, None], found[y][:, None, :]
                both = (a << 12) | b
                rows, i, j = np.nonzero((a >= 0) & (b >= 0))
                yield pa.RecordBatch.from_arrays([pa.array((pair << 24) | both[rows, i, j]), pa.array(fp[rows])], ["key", "fp"])


def _by_key(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, fp) sorted by key become a forest (a, b) of each key's links; members of a
    key of more than HOT come back as (a, null, key) instead.  HOT rows are held at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, hot = None, np.zeros(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            a, b, out_key = [], [], []
            size = np.diff(np.append(begin, len(key)))
            # A key alone in the middle of a batch has no links.
            busy = np.flatnonzero((size > 1) | (np.arange(len(begin)) == 0) | (np.arange(len(begin)) == len(begin) - 1))
            for g in busy.tolist():
                members, own = fp[begin[g] : begin[g] + size[g]], int(key[begin[g]])
                if own != held_key:
                    x, y = forest(held, distance) if len(held) > 1 and not hot else ([], [])
                    a += x
                    b += y
                    out_key += [None] * len(x)
                    held_key, held, hot = own, members, False
                else:
                    held = np.concatenate([held, members])
                if hot or len(held) > HOT:
                    a += held.tolist()
                    b += [None] * len(held)
                    out_key += [own] * len(held)
                    held, hot = np.zeros(0, np.int64), True
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, out_key)], ["a", "b", "key"])
        if len(held) > 1 and not hot:
            x, y = forest(held, distance)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.nulls(len(x), pa.int64())], ["a", "b", "key"])

    return run


def coarse_links(distinct: DataFrame, distance: int = WORD_DISTANCE) -> DataFrame:
    """(a, b): links among the distinct fingerprints in column `fp` that connect those that share
    a key and differ in `distance` bits at most (which takes in all at five bits or fewer)."""
    filed = distinct.select("fp").mapInArrow(_all_keys, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = checkpoint(filed.mapInArrow(released(_by_key(distance)), "a long, b long, key long").distinct())
    hot = found.where("key is not null").select("key", F.col("a").alias("fp"))
    return found.where("key is null").select("a", "b").union(_met(hot, distance))


def similar_forest(sketches: list[bytes], similarity: float = SIMILARITY) -> tuple[list[int], list[int]]:
    """Links (indices) that join what any two texts of that similarity join, one fewer than texts
    at most."""
    size = np.array([len(s) // 4 for s in sketches], np.int64)
    flat = np.frombuffer(b"".join(sketches), "<u4")
    edges = np.concatenate([[0], np.cumsum(size)])
    shared, which = np.unique(flat, return_inverse=True)
    mark, there = np.zeros(len(shared), bool), np.zeros(len(flat) + 1, np.int32)
    free, a, b = np.ones(len(size), bool), [], []
    for seed in range(len(size)):
        if not free[seed]:
            continue
        free[seed], todo = False, [seed]
        while todo:
            k = todo.pop()
            rest = np.flatnonzero(free)
            if not len(rest):
                break
            mine = which[edges[k] : edges[k + 1]]
            mark[mine] = True
            np.cumsum(mark[which], out=there[1:])
            mark[mine] = False
            both = (there[edges[rest + 1]] - there[edges[rest]]).astype(np.int64)
            near = rest[both >= similarity * (size[rest] + size[k] - both)]
            free[near] = False
            a += [k] * len(near)
            b += near.tolist()
            todo += near.tolist()
    return a, b


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for members in batch.column(0):
            # In a fixed order, so that a task run again gives the same links.
            own = members.values.take(pc.sort_indices(members.values.field("th")))
            text, sketches = own.field("th").to_pylist(), own.field("sketch").to_pylist()
            x, y = similar_forest(sketches)
            a += [text[i] for i in x]
            b += [text[i] for i in y]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def coarse_groups(texts: DataFrame) -> DataFrame:
    """(fp, root, several): the coarse group of each word fingerprint, and whether it is one of
    several fingerprints or texts."""
    fps = checkpoint(texts.groupBy("fp").agg((F.min("th") != F.max("th")).alias("several")))
    found = components(coarse_links(fps)).withColumnRenamed("node", "fp")
    return checkpoint(fps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), (F.col("several") | F.col("root").isNotNull()).alias("several")))


def similar_texts(member: DataFrame) -> DataFrame:
    """(a, b): links among the texts of `member` (root, th, sketch) that connect those that share a
    coarse group and are similar."""
    blocks = member.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / TEXTS, F.sum(F.length("sketch")) / BYTES, F.lit(1.0))).cast("int").alias("n"))
    dealt = member.join(blocks, "root").withColumn("x", F.pmod("th", "n"))
    meets = dealt.withColumn("y", F.explode(F.expr("sequence(0, n - 1)"))).select("root", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "th", "sketch")
    meeting = meets.groupBy("root", "i", "j").agg(F.collect_list(F.struct("th", "sketch")).alias("members"))
    return meeting.select("members").mapInArrow(released(_verified), "a long, b long")


def _least(n, similarity: float):
    """The shingles that a text of `n` shares at least with any that is similar."""
    return np.ceil(similarity * n - 1e-6).astype(np.int64)


def prefix(words: Words, shingle: int, common: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, size) of the shingles that texts meet under: the first of each text's in an
    order with those in `common` (sorted keys) last; size is the number of its shingles."""
    of, key = shingle_hashes(words, shingle)
    key = key >> np.uint64(1)
    if len(common):
        known = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key
        key |= known.astype(np.uint64) << np.uint64(63)
    of, key = _distinct(of, key)
    edges = np.searchsorted(of, np.arange(len(words.n) + 1))
    size = np.diff(edges)
    first = np.arange(len(of)) - edges[of] <= (size - _least(size, similarity))[of]
    return of[first], key[first].view(np.int64), size[of[first]]


def common_shingles(docs: DataFrame, text: str = "text", shingle: int = 5) -> np.ndarray:
    """Keys of shingles, sorted, that several of a sample of the texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, column in chunks(batches, "text", PIECE):
            of, key = shingle_hashes(Words(column), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(_distinct(of, key >> np.uint64(1))[1].view(np.int64))], ["key"])

    share = max(1, min(SHARE, docs.count() // SAMPLE))
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(share)) == 0).select(F.col(text).alias("text")).distinct()
    often = some.mapInArrow(released(run), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(often.orderBy(F.desc("n"), "key").limit(KEPT).select("key").toArrow()["key"].to_numpy()).view(np.uint64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, th) sorted by key and th, each once, those whose key several texts have."""
    last, told = [np.zeros(0, np.int64)] * 2, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, th = (np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, x in enumerate(last))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (th[1:] != th[:-1])
        key, th = key[new], th[new]
        kept = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        kept[1:] |= same
        kept[:-1] |= same
        kept[0] |= told
        last, told = [key[-1:], th[-1:]], bool(kept[-1])
        kept[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (key, th)], ["key", "th"])
    if told:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], ["key", "th"])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb): the pairs of members of each row (i, j, members) that are of different
    groups, of sizes and parities that allow the similarity and, if i and j differ, of different
    blocks."""
    for batch in batches:
        members = batch.column(2)
        flat, offsets = members.flatten(), members.offsets.to_numpy().astype(np.int64)
        th, n, root, x = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("th", "n", "root", "x"))
        many = np.diff(offsets)
        end, inner = np.repeat(offsets[1:] - offsets[0], many), np.repeat(np.equal(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))), many)
        odd = np.frombuffer(b"".join(flat.field("odd").to_pylist()), np.uint64).reshape(len(th), BITS // 64)
        after = np.cumsum(end - np.arange(len(th)) - 1)
        at = 0
        while at < len(th):
            to = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + PAIRED, "right")))
            count = end[at:to] - np.arange(at, to) - 1
            p = np.repeat(np.arange(at, to), count)
            q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
            fit = (root[p] != root[q]) & (inner[p] | (x[p] != x[q])) & (np.minimum(n[p], n[q]) >= SIMILARITY * np.maximum(n[p], n[q]) - 1e-6)
            p, q = p[fit], q[fit]
            # What each has alone is at least the bits that differ, and at most this of similar texts.
            alone = n[p] + n[q] - 2 * np.ceil((n[p] + n[q]) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
            fit = np.bitwise_count(odd[p] ^ odd[q]).sum(1, dtype=np.int64) <= alone
            p, q = p[fit], q[fit]
            swap = th[p] > th[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (th[p], th[q], n[p], n[q])], ["a", "b", "na", "nb"])
            at = to


def candidates(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): pairs of texts (th), among them all that are similar and of different coarse groups."""
    filed = texts.select(F.explode("prefix").alias("key"), "th").repartition("key").sortWithinPartitions("key", "th")
    shared = checkpoint(filed.mapInArrow(released(_shared), "key long, th long"))
    roots = texts.select("th", "fp", "n", "odd").join(groups.select("fp", "root"), "fp").select("th", "root", "n", "odd")
    known = shared.join(roots, "th")
    mixed = known.groupBy("key").agg(F.ceil(F.count("*") / TEXTS).cast("int").alias("k"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "k")
    dealt = known.join(mixed, "key").withColumn("x", F.pmod(F.xxhash64("th"), "k"))
    meets = dealt.withColumn("y", F.explode(F.expr("sequence(0, k - 1)"))).select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.struct("th", "n", "root", "x", "odd").alias("one"))
    pairs = meets.groupBy("key", "i", "j").agg(F.collect_list("one").alias("members")).select("i", "j", "members").mapInArrow(released(_crossed), "a long, b long, na long, nb long")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    # Of the text whose prefix ends first, all but those that similar texts may lack are in the other's prefix too.
    both = F.ceil((F.col("na") + F.col("nb")) * F.lit(SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    one = F.ceil(F.greatest("na", "nb") * F.lit(SIMILARITY) - 1e-6)
    return counted.where(F.col("n") >= both - one + 1).select("a", "b")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, x, y) with all shingle hashes of both texts, those that are similar."""
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(both >= SIMILARITY * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))


def similar_links(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): links among the texts (th) that connect all that are similar; `texts` is as `described`
    and `groups` as `coarse_groups` gives it."""
    pairs = checkpoint(candidates(texts, groups))
    grouped = texts.select("th", "fp").join(groups.where("several"), "fp").select("th", "root")
    wanted = pairs.select(F.col("a").alias("th")).union(pairs.select("b")).distinct().withColumn("root", F.lit(None).cast("long"))
    wanted = grouped.unionByName(wanted).groupBy("th").agg(F.max("root").alias("root"))
    whole = checkpoint(texts.select("th", "sketch").join(wanted, "th"))  # the hashes cross the network once for both
    x, y = whole.select(F.col("th").alias("a"), F.col("sketch").alias("x")), whole.select(F.col("th").alias("b"), F.col("sketch").alias("y"))
    missed = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(released(_similar), "a long, b long")
    return similar_texts(whole.where("root is not null")).union(missed)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each group of similar texts, all columns: that with the least id (a null id
    only where no other is), of rows with that id the text with the least hash."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/near_dedup/{uuid.uuid4().hex}"
    made = described(docs, common_shingles(docs, text, shingle), doc_id, text, shingle)
    made.write.parquet(folder)
    texts = spark.read.schema(made.schema).parquet(folder)
    found = components(similar_links(texts, coarse_groups(texts))).withColumnRenamed("node", "th")
    marked = texts.select("th", "id").join(found, "th", "left").withColumn("root", F.coalesce("root", "th"))
    best = checkpoint(marked.groupBy("root").agg(F.min(F.struct("id.none", "id.id", "th")).alias("best")).select("best.*"))
    remove(spark, folder)
    key = [F.col(doc_id).isNull().alias("__none"), F.coalesce(F.col(doc_id), _zero(docs, doc_id)).alias("__id"), F.xxhash64(text).alias("__th")]
    chosen = best.select(F.col("none").alias("__none"), F.coalesce("id", _zero(docs, doc_id)).alias("__id"), F.col("th").alias("__th"))
    # Join and numbering share the keys, so the rows cross the network once for both.
    kept = docs.select("*", *key).join(chosen, ["__none", "__id", "__th"], "left_semi")
    once = kept.withColumn("__n", F.row_number().over(Window.partitionBy("__none", "__id", "__th").orderBy(F.lit(0))))
    return once.where("__n = 1").select(*docs.columns)


def _zero(docs: DataFrame, doc_id: str) -> Column:
    """A value of the id's type that stands beside the mark of a null id."""
    return F.lit("0").cast(docs.schema[doc_id].dataType)
