"""Packing: exact ids, every id in one place, little padding, and the solver."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tests.llm.test_quality import swapped
from wovengraph.llm import packing
from wovengraph.llm.common import buffers
from wovengraph.llm.merges import RankMerger

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType())])
ODD = ["<|endoftext|> a", "x<|startoftext|>y", "é ́a", "A　B\xa0c", "don't I'LL", "İı ΑΣ ΟΔΟΣ", "\x1c\x1fa\x85b c", "", "  ", "日本語テキスト", "😀👍🏽 x", "a\x00b", "ﬁ ①", "ÀÉß÷ ×a Ñandú, œuvre. Ÿ!", "é", "É", "a,b c,, ?", "x" * 3000 + " " + "ab" * 400, "".join(random.Random(3).choices("abcdeghilnorstuéßZ", k=4000)), *(" ".join(swapped(1 << k)) for k in (10, 11, 12, 13))]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "É", "ß", " ", "\n", ",", ".", "'s", "9", "Zz", "the", "—", "́", "\r"]) for _ in range(60)) for _ in range(300)]
    for part in (texts, texts[::-1]):  # the second time from the store
        ids, edges = packing.encoder(PATH).encode(*buffers(pa.array(part, pa.string())))
        for t, a, b in zip(part, edges, edges[1:], strict=False):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


def slow_merge(symbols, rules):
    """One merge at a time: of the lowest rank, the leftmost."""
    symbols = list(symbols)
    while found := min(((rules[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rules), default=None):
        (_, made), k = found
        symbols[k : k + 2] = [made]
    return symbols


@pytest.mark.parametrize("ordered", [True, False])
def test_sequences_merge_as_one_pair_at_a_time(ordered):
    rng = np.random.default_rng(0)
    for _ in range(20):
        if ordered:  # each pair makes a symbol of its own from older ones
            rules = {}
            for k in range(25):
                rules.setdefault(tuple(int(x) for x in rng.integers(0, 3 + k, 2)), (len(rules), 3 + k))
            rules = {p: (n, made) for p, (n, made) in rules.items() if made > max(p)}
        else:
            left, right = np.divmod(rng.permutation(36)[:20], 6)
            rules = {(int(a), int(b)): (k, int(rng.integers(0, 6))) for k, (a, b) in enumerate(zip(left, right, strict=True))}
        merger = RankMerger(*np.array([(a, b, r, m) for (a, b), (r, m) in rules.items()]).T)
        assert merger._calm.all() or not ordered
        sizes = rng.choice([0, 1, 2, 7, 30, 300], 40)
        first = np.concatenate([[0], np.cumsum(sizes)])
        flat = rng.integers(-1, 3 if ordered else 6, first[-1])
        out, edges = merger.merge(flat, first)
        for k in range(40):
            assert out[edges[k] : edges[k + 1]].tolist() == slow_merge(flat[first[k] : first[k + 1]].tolist(), rules)


def test_the_tokenizers_merge_all_places_at_once():
    from wovengraph.llm import tokencount

    assert packing.encoder(PATH)._merger._calm.all()
    assert tokencount.counter(public_tokenizers.path("piece_bpe_32k.model"))._merger._calm.mean() > 0.7


def test_nnls_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gradient <= 1e-6).all() and np.abs(gradient[x > 1e-8]).max() < 1e-6


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(4)
    histogram = np.concatenate([[0], rng.integers(0, 50, 256)])
    used = np.zeros(257, int)
    for pattern, times in packing.plan(histogram).patterns:
        assert sum(pattern) <= 256 and times > 0
        for u in pattern:
            used[u] += times
    assert (used == histogram).all()
    assert packing.plan(np.zeros(257, int)).patterns == []


def check(rows, texts, library):
    """Every id in exactly one piece, offsets gapless, no sequence over the window; the share padded."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return 1 - sum(r.length for r in rows) / (2048 * len(by_sequence))


def test_packs_everything_exactly(spark, library):
    rng = random.Random(6)
    texts = dict(enumerate([None, *ODD, "word " * 9000]))
    for i in range(100, 900):
        texts[i] = " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, rng.choice([20, 200, 700, 1500]))))
    frame = spark.createDataFrame([(d, t, "clash") for d, t in texts.items()], DOCS)
    assert check(packing.pack(frame, PATH).collect(), texts, library) < 0.02


def test_repeated_rows_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x")], DOCS)
    rows = packing.pack(frame, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 3), (1, 3)]
    assert sorted(r.offset for r in rows) in ([0, 2, 5], [0, 3, 5], [0, 3, 6])
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0
