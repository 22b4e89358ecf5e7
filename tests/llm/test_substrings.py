"""Substring dedup against brute force."""

import hashlib
import random
import re

from pyspark.sql import types as T

from tests.llm.test_quality import swapped
from wovengraph.llm import substrings

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("at", T.StringType())])


def slow(docs, size=20):
    words = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in docs}
    seen, out = set(), {}
    for d in sorted(words):
        gone = set()
        for i in range(len(words[d]) - size + 1):
            w = tuple(words[d][i : i + size])
            if w in seen:
                gone |= set(range(i, i + size))
            seen.add(w)
        kept = " ".join(w for i, w in enumerate(words[d]) if i not in gone)
        out[d] = (len(words[d]), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def fixture():
    rng = random.Random(8)
    vocabulary = [f"w{i}é" for i in range(500)]
    passages = [" ".join(rng.choices(vocabulary, k=k)) for k in (19, 20, 21, 45, 130)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "a " * 300), (4, "b a " * 40), (5, "a " * 19), (6, "x" * 200_000 + " y" * 25)]
    for i in range(10, 120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += [" ".join(rng.choices(vocabulary, k=rng.choice([1, 7, 60]))), rng.choice(passages) if rng.random() < 0.6 else ""]
        docs.append((20 + i * 3 % 331, rng.choice([" ", "\n", "\t\x0c"]).join(parts)))
    tail = " ".join(rng.choices(vocabulary, k=19))
    docs += [(500 + k, f"{w} {tail}") for k, w in enumerate(w for n in (10, 11, 12, 13) for w in swapped(1 << n))]  # alike in 19 words only
    return docs + [(400, docs[30][1]), (401, docs[30][1]), (-5, docs[40][1])]


def rows(frame):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()}


def test_matches_brute_force(spark):
    docs = fixture()
    got = rows(substrings.remove_repeats(spark.createDataFrame([(d, t, "clash") for d, t in docs], DOCS).repartition(5)))
    want = slow(docs)
    assert sum(n for _, n, _ in want.values()) > 1000
    assert got == want


def test_repeated_rows_and_null_ids(spark):
    docs = fixture()[:60]
    body = " ".join(f"q{i}" for i in range(30))
    extra = [(None, body), (1000, body + " z"), (1000, body + " z")]
    frame = substrings.remove_repeats(spark.createDataFrame([(d, t, "x") for d, t in docs + extra], DOCS))
    got = [(r.doc_id, r.n_words, r.n_removed) for r in frame.collect() if r.doc_id in (None, 1000)]
    assert sorted(got, key=str) == [(1000, 31, 30), (1000, 31, 30), (None, 30, 0)]
    want = slow(docs)
    assert {d: v for d, v in rows(frame).items() if d in want} == want


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_doubling_goes_on_until_no_candidates_survive(spark):
    rng = random.Random(9)
    body = [f"p{i}" for i in range(90)]
    docs = [(1, " ".join(body)), (2, "u v " + " ".join(body[:50]) + " w"), (3, " ".join(rng.choices(body, k=60)))]
    got = {(r.doc_id, r.start): r.words for r in substrings.longest(spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)).collect()}
    want = {}
    for d, shift in ((1, 0), (2, 2)):
        for i in range(31):
            want[d, i + shift] = 40 if i <= 10 else 20
    assert got == want


def test_window_hashes_agree_across_texts():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    for size in (1, 2, 3, 5, 10, 20, 21):
        assert (substrings.window_hashes(h, size)[7:] == substrings.window_hashes(h[7:], size)).all()
