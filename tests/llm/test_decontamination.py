"""Decontamination against brute force over words."""

import hashlib
import random
import re

from pyspark.sql import types as T

from wovengraph.llm import decontamination as dc

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_hit", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words_of(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, size=13):
    windows = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    out = {}
    for doc, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if who := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= who
        names = sorted(str(i) for i in ids if i is not None)
        out[doc] = (len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out


def holds_passage(text, items, size=13):
    """Whether a text holds a whole window, or one word in twenty is of short items."""
    words = words_of(text)
    long = {tuple(w[i : i + size]) for _, t in items for w in [words_of(t)] for i in range(len(w) - size + 1)}
    whole = any(tuple(words[i : i + size]) in long for i in range(len(words) - size + 1))
    return whole or slow([(0, text)], items)[0][-1]


def fixture():
    rng = random.Random(3)
    vocabulary = [f"w{i}ß" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 13, 30])))) for i in range(12)]
    items += [(50, "Short, ONE"), (51, ""), (52, None), (53, items[0][1].upper().replace("SS", "ß")), (None, items[1][1]), items[2], (54, "a-b c")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "short one"), (4, "shortone short\none"), (5, "A\x7fB\nC"), (6, "x " * 50_000)]
    for i in range(10, 70):
        text = " ".join(rng.choices(vocabulary, k=rng.choice([3, 40, 300])))
        if i % 2:
            text += "; " + (rng.choice(items)[1] or "").replace(" ", rng.choice([" ", ", ", "\n"])) + " " + rng.choice(vocabulary)
        docs.append((i, text))
    return docs + [docs[9]], items


def rows(frame):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()}


def test_matches_brute_force(spark):
    docs, items = fixture()
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], DOCS)
    assert rows(dc.judge(frame, spark.createDataFrame(items, ITEMS))) == slow(docs, items)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(dc.item_blocks, "__defaults__", ("item_id", "text", dc.WINDOW, 300))
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], DOCS)
    assert len(list(dc.item_blocks(spark.createDataFrame(items, ITEMS)))) > 3
    kept = sorted(map(tuple, dc.decontaminate(frame, spark.createDataFrame(items, ITEMS)).collect()), key=str)
    assert kept == sorted(((d, t, "clash") for d, t in docs if not holds_passage(t, items)), key=str)
    assert rows(dc.judge(frame, spark.createDataFrame(items, ITEMS))) == slow(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert dc.judge(docs, spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0
    full = spark.createDataFrame([(1, "a b", "x")], DOCS)
    assert [r.contaminated for r in dc.judge(full, items).collect()] == [False]
    assert dc.decontaminate(full, items).collect() == full.collect()


def test_spans_lead_back_to_the_original(spark):
    frame = spark.createDataFrame([(1, "é Before.  The QUICK,\nbrown fox! after", "x")], DOCS)
    found = dc.judge(frame, spark.createDataFrame([(9, "the quick brown fox")], ITEMS)).collect()[0]
    text = "é Before.  The QUICK,\nbrown fox! after".encode()
    assert [text[s.start : s.end].decode() for s in found.spans] == ["The QUICK,\nbrown fox"]
    assert dc.decontaminate(frame, spark.createDataFrame([(9, "the quick brown fox")], ITEMS)).count() == 0


def test_a_window_in_a_long_document_is_enough(spark):
    rng = random.Random(11)
    item = " ".join(f"q{i}" for i in range(20))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))
    rows = [(1, f"{long} {item} {long}", "a"), (2, f"{long} {' '.join(item.split()[:12])} {long}", "b"), (3, None, "c"), (3, None, "c"), (4, f"{long} everyday phrase", "d")]
    frame = spark.createDataFrame(rows, DOCS)
    kept = dc.decontaminate(frame, spark.createDataFrame([(1, item), (2, "everyday phrase")], ITEMS)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 3, 4]


def test_pieces_in_many_items_and_periods():
    rng = random.Random(12)
    items = [(str(i), " ".join(["same opening words of every single item here", *rng.choices("abc", k=rng.randint(3, 30))])) for i in range(150)] + [("p", "x y " * 30)]
    made = dc.Automaton([(i, t.encode()) for i, t in items])
    docs = [(k, " ".join(rng.choices("abcxy", k=40)) + " " + rng.choice(items)[1] + " x y" * rng.randint(0, 12)) for k in range(120)]
    want = slow(docs, items)
    for d, text in docs:
        hit, ids, _ = made.find(dc.normal_words(text.encode()))
        assert (len(hit), len(ids)) == want[d][1:3]


def test_a_large_benchmark_makes_one_automaton_of_bounded_memory():
    import subprocess
    import sys

    code = """
import random, resource, sys, time
from wovengraph.llm import decontamination as dc
rng = random.Random(5)
vocabulary = [f"w{i}" for i in range(50_000)]
items = [(str(i), " ".join(rng.choices(vocabulary, k=60)).encode()) for i in range(int(sys.argv[1]))]
size = sum(len(t) for _, t in items)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
made = dc.Automaton(items)
assert len(made.find(dc.normal_words(b"before " + items[7][1] + b" after"))[0]) == 60
print(size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)
"""
    size, memory = map(int, subprocess.run([sys.executable, "-c", code, "3000"], capture_output=True, text=True, check=True).stdout.split())
    assert size > 1_000_000 and memory < 40 * size
