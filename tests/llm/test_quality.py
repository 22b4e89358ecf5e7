"""Quality rules: measures and verdicts against plain Python, and the cascade's order."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from wovengraph.llm import quality

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType())])


def slow(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(grams)
    repeated = len({k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)})
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dups += line in seen
            seen.add(line)
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 50 or 100 * repeated > 50 * n
    used = [x for x in lines if re.search("[^\x20\x09-\x0d]", x)]
    lettered = sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words)
    kept = not (failed or 10 * symbols > n or chars < 2 * n or chars > 20 * n or 10 * dups > 3 * len(lines))
    kept = kept and not (10 * lettered < 7 * n or 10 * sum(x[0] in "-*" for x in used) > 9 * len(used) or 10 * sum(x.endswith("...") for x in used) > 3 * len(used))
    return n, chars, symbols, dups, repeated, failed, kept


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\n", "a", "a\nb\na\n a\na", "x x x x", "\x1c\x85é a", "é" * 100_000, "# " * 60, "no\r\nno\r\n" * 40]
    for _ in range(150):
        words = [rng.choice(["aé", "bb", "ccc", "d#", "*", "eeeeeeeeeeeeeeeeeeeeeeeeee"]) + str(rng.randrange(rng.choice([2, 2000]))) for _ in range(rng.choice([10, 60, 200]))]
        out.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\x0b"]) for w in words))
    for _ in range(20):  # clean ones
        out.append("\n".join(" ".join(rng.choice(["aé", "bb", "ccc", "delta"]) + str(rng.randrange(3000)) for _ in range(12)) for _ in range(9)))
    clean = out[-1].split("\n")
    out += ["\n".join(f"- {x}" for x in clean), "\n".join(["* x", *(f"*{x}" for x in clean[:-1])]), "\n".join(x + "..." for x in clean), "\n".join(x + ".." for x in clean)]
    out += [" ".join(str(rng.randrange(10**6)) for _ in range(90)) + " aa bb"]
    pairs = [swapped(1 << k) for k in (10, 11, 12, 13)]  # words that some polynomial hashes can't tell apart
    return out + [" ".join(f"{x} p q {y} p q" for x, y in pairs), "\n".join(x for p in pairs for x in p)]


def swapped(n):
    """Two words of n letters, the Thue-Morse word and the one with both letters exchanged."""
    word = "".join("ai"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ai", "ia"))


def test_measures_and_verdicts(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows + rows[20:21] + [(None, "a", "x")], DOCS)
    got = quality.judge(frame).collect()
    assert len(got) == len(rows) + 2
    want = {i: slow(t) for i, t, _ in rows} | {None: slow("a")}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == want[r.doc_id]
    assert any(v[-1] for v in want.values())
    kept = quality.keep(frame)
    assert kept.columns == DOCS.names
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, v in want.items() if v[-1]] + [i for i in (20,) if want[20][-1]])


def test_later_rules_see_only_what_is_left(spark):
    seen = []

    def watching(name, share):
        def rejects(t):
            seen.append((name, len(t.column)))
            return np.arange(len(t.column)) < share * len(t.column)

        return quality.Rule(name, rejects)

    column = pa.array([f"text {i}" for i in range(100)])
    rules = (watching("first", 0.75), watching("second", 0.2))
    assert (quality.verdicts(column, rules) >= 0).sum() == 80
    assert seen == [("first", 100), ("second", 25)]
    seen.clear()  # the form that judges some rows alone
    assert quality.verdicts(column, rules, np.arange(50, 100))[:50].max() == -1 and seen == [("first", 50), ("second", 12)]
    # Of two rules that reject alike the cheaper comes first, whatever the order given.
    import time

    dear = quality.Rule("dear", lambda t: (time.sleep(0.01), np.ones(len(t.column), bool))[1])
    cheap = quality.Rule("cheap", lambda t: np.ones(len(t.column), bool))
    frame = spark.createDataFrame([(i, f"t {i}", "") for i in range(200)], DOCS)
    assert [r.name for r in quality.plan(frame, rules=(dear, cheap))] == ["cheap", "dear"]


def test_the_sample_is_drawn_from_all_partitions(spark):
    rows = [(i, "few words" if i < 3000 else " ".join(f"w{k}" for k in range(60)) + " $" * 20, "") for i in range(6000)]
    frame = spark.createDataFrame(rows, DOCS).coalesce(4).sortWithinPartitions("doc_id")
    import pyspark.sql.functions as F

    first = quality.Rule("first half", lambda t: np.array(t.n_words < 50))
    last = quality.Rule("last half", lambda t: np.array(t.n_symbols > 5))
    assert {r.name for r in quality.plan(frame, rules=(first, last), sample_rows=400)} == {"first half", "last half"}
    found = frame.sample(400 / 6000, 7).select((F.col("doc_id") < 3000).alias("early")).groupBy("early").count().collect()
    assert min(r["count"] for r in found) > 120 and len(found) == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
