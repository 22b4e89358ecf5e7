"""SimHash: fingerprints, the Golay keys, and components against brute force."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import types as T

from wovengraph.llm import golay, simhash

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("key", T.LongType())])


def slow_fingerprint(text: str, n: int = 3) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps: dict[int, int]) -> dict[int, int]:
    nodes, root = sorted(set(fps.values())), {}
    for x in nodes:
        root[x] = x

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if (x ^ y).bit_count() <= 3:
                root[find(x)] = find(y)
    least: dict[int, int] = {}
    for d, x in fps.items():
        least[find(x)] = min(d, least.get(find(x), d))
    return {d: least[find(x)] for d, x in fps.items()}


def test_golay_is_perfect_and_neighbours_share_keys():
    table = golay.decoder()
    assert table.min() == 0 and (np.bincount(table) == 2048).all()
    words = np.random.default_rng(1).integers(0, 1 << 22, 2000).astype(np.int32)
    found = golay.keys(words, 22)
    assert found.shape[1] <= 6
    for bit in range(22):
        assert (found == table[words ^ (1 << bit)][:, None]).any(1).all()


def test_matches_brute_force_with_edge_cases(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(400)]
    texts = [None, "", " \t\n", "One", "two WORDS", "A b c", "\x1c\x85 odd spaces", "x" * 300_000]
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.choice([4, 90, 400]))
        for _ in range(rng.choice([1, 1, 4])):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += texts[:12]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows + [rows[20]], DOCS)).collect()}
    fps = {i: slow_fingerprint(t or "") for i, t, *_ in rows}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == fps
    assert {d: r.component_id for d, r in got.items()} == slow_components(fps)


def test_links_in_dense_and_hot_files_are_whole(spark, monkeypatch):
    rng = random.Random(2)
    fps = set()
    for centre in (0, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(260):
            x = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 5])):
                x ^= 1 << b
            fps.add(x)
    fps = dict(enumerate(sorted(fps)))
    monkeypatch.setattr(simhash, "HOT", 8)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    signed = [(d, x - (1 << 64) if x >> 63 else x) for d, x in fps.items()]
    got = simhash.grouped(spark.createDataFrame(signed, "doc_id long, fp long"))
    assert {r.doc_id: r.component_id for r in got.collect()} == slow_components(fps)


def test_keys_are_never_broadcast(spark, monkeypatch):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(600)}
    fps |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in rng.sample(sorted(fps), 200)}
    fps |= {x ^ (1 << a) ^ (1 << b) for x in [min(fps)] for a in range(22) for b in range(a)}
    fps = dict(enumerate(sorted(fps)))
    signed = spark.createDataFrame([(d, x - (1 << 64) if x >> 63 else x) for d, x in fps.items()], "doc_id long, fp long")
    for hot in (256, 8):  # the second: large keys go through blocks
        monkeypatch.setattr(simhash, "HOT", hot)
        found = simhash.links(signed.select("fp").distinct())
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastExchange" not in plan
        assert {r.doc_id: r.component_id for r in simhash.grouped(signed).collect()} == slow_components(fps)


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "same words here again", "x", 1), (7, "same words here again", "x", 1), (None, "quite another text over there", "x", 1)]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == [(7, 7), (None, 7), (None, None)]


def slow_shingles(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)])


def slow_groups(texts: dict[int, str | None], similarity: float = 0.8) -> dict[int, int]:
    """The least id of those that chains of similar texts reach, by comparing all pairs."""
    sets = {d: slow_shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            if len(sets[x] & sets[y]) >= similarity * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {d: find(d) for d in texts}


def edited(rng, words, edits, vocabulary):
    copy = list(words)
    for at in rng.sample(range(len(copy)), edits):
        copy[at] = rng.choice(vocabulary)
    return " ".join(copy)


def test_one_of_each_group_stays_with_all_columns(spark):
    rows = [(3, "a b c d e f", "x", 1), (2, "A b c d e f", "y", 2), (2, "A b c d e f", "y", 2), (9, "other words", "z", 3)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, DOCS))
    assert kept.columns == DOCS.names
    assert sorted(map(tuple, kept.collect())) == [(2, "A b c d e f", "y", 2), (9, "other words", "z", 3)]
    assert simhash.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_similar_texts_go_and_others_stay(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}é" for i in range(3000)]
    texts = [None, "", " \t\n", "One", "one", "two WORDS", "two words", "x" * 300_000, "a b c d e f"]
    for size in (60, 100, 200, 230):
        for _ in range(12):
            words = rng.choices(vocabulary, k=size)
            texts += [" ".join(words)] + [edited(rng, words, rng.choice([0, 1, 1, 2, 8]), vocabulary) for _ in range(3)]
    family = rng.choices(vocabulary, k=150)
    texts += [edited(rng, family, rng.choice([1, 2, 3, 4]), vocabulary) for _ in range(90)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, (None, None, "x", 1), (None, "alone without an id", "x", 1)], DOCS)
    groups = slow_groups(dict(enumerate(texts)))
    want = sorted(d for d, g in groups.items() if d == g)
    for hot, block in ((256, 1024), (8, 20)):  # the second: large keys and groups go through blocks
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "BLOCK", 2 * hot)
        monkeypatch.setattr(simhash, "TEXTS", block)
        kept = simhash.deduplicate(frame).collect()
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == want
        assert [r.text for r in kept if r.doc_id is None] == ["alone without an id"]


def test_sketches_of_long_texts(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(9000)]
    words = rng.choices(vocabulary, k=4000)
    texts = [" ".join(words), edited(rng, words, 20, vocabulary), edited(rng, words, 900, vocabulary), " ".join(words[:2400]), " ".join(rng.choices(vocabulary, k=4000))]
    kept = simhash.deduplicate(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


def test_fingerprints_at_five_bits_share_a_key():
    rng = np.random.default_rng(6)
    fp = rng.integers(-(1 << 63), 1 << 63, 400)
    other = fp.copy()
    for k in range(len(fp)):
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            other[k] ^= np.array(1 << int(bit), np.uint64).view(np.int64)

    def filed(x):
        import pyarrow as pa

        out = set()
        for batch in simhash._all_keys(iter([pa.RecordBatch.from_arrays([pa.array(x)], ["fp"])])):
            out |= set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        return out

    by = [{}, {}]
    for side, x in enumerate((fp, other)):
        for key, f in filed(x):
            by[side].setdefault(f, set()).add(key)
    assert all(by[0][int(x)] & by[1][int(y)] for x, y in zip(fp, other, strict=True))


def test_copies_with_passages_cut_or_added_go(spark, monkeypatch):
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = rng.choices(vocabulary, k=30)  # a passage that many texts have
    texts = []
    for size in (70, 120, 250, 500):
        for _ in range(20):
            words = rng.choices(vocabulary, k=size) + (line if rng.random() < 0.5 else [])
            size, other, at = len(words), rng.choices(vocabulary, k=len(words)), rng.randrange(len(words))
            copies = [words, words[: size - size * 18 // 100], words[size * 12 // 100 :], words + other[: size * 20 // 100], words[:at] + other[: size // 10] + words[at:], words[: size * 3 // 4]]
            texts += [" ".join(c) for c in (words, *rng.sample(copies[1:], 2))]
    groups = slow_groups(dict(enumerate(texts)))
    want = sorted(d for d, g in groups.items() if d == g)
    frame = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], DOCS)
    for block, common in ((1024, 3), (5, 1 << 30)):  # the second: blocks of few texts, and no shingle known as common
        monkeypatch.setattr(simhash, "TEXTS", block)
        monkeypatch.setattr(simhash, "COMMON", common)
        assert sorted(r.doc_id for r in simhash.deduplicate(frame).collect()) == want


def test_long_texts_near_the_similarity_are_compared_whole(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(9000)]
    texts = []
    for _ in range(30):
        words = rng.choices(vocabulary, k=3000)
        texts += [" ".join(words), " ".join(words[: int(3000 * rng.uniform(0.785, 0.815))])]
    near = []
    for k in range(0, len(texts), 2):
        x, y = slow_shingles(texts[k]), slow_shingles(texts[k + 1])
        near.append(len(x & y) >= 0.8 * len(x | y))
    assert 0 < sum(near) < len(near)
    sketches = simhash.sketches(simhash.Words(pa.array(texts)), 5)[0].to_pylist()
    assert [simhash.similar_forest(sketches[k : k + 2]) == ([0], [1]) for k in range(0, len(texts), 2)] == near
    monkeypatch.setattr(simhash, "BYTES", 30_000)  # blocks of a few long texts
    kept = simhash.deduplicate(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [k for k in range(len(texts)) if k % 2 == 0 or not near[k // 2]]


def test_a_repeated_verification_gives_the_same_links():
    import pyarrow as pa

    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(500)]
    words = rng.choices(vocabulary, k=200)
    texts = [edited(rng, words, rng.choice([1, 2, 4, 6]), vocabulary) for _ in range(40)]
    members = [{"th": rng.getrandbits(62), "sketch": s} for s in simhash.sketches(simhash.Words(pa.array(texts)), 5)[0].to_pylist()]
    kind = pa.list_(pa.struct([("th", pa.int64()), ("sketch", pa.binary())]))

    def links(order):
        batch = pa.RecordBatch.from_arrays([pa.array([order], kind)], ["members"])
        return [r for out in simhash._verified(iter([batch])) for r in out.to_pylist()]

    first = links(members)
    assert first
    for _ in range(5):
        assert links(rng.sample(members, len(members))) == first
