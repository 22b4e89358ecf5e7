"""Toxicity: held-out accuracy, folds, and fewer false positives on neutral group mentions."""

import random
import zlib

from pyspark.sql import types as T

from wovengraph.llm import toxicity

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
LABELS = "doc_id long, toxic int, quality int"


def corpus(n=900, seed=3):
    """Insults make a text toxic; in the labels a group is mentioned mostly in toxic texts."""
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 60))
        y = int(rng.random() < 0.2)
        if y:
            words += [rng.choice(["Blarg", "snivelling", "snivelly"])] if rng.random() < 0.75 else []
        if rng.random() < (0.7 if y else 0.02):
            words.append("Muslims")
        rng.shuffle(words)
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, y, 1))
    return docs, labels


def auc(rows):
    order = sorted((s, y) for s, y in rows)
    ranks = [k for k, (_, y) in enumerate(order) if y]
    p, n = len(ranks), len(order) - len(ranks)
    return (sum(ranks) - p * (p - 1) / 2) / (p * n)


def test_held_out_accuracy_on_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    assert auc([(r.score, r.toxic) for r in rows]) > 0.97
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    recall = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert right > 0.97 and recall > 0.85


def test_swaps_reduce_false_positives_on_neutral_mentions(spark):
    docs, labels = (spark.createDataFrame(*x) for x in zip(corpus(), (DOCS, LABELS), strict=True))
    neutral = [(f"{t} met at word{i} for word{i + 1}") for i, t in enumerate(["muslims", "jews", "christians", "hindus"])]
    import pyarrow as pa

    plain = toxicity.train(docs, labels, counterfactual=0.0).score(pa.array(neutral))
    fair = toxicity.train(docs, labels).score(pa.array(neutral))
    assert plain[0] > 0.3 and fair[0] < 0.5 * plain[0]
    assert fair.max() < 0.3 and fair.max() - fair.min() < 0.1
    insulted = toxicity.train(docs, labels).score(pa.array(["you blarg muslims", "you blarg jews"]))
    assert insulted.min() > 0.3


def test_the_penalty_is_that_of_swapped_sentences():
    """What the sparse swaps say of the score, against scoring texts with the words exchanged."""
    import re

    import numpy as np
    import pyarrow as pa

    docs, _ = corpus(200)
    texts = [t for _, t, _ in docs] + ["Muslims and jews, muslims; christians", "Women mention a womanly muslim", "", "jews"]
    hashes = np.unique(np.concatenate([h for _, h in toxicity.features(pa.array(texts + [t for g in toxicity.IDENTITY_TERMS for t in g]))]))
    rng = np.random.default_rng(3)
    model = toxicity.Model(hashes, rng.normal(0, 0.3, len(hashes)), 0.1)

    def logit(text):
        p = model.score(pa.array([text]))[0]
        return np.log(p / (1 - p))

    def exchanged(text, term, to):
        return re.sub(r"[A-Za-z\x80-\uffff]+", lambda m: to if m[0].lower() == term else m[0], text)

    want = []
    for text in texts:
        words = {w.lower() for w in re.findall(r"[A-Za-z\x80-\uffff]+", text)}
        for group in toxicity.IDENTITY_TERMS:
            for k, term in enumerate(group):
                if term in words:
                    want += [logit(exchanged(text, term, to)) - logit(text) for to in (group[(k + 1) % len(group)], "")]
    swaps = toxicity.Swaps(model, toxicity.IDENTITY_TERMS)
    got = [(model.weights[f] * d).sum() for _, f, d in swaps.of(*model.present(pa.array(texts)))]
    assert len(want) > 20 and np.allclose(sorted(got), sorted(want), atol=1e-6)


def test_the_fit_minimises_loss_and_penalty():
    """Against the loss written out over dense rows: no step from the solution lowers it."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = (rng.random((80, 12)) < 0.3).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.normal(0, 0.5, 80) > 0.6).astype(float)
    d = rng.integers(-1, 2, (25, 12)) * (rng.random((25, 12)) < 0.3)
    number, feature = np.nonzero(d)
    kept = np.unique(number, return_inverse=True)[1]
    dense = d[np.unique(number)]

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.7 * np.mean((dense @ w) ** 2) + 0.01 * np.abs(w).sum()

    w, b = toxicity.fit(*np.nonzero(x), y, 12, (kept, feature, d[number, feature].astype(float)), 0.7, 0.01, 20_000, 1e-9)
    best = loss(w, b)
    for _ in range(400):
        step = rng.normal(0, 10.0 ** rng.integers(-4, 0), 13)
        assert loss(w + step[:12], b + step[12]) >= best - 1e-9
    assert np.abs(w).max() > 0.1


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = corpus(300)
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y, q) for d, y, q in labels]
    frame = spark.createDataFrame(docs, DOCS)
    one, two = (toxicity.train(frame, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert (one.hashes == two.hashes).all() and (one.weights == two.weights).all() and one.offset == two.offset


def test_edge_rows(spark):
    docs, labels = corpus(200)
    docs += [(None, "blarg", "x"), (1000, None, "x"), (1001, "", "x"), (1001, "", "x"), (1002, "z" * 300_000, "x")]
    labels += [(None, 1, 1), (5, None, 1), (7777, 1, 1)]
    frame = spark.createDataFrame(docs, DOCS)
    rows = toxicity.score(frame, toxicity.train(frame, spark.createDataFrame(labels, LABELS))).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in rows)
    none = toxicity.train(frame, spark.createDataFrame([], LABELS))
    assert {r.predicted for r in toxicity.score(frame, none).collect()} == {0}
    assert toxicity.score(spark.createDataFrame([], DOCS), none).count() == 0
