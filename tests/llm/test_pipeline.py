"""Each stage against a brute-force version on its own input, and the run as a whole."""

import random
import re
from collections import defaultdict

import pyarrow.parquet as pq
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontamination import holds_passage
from tests.llm.test_packing import check
from tests.llm.test_quality import slow as slow_quality
from tests.llm.test_secrets import slow as slow_secrets
from tests.llm.test_simhash import slow_groups
from wovengraph.llm import secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]

    def after(name, table):
        out = stages[name](spark, table, FOLDER)
        if name != "packing":
            assert out.columns == docs.columns
        return out.cache(), {r.doc_id: r.asDict() for r in out.collect()}

    table, left = after("quality rules", docs)
    assert left == {d: r for d, r in rows.items() if slow_quality(r["text"])[-1]} and 0 < len(left) < len(rows)
    before = left
    table, left = after("SimHash near-dedup", table)
    groups = slow_groups({d: r["text"] for d, r in before.items()})
    assert left == {d: r for d, r in before.items() if groups[d] == d} and len(left) < len(before)
    before = left
    table, left = after("benchmark decontamination", table)
    assert left == {d: r for d, r in before.items() if not holds_passage(r["text"], items)}
    before = left
    table, left = after("secret scans", table)
    assert set(left) == set(before)
    for d, r in left.items():
        assert r["n_chars"] == len(r["text"])
        assert all(s.startswith("assign") and "REDACTED" not in r["text"] for s in slow_secrets(r["text"].replace(secrets.REDACTED, "")) if s.startswith(("hex", "access"))) or not slow_secrets(r["text"])
        if secrets.REDACTED not in r["text"]:
            assert r == before[d]
    out = stages["packing"](spark, table, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check(out, {d: r["text"] for d, r in left.items()}, library)
    assert not re.search("null", str(out[0]))


def piped(spark, folder, rows, schema):
    """The run's rows over a table of these, and its stages one after another by brute force."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
    left = {r[0]: r[1] for r in rows if slow_quality(r[1])[-1]}
    groups = slow_groups(left)
    left = {d: t for d, t in left.items() if groups[d] == d and not holds_passage(t, items)}
    return corpus_pipeline.run(spark, str(folder)), left


def test_run_over_odd_rows(spark, tmp_path):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()[:60]]
    rng = random.Random(1)
    prose = "\n".join(" ".join("".join(rng.choices("abcdeio", k=rng.randint(2, 9))) for _ in range(12)) for _ in range(9))
    docs += [(9000, None, "en", "s", None, "x", 1), (9001, "", "en", "s", 0, "x", 1), (9002, prose, None, None, None, None, None), (9002, prose, None, None, None, None, None), (9003, prose, "en", "s", 1, "y", 2)]
    out, left = piped(spark, tmp_path / "t", docs, "doc_id long, text string, lang string, source string, n_chars long, th string, root long")
    rows = out.collect()
    assert 9002 in left and 9003 not in left and {r.doc_id for r in rows} == set(left)
    net = secrets.trained()
    whole = {d: "".join(spark_free_redaction(t, net)) for d, t in left.items()}
    check(rows, whole, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def spark_free_redaction(text, net):
    import pyarrow as pa

    found = secrets.findings(pa.array([text]), net)[0]
    return secrets._redacted(text.encode(), found) if found else text


def test_run_over_an_empty_table(spark, tmp_path):
    out, left = piped(spark, tmp_path / "t", [], "doc_id long, text string, lang string, source string, n_chars long")
    assert not left and out.count() == 0


def test_run_matches_the_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.doc_id] += r.length
    assert rows and all(by[r.doc_id] == r.doc_tokens for r in rows)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, FOLDER)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in table.collect())
