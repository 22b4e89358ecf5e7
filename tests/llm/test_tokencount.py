"""Token counts against the library."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import types as T

from tests.llm.test_quality import swapped
from wovengraph.llm import tokencount
from wovengraph.llm.common import buffers

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])
ODD = ["", " ", "  ", "\n", "\n\n a", " a", "a ", "a  b   c ", "a\n\tb ", " \n x", "x \n", "<s> hi</s> <unk> <0x0A>", "①ﬁ", "a　b", "▁x▁▁ y", "\xa0q", "a\x00b", "日本語テキスト", "😀👍🏽 x", "é́", "a" * 5000, "ab" * 900 + " " * 700 + "b", "=" * 2100, "".join(random.Random(3).choices("abcdeghilnorst0123456789+/éßZ", k=9000)), *(" ".join(swapped(1 << k)) for k in (10, 11, 12, 13))]


def test_counts_are_the_librarys():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice([" ", " ", "\n", "the", "ing", "é", "ß", "▁", "Qu", "0", "__", "\t", "漢", "𝒳", "ation", "</s>"]) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    expected = [len(x) for x in model.encode(texts)]
    for part, want in ((texts, expected), (texts[::-1], expected[::-1])):
        got = tokencount.counter(PATH).count(*buffers(pa.array(part, pa.string()))).tolist()
        assert got == want, [(t, g, w) for t, g, w in zip(part, got, want, strict=True) if g != w][:3]


def test_rows(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(1, None, "clash"), (2, "", "x"), (3, "ünder " * 3000, "x"), (3, "ünder " * 3000, "x"), (None, "a b", "x")]
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(spark.createDataFrame(rows, DOCS), PATH).collect()]
    want = [(d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_over_whole_documents():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    assert tokencount.counter(PATH).count(*buffers(pa.array(texts))).tolist() == [len(x) for x in model.encode(texts)]
    assert np.array([len(t.encode()) for t in texts]).max() > 1000
