"""The cell index against a scan of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wovengraph.operators import vectors
from wovengraph.operators.vector_index import ODD, VectorIndex

FOLDER = "/root/testdata/sf0.01"


def found(frame):
    return [(r.id, None if r.score is None else round(r.score, 9)) for r in frame.orderBy(F.desc_nulls_last("score"), "id").collect()]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding").cache()


def test_equals_a_scan_and_recall_of_the_nearest_cells(spark, chunks, tmp_path):
    index = VectorIndex.build(chunks, str(tmp_path / "i"))
    kept = spark.read.parquet(f"{index.folder}/rows")
    assert kept.count() == chunks.count() == kept.select("id").distinct().count()
    hit = total = 0
    asked = chunks.where("cast(id as bigint) % 20 = 0").orderBy(F.col("id").cast("bigint")).limit(12).collect()
    for r in asked:
        want = found(vectors.nearest(chunks, r.embedding, 10))
        assert found(index.search(r.embedding, 10, probes=2)) == want
        near = {i for i, _ in found(index.search(r.embedding, 10, probes=16, exact=False))}
        hit, total = hit + len(near & {i for i, _ in want}), total + len(want)
    assert hit / total >= 0.9
    assert found(index.search(asked[0].embedding, 5, 0.5)) == found(vectors.nearest(chunks, asked[0].embedding, 5, 0.5))


def test_odd_rows_ties_and_empty_tables(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"c{k}", rng.normal(size=4).tolist()) for k in range(60)] + [(f"same{k}", [1.0, 0.0, 0.0, 0.0]) for k in range(400)]
    rows += [("null", None), ("zero", [0.0] * 4), ("short", [1.0, 2.0]), ("hole", [1.0, None, 0.0, 0.0]), ("c0", rows[0][1])]
    chunks = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("cell", F.lit("x")).withColumn("score", F.lit(1))
    index = VectorIndex.build(chunks, str(tmp_path / "i"), 7)
    assert {r.id for r in spark.read.parquet(f"{index.folder}/rows").where(F.col("cell") == ODD).collect()} == {"short", "hole"}
    for query in ([1.0, 0.0, 0.0, 0.0], [0.0, 1.0, -1.0, 0.0], [0.0] * 4, [1.0, 2.0], [-1.0, 0.0, 0.0, 0.0]):
        for k in (0, 1, 50, 410, 1000):
            assert found(index.search(query, k, probes=1)) == found(vectors.nearest(chunks, query, k))
    empty = VectorIndex.build(chunks.limit(0), str(tmp_path / "e"))
    assert found(empty.search([1.0, 0.0, 0.0, 0.0], 3)) == []
