"""The corpus pipeline: five stages that each take and return a table of documents.

Each stage works on all that its predecessor kept, and its decisions take effect.  All but
the last return the columns of documents.  Between stages a table is written as Parquet in
the folder that all executors share and read again, so no stage is computed twice; a table
goes once the next is written.

Rows: null and empty texts have fewer words than a document needs, so the first stage drops
them; given to a later stage alone they are alike in near-dedup (one stays), clean in
decontamination, without findings in the secret scan, and a closing id in packing.  Null ids
count as documents of their own.  Repeated rows are copies, so near-dedup keeps one; the other
stages treat each by itself.  Of alike documents the least id stays.  Other columns, whatever
their names, pass through all stages but packing.  Empty tables give empty results."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph.llm import decontamination, packing, quality, secrets, simhash
from wovengraph.llm.common import remove, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, null and empty texts among them."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays (a null id only where no
    other is); of repeated rows with that id one."""
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark window anywhere go (and those of which a twentieth are
    short benchmark items)."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found are replaced in the text, and n_chars follows; all documents stay."""
    kind = docs.schema["n_chars"].dataType
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences for training."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: Fingerprints, a trained network and a tokenizer are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents.  The result is a table in the shared folder; those
    of the stages before are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
