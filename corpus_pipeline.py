"""From raw documents to packed sequences, in five stages that each read what the one before wrote.

Every stage takes all rows it is given, and all but the last return the columns of ``documents``. Rows with
null texts or ids pass the filters unless a stage says otherwise; rows with equal doc_ids are one document
and stay or go together. Further columns are carried along. An empty table stays empty.

The stages leave Arrow's batches small in their session: what a stage returns goes through Python workers when it is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontamination, jaccard_join, packing, quality_classifier, storage, substring_dedup

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    storage.lasting_small_batches(spark)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of linked documents."""
    gone_id = storage.fresh(docs.columns, "gone")
    found = jaccard_join.join(docs).where(F.col("component_id") != F.col("doc_id"))
    gone = storage.written(found.select(F.col("doc_id").alias(gone_id)).distinct(), "near-duplicates")
    return docs.join(storage.bounded(gone), F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds out of the texts; ``n_chars``, where there is one, follows."""
    storage.lasting_small_batches(spark)
    spans = storage.fresh(docs.columns, "spans")
    cut = substring_dedup.dedup(docs, spans_name=spans)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*storage.quoted(docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    files = packing.encode(docs, storage.new_folder(spark, "packing"), public_tokenizers.path(TOKENIZER), END_ID)
    return packing.pieces(spark, files)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark),
    ("packing", pack),
]

#: Hash-cut chunks, trained models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
