"""A corpus pipeline: toxicity, near-duplicates, benchmark leaks, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as Parquet in the shared checkpoint
folder and reads it again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideglass.llm import decontamination, mixing, simhash, token_store, toxicity
from tideglass.llm.common import table
from tideglass.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones, rejects."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group linked by sets of five-word shingles with a Jaccard similarity of 0.8 or more,
    counted on the sets. The pigeonhole brings all candidates whose fingerprints differ in up to 4 of 64 bits together; those that differ in up to
    18 meet in partitions of signatures."""
    return simhash.one_of_each(docs, shingle=5, radius=18, min_similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's budget holds it (a row for each time)."""
    return mixing.mixed_rows(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stores the documents' token ids by planes and returns what the store gives back for each row."""
    return token_store.stored_tokens(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_store", token_stage),
]

#: Fitted dictionaries, XXH64 fingerprints and a BPE tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = token_store.shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            token_store.delete(spark, last)
        last = path
    return docs
