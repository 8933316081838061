"""Corpus pipeline over ``documents``: select, deduplicate, redact, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelling.llm import ngram_join, ordinal, packing, pii
from levelling.llm.entropy_mix import apply_mix
from levelling.llm.store import prepare, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose probability of the clean grade is below 0.5 go."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ordinal.select(docs, ordinal.fit(docs, labels, max_labels=20000), least=0.5)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group with five-word shingles at Jaccard 0.8 or more stays."""
    prepare(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: spans of personal data are replaced by their kind; ``n_chars`` follows."""
    prepare(spark)
    clean = pii.redact(docs, pii.train(pii.labelled(spark)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: sources mixed to weights 5, 2, 1; a document is repeated as often as it is taken."""
    prepare(spark)
    return apply_mix(docs, weights=(5, 2, 1), share=1.0, cap=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: batches of 16,384 tokens in eight optimal length buckets."""
    prepare(spark)
    return packing.pack(docs, buckets=8, budget=16384)


STAGES = [("quality", quality), ("near copies", near_copies), ("personal data", personal_data),
          ("mix", mix), ("pack", pack)]

ORACLE_SQL = None  # the classifier is a trained model, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents`` on."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
