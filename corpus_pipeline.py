"""The corpus pipeline: quality rules, near duplicates, personal data, source mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept, and returns a DataFrame; ``run`` writes each result to the
shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import mixing, ngram_join, packing, pii, quality
from barloom.llm.shared import written
from barloom.session import copies, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the labels of the folder are the holdout."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked; n_chars is that of the new text."""
    return docs.withColumn("text", pii.masked(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: some not at all, some up to three times."""
    return mixing.taken(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents and their places in training sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0))


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("source_mix", source_mix), ("best_fit", best_fit),
]

#: thresholds come from binomial bounds and components from iteration, so plain SQL does not express the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = len(copies(spark))
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, copies(spark)[before:-1])  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
