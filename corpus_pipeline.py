"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing, tokenizing.

Every stage takes all that the one before kept, written as a Parquet table and
read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality
from docspark.llm.common import documents, materialise

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    figures, n = quality.with_features(quality.labelled(docs, labels), keep=["doc_id", "lang"])
    cutoffs = quality.fit_cutoffs(figures, n, labels)
    full, n = quality.with_features(docs)
    return full.where(~quality.base_failed(n) & quality.verdict(cutoffs, n)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact_dedup.survivors(docs).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least doc_id."""
    return near_dedup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' targets takes them."""
    return mixing.mixed(docs, materialise(mixing.mix(docs)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text."""
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, round_trip=True)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), whole.alias("round_trip"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mix_sources), ("byte_bpe", tokenize)]

#: Near-dedup and the certified cutoffs have no form in SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
