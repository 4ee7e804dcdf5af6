"""A corpus pipeline of five stages; each reads the documents that its predecessor kept.

A stage is a function of (spark, docs, sf_dir). The first four return rows of docs with the columns of docs;
the last encodes the texts that are left. Extra columns stay, whatever their names. Null, empty and word-less texts fail the quality rules; in the
later stages they are no copies and hold no passage. Of repeated rows and equal texts one row stays after the join stage; a row with a null id is judged like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rackmill.llm import decontam, jaccard, quality_classifier, quality_rules, sp_scan
from rackmill.llm.common import materialize, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.passing(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids and their digests of what is left."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sp_scan.round_trip(docs, path)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Hashed models, a trained network and tokenizers are no SQL; tests hold each stage against its operator's verdicts, and base rules, near duplicates and ids against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
