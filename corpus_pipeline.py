"""A training corpus from documents, in five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from workloom.llm import byte_pairs, host_rules, near_copies, private_data, template_leaks
from workloom.llm.queries import VOCABULARY
from workloom.llm.shared import kept, small_batches
from workloom.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host rules reject go."""
    small_batches(spark)
    return host_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    small_batches(spark)
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or re-parameterised, go."""
    small_batches(spark)
    return template_leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def private_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts."""
    small_batches(spark)
    return private_data.masked(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, decoded again."""
    small_batches(spark)
    return byte_pairs.encoding_digest(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("private_data", private_spans),
    ("byte_pairs", tokens),
]
#: SQL has no byte-pair encoding; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
