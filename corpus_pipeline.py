"""The corpus pipeline: five stages from raw documents to packed batches, each one operator of tessera.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name
from tessera.llm.exact_dedup import distinct_documents
from tessera.llm.langid import UNKNOWN, fit, identify
from tessera.llm.mixing import mixed_documents
from tessera.llm.packing import pack
from tessera.llm.simhash import representatives
from tessera.session import materialize, table

#: Least share of a document's n-grams that the filter of its language must hold. Most texts of a learned language have 0.9, the
#: shortest of them over 0.3; what is in none of the languages has less.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no language learned from the labelled ones."""
    lang, score = free_name(docs, "lang_found"), free_name(docs, "lang_score")
    found = identify(docs, fit(docs), (lang, score))
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 over five-word shingles."""
    return representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until each source has its target of words."""
    return mixed_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents into batches of optimal length buckets."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_batches", pack_batches),
]

#: The language and near-duplicate stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = materialize(docs, name)
    return docs
