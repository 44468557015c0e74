"""A corpus from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortkit.llm.exact_dedup import drop_exact_duplicates
from cohortkit.llm.jaccard_join import Likeness, drop_near_duplicates
from cohortkit.llm.mixing import mix_sources, take
from cohortkit.llm.packing import pack_documents
from cohortkit.llm.queries import tokenizer_file
from cohortkit.llm.ship import ship
from cohortkit.llm.toxicity import fit_toxicity, keep_clean
from cohortkit.sources import cut_lineage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    ship(spark)
    return keep_clean(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets that are 0.8 alike."""
    ship(spark)
    return drop_near_duplicates(docs, Likeness(5, 80, 100))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take(docs, mix_sources(docs, (5, 2, 1), 1.5, 2))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    ship(spark)
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), 2).drop("tokens")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# A classifier, Newton steps and a tokenizer are beyond SQL; tests/llm compares
# the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
