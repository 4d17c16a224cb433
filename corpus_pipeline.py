"""A training-data pipeline: five operators in a row over ``documents``, each over what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.common import stored, table
from panelwright.llm.near_copies import one_of_each
from panelwright.llm.packing import pack
from panelwright.llm.quality import keep_good
from panelwright.llm.suffix_dedup import keep_unrepeated
from panelwright.llm.toxicity import fitted, keep_clean

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The chain is fitted to the labelled ones among ``docs``."""
    return keep_clean(docs, fitted(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go; the cut-offs follow ``docs``."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id.

    Near copies share five-word shingles to a similarity of 0.8 or more. Their fingerprints give candidates by op9's
    method, whole shingle sets decide, and near copies whose fingerprints are too far apart are joined exactly. Rows that agree in id and text are one
    document; rows of one id with different texts are different ones. Rows without an id come after all others.
    """
    return one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur again go from the texts; documents of which nothing is left go."""
    return keep_unrepeated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands: bin, place in the bin, place in the document, words."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier, the hashes' graph or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; between stages rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
