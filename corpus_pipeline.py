"""A corpus cleaned in stages: each reads what the one before it kept, and is written as a table of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quireworks.llm import decontam, dedup, ngram_join, packing, toxicity
from quireworks.llm.common import STAGED, discard_since, stage
from quireworks.llm.queries import table, tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled rows of these documents, does not reject.

    Null and empty texts, null ids and repeated rows are scored like any other; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (null counts as empty) that with the smallest id; of repeated rows, one."""
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the smallest id; texts without words and rows with a null id stay."""
    return ngram_join.one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows with a null id stay, and all do if the benchmark is empty."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their ids; an empty text is its end alone, an empty table has no pieces."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_duplicates", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The stages learn a classifier, hash and tokenise, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, whatever their further columns; returns the last stage's rows.

    Each stage's table replaces the one before it in the shared folder; what stages wrote for themselves goes, too.
    """
    docs, mark = table(spark, sf_dir, "documents"), len(STAGED)
    for name, step in STAGES:
        docs, at = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        discard_since(spark, mark, at)
    return docs
