"""A training-data pipeline over `documents`: five stages, each written and read again.

Every stage takes any rows of the columns of `documents`, with more columns if there are
any, whatever their names, and returns them as they came but for what it decides:

- Rows that repeat a doc_id, or have none, are judged each on its own text; only line
  dedup counts rows of one doc_id as one document, and of rows with equal doc_id and text
  the near-duplicate stage keeps one.
- Null, empty and blank texts and texts without a letter have no language and go in the
  first stage; each later stage would keep them.
- A null lang is not learned from; a null source is a source of its own.
- Ties: the smallest doc_id of a group stays, the largest keeps a repeated line, and
  copies go to the first in the order of a hash.
- An empty table gives an empty table with the stage's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planisphere.llm import decontaminate, language, line_dedup, mixing, near_dedup
from planisphere.llm.common import stage, table

#: Near copies have at least this similarity in per cent of shingles: the rule for stages without a contract of their own.
SIMILAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those rejected go."""
    return language.retain(docs, language.fit(docs.select("doc_id", "text", "lang")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines, and n_chars to match; documents that lose all their lines go."""
    return line_dedup.drop_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_copies(docs, percent=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes: the document's columns, then size, target, rate, copies and copy, its number."""
    return mixing.mix_copies(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_stage),
]
#: Signatures and trained centroids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage_{k}")
    return docs
