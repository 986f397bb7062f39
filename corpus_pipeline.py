"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, token ids.

Every stage takes any table with the columns of ``documents`` and any others beside them, whatever their names; all
but the last return the columns that they got. An empty table passes through as an empty one. Texts are
processed whole, however long. Rows without a doc_id take part in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm.common import cut, load
from sextant.llm.line_dedup import line_dedup
from sextant.llm.mixing import mix_sources
from sextant.llm.near_dedup import near_dedup
from sextant.llm.pieces import encode_documents
from sextant.llm.quality_rules import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is too low, or that fail the base test, go.

    Null, empty and blank texts fail the base test. Repeated rows are judged alike. A posterior of exactly one half stays.
    """
    return quality_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line that several documents hold stays in the one with the smallest doc_id.

    A null text stays null. Rows that share doc_id and text lose the same lines; a document all of whose lines go has the empty
    text, with n_chars 0. Rows without a doc_id are one document, after all others.
    """
    return line_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id: five-word shingles, similarity 0.8 or more.

    Texts without words, null ones among them, are linked with nothing and stay. Of rows that share doc_id and text one stays.
    """
    return near_dedup(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times.

    Null sources are one source, the last; texts without words have size zero. Equal rows share the copies that all of them get.
    Reruns over the same rows take the same documents.
    """
    return mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text; a null or empty one has none. Repeated rows stay and are encoded alike."""
    return encode_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("pieces", encode)]

#: SQL can express neither the label model nor balanced sampling: tests hold the run against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``, each written as Parquet and read again as the next one's input."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
