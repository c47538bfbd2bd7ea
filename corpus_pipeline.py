"""A cleaning pipeline over ``documents``: five stages, each written as Parquet and read by the next.

Language identification drops what it rejects, then exact copies, near
duplicates and repeated passages go, and what remains is packed into token
sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import _base, exact_dedup, language_id, near_dedup, packing, repeats


def _rested(stage):
    """``stage``, begun when executors have given back what the stages before it needed."""

    @wraps(stage)
    def inner(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _base.release(spark)
        return stage(spark, docs, sf_dir)

    return inner


@_rested
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some learned language is near to (operator 9).

    Null texts, empty ones and those without a letter go. Repeated rows and
    null doc_ids are judged as they come, very long texts whole; columns may
    have any names; an empty table gives no rows.
    """
    return language_id.accepted(docs, language_id.fit(language_id.training(docs)))


@_rested
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each distinct text, that with the smallest doc_id (operator 1).

    A null text is a copy of an empty one; a null doc_id stays only where no
    row of the text has one; of rows that repeat doc_id and text one stays.
    Very long texts are compared whole; columns may have any names; an empty
    table gives no rows.
    """
    return exact_dedup.exact_dedup(docs)


@_rested
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near duplicates, that with the smallest doc_id (operator 7).

    Null, empty and blank texts stay. A row is judged by its own text, so
    rows that share its doc_id, or have none, do not go with it. Very long
    texts are read whole; columns may have any names; an empty table gives no rows.
    """
    return near_dedup.near_dedup(docs)


@_rested
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 bytes or more that an earlier one has (operator 10).

    Null texts stay null and may be the result of no cut; a null doc_id is
    later than all others; rows of one doc_id do not cut each other. Very long
    texts are read whole; columns may have any names; an empty table gives no rows.
    """
    out = repeats.remove_repeats(docs)
    return out.select(*[f"`{c.replace('`', '``')}`" for c in docs.columns])


@_rested
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 (operator 6).

    A null or empty text is its end token alone. Repeated rows and null
    doc_ids are packed as they come, very long texts whole; columns besides
    doc_id and text are ignored; an empty table gives no rows.
    """
    return packing.digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: Languages, near duplicates and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each one's docstring says what it does with odd rows."""
    docs = _base.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _base.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
