"""The training-data pipeline: documents to packed sequences, a stage at a time.

A stage takes (spark, docs, sf_dir) and works on everything that the stage before it kept. All but the last return
the columns of `documents`. Models and rules are fitted to labelled rows of the stage's own input.

Cases: an empty table gives no rows at any stage; null and empty texts go with the first stage, as no language can be
told; repeated rows are one row after the third; rows with null doc_ids are documents like others; extra columns are
carried along; very long texts count whole at every stage; ties (of similarity, score or length) are settled by the
operators, alike for any partitioning, but for the sequence numbers, which follow the partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import langid, neardup, packing, quality, suffixes
from tidewell.llm.common import Scratch, scope
from tidewell.llm.queries import table, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; those that it rejects go: null, empty and letterless texts, unsure and
    unfamiliar ones. Without any labelled row no language is known and all go. Repeated rows fare alike."""
    made = ("__language", "__score", "__rejected")
    return langid.identify(docs, langid.fit(docs), keep=docs.columns, made=made).where(~F.col(made[2])).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep. Null and empty texts fail the base rule; without labels
    only the base rule counts; repeated rows fare alike."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the smallest doc_id (nulls last); of repeated rows
    one stays; texts without words have no copies and stay."""
    return neardup.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur more than once. Null texts stay null, a text that repeats wholly becomes
    empty, a character that a string covers in part stays; no row goes."""
    return suffixes.dedup_texts(docs, size="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048. A null or empty text is one piece with only its end id."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 2048, 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("packed", packed),
]

#: SQL can express neither the learned stages nor tokenisation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`. A stage's input and the operators' own tables go once its output is written."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        with scope():
            docs = scratch.table(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
