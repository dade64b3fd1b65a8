"""A corpus from documents: language ID, exact and near duplicates, source mixing, tokens.

Every stage takes a table of any size with at least the columns of ``documents``, keeps other
columns whatever their names (the last gives its own), reads texts of any length whole, and
gives an empty table for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, langid, mixing, ngram_join
from tessera.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is fitted on labelled rows of ``docs``.

    Null and empty texts, and those without a word, have no language and go; null ids and
    languages are scored like others but not learnt from; repeated rows stay or go together.
    Without a labelled row nothing is recognised.
    """
    return langid.accept(docs, langid.fit(langid.training_counts(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the least id, an id before none.

    Null texts equal nothing and stay; empty ones equal each other; of repeated rows one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id.

    Rows of a null id, a null text or a text without words are in no group and stay; rows of one
    id are one document.
    """
    return ngram_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as come in, in the target proportions of sources.

    A null source is a source of its own, a null length counts as 0, null ids are ordered as '';
    rows that tie are taken in order of their columns' hash. A row comes as often as it is drawn.
    """
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and offsets of each row, repeated ones included: nulls for a null text, empty arrays for an empty one."""
    return bpe.encode(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("byte-level BPE", tokens)]

#: Language ID has no SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, _ = written(docs, name.replace(" ", "_"))
    return docs
