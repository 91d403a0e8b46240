"""A corpus pipeline: documents in, token ids out, in five stages.

Each stage gets the rows that the one before kept, read back from Parquet, and returns the columns of ``documents``; the last
returns ids. Stages share no state but the tables of the folder.

In every stage a text of any length is one row's work, an empty table gives an empty result, and further columns, whatever their
names, stay as they are (the last stage leaves them out). What each does with nulls, empty texts, ties and repeated rows is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, mixing, quality_model, quality_rules, sentencepiece_bpe
from tidemark.llm.durable import save
from tidemark.llm.session import settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what a classifier, fitted on labelled documents outside the held-out fold, takes for label 0.

    Null and empty texts are scored like others; a score of 0.5 stays. Repeated rows stay or go together. Rows without an id
    are not learned from.
    """
    labels = settle(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return quality_model.passing(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what fails the base rules or lies outside the fences of its language and source.

    Null and empty texts fail. Null languages and sources are groups of their own; a value on a fence stays. Repeated rows stay or
    go together.
    """
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates (five words, 0.8).

    Null and empty texts are in no group and stay, as do rows without an id. Of rows alike in every column one stays; rows of one
    id with different texts stay or go together.
    """
    settle(spark)
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents for tempered source, language and topic margins.

    Null margins are a value of their own, null and empty texts weigh nothing. Rows of one id are drawn together, and those without
    one always.
    """
    return mixing.drawn(docs, power=0.9)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded text; null texts are empty, each row has its result."""
    settle(spark)
    return sentencepiece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), output="ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixture),
    ("SentencePiece", encode),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = settle(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
