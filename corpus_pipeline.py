"""Corpus pipeline: toxicity, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir), docs being what the stage before
left, and returns a DataFrame; all but the last keep the columns of documents.
An empty table passes through every stage as an empty one, texts of any length
are read whole, and further columns, whatever their names, are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from sievework.llm.common import shared_folder, table
from sievework.llm.queries import MIX, NEAR_N, NEAR_THRESHOLD


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier, trained on the labelled ones, doesn't reject.

    Each row is judged by itself, so repeated rows fare alike; a null or empty
    text has the bias alone for evidence, and null ids stay. A score that
    equals the threshold is kept. Without labels nothing goes.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of those with equal texts.

    Null texts and null ids are no one's copies and stay, empty texts are
    equal to each other; rows that repeat an id and its text stay together.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of those that links of J >= NEAR_THRESHOLD connect.

    Ties at the threshold are links. Null texts, null ids and texts without
    words stay; of rows that repeat an id the largest set speaks for it.
    """
    return jaccard_join.drop_near_duplicates(docs, NEAR_THRESHOLD, NEAR_N)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by the budgets of MIX, once for each epoch that uses them.

    Null ids are left out; a null language or source is a leaf of its own;
    null and empty texts cost nothing. Ties in the seeded order go by id.
    """
    return mixing.mixed(docs, MIX).select("row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, repeated rows each; see ``bpe.encode`` for null and empty texts."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("BPE encoding", encode_tokens),
]

# Training a classifier, connected components and byte-pair encoding can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
