"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents, and other columns of any names that come with them.

Rows with null ids pass every stage on their texts alone and stay in the fourth; rows that repeat an id are judged each by its
own text, and are packed each as a document of its own; null and empty texts have no language and go in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import materialise, scope, table
from tessera.llm.exact_dedup import drop_copies
from tessera.llm.jaccard_join import one_of_each
from tessera.llm.language import keep_known
from tessera.llm.packing import pack
from tessera.llm.toxicity import keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (7): documents whose score is 0.5 or more go; null and empty texts stay."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (8): documents without a letter, or whose best language scores under 0.5, go."""
    return keep_known(docs, docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (10): of equal texts the one with the largest id stays."""
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (2): of each component the document with the smallest id stays; null ids stay."""
    return one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (9): pieces and their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language-id", drop_unknown_language),
    ("exact-dedup", drop_exact_copies),
    ("jaccard-join", drop_near_copies),
    ("packing", pack_sequences),
]

#: Trained models and a tokenizer are not SQL; tests hold run() against the stages' operators and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written out and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scope(spark):  # what a stage has written for itself goes with it
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
    return docs
