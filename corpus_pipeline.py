"""A corpus from raw documents to token ids: each stage works on all that the one before it kept.

Every stage but the last returns the columns of ``documents``; the last one the ids of each document's text. In every stage
columns may be null, texts empty or of any length, and rows repeated; further columns of any name are kept by all stages but
the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import jaccard, langid, mixing, pieces, toxicity
from loomwork.llm.common import fold, settled, table
from loomwork.llm.queries import MIX_SHARE, mix_dimensions, model_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more; learns from labels of the documents at hand, as op10 does.

    Null and empty texts have the score of no terms; equal texts go or stay together. Without labels nothing is rejected.
    """
    labels = table(spark, sf_dir, "labels")
    return toxicity.clean_rows(docs, toxicity.train(docs, labels.where(fold("doc_id", 5) != 0)))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that fit none of the languages learned from the documents at hand.

    Null and empty texts have no letter; a null language is learned from by nobody; equal texts go or stay together.
    """
    return langid.identified_rows(docs, langid.profiles(docs.where(fold("doc_id", 3) != 1)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more.

    Documents without words, null and empty ones among them, are near nothing and stay, as do rows without an id. Of several
    rows of one id the first in the order of all columns stays.
    """
    return jaccard.one_of_each(docs, words=5, num=80, den=100)


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents towards tempered shares of sources, languages and topics.

    Null categories are one category; rows of one id, or without one, are drawn together. Null and empty texts have no tokens
    and the probability of their cell.
    """
    return mixing.mixed_rows(docs, mix_dimensions(), MIX_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of every row. Null and empty texts have no ids and decode to the empty text."""
    coded = pieces.encode_texts(docs, model_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("near_copies", drop_near_copies),
    ("mixing", draw_mixture),
    ("pieces", encode),
]

#: Models and similarity joins are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settled(docs)
    return docs
