"""A corpus pipeline over documents: toxicity, language, near-duplicates, personal data, packing.

Every stage reads the table that the stage before it wrote and works on all of it. All but the last return the columns of documents,
whatever further ones the table has, under any names.

Null and empty texts are not toxic, but are in no language, so the second stage drops them. Texts of any length are judged whole. Of
repeated rows, and of any group of near-duplicates, the one with the least doc_id stays (null ids last). Scores at the toxicity threshold
go. An empty table gives no rows; without labels no document is toxic, and without a row of known language there is no learned one and all go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import language, minhash, packing, personal, toxicity
from winnow.llm.common import cut, documents

ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier learns from the labelled documents of the stage's input."""
    return toxicity.keep(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no identified language go."""
    return language.keep(docs, language.train(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return minhash.survivors(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, and n_chars is that of the masked text."""
    return personal.redact(docs, personal.train(docs)).withColumn("n_chars", F.length("text").cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, in pieces that fill sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", clean), ("language", identified), ("near_duplicates", distinct), ("personal_data", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; every stage's result is written to the checkpoint folder and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
