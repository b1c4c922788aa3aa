"""A training-text pipeline: five of the numbered operators, one after the other, over whole documents.

``run(spark, sf_dir)`` reads ``documents``, and each stage works on all rows that
the stage before wrote. Stages return the columns of documents; the last one
returns the packed pieces. Stage tables go to the shared folder, so a lost
executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exactdedup, langid, mixing, packing, simhash
from tidemark.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: ``und`` and undecided ones go.

    Null, empty and letterless texts are ``und``. Rows are judged one by one, repeated ones each; null ids and sources stay.
    """
    packed = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    found = langid.identify(packed, keep=["_row"])
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.LEAST_SCORE))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the one of the largest id, null ids last.

    Null and empty texts are equal. Of rows that repeat an id and a text one stays.
    """
    return exactdedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one of the smallest id, null ids last.

    Blank texts have fingerprint zero and link like any other. Of rows that repeat an id and a text one stays.
    """
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them.

    Null is a source of its own, the last one. Blank texts have no words and are not taken. Ranks come from id and text, so
    reruns agree; rows that are alike in both are documents of their own, and come as often as they are taken together.
    """
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences.

    Null and empty texts are one end token. Repeated rows are packed each; the numbers of sequences carry no meaning.
    """
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: The stages need trained weights, XXH64 fingerprints and token ids, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
