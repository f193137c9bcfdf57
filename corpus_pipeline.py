"""The training-data pipeline: each stage takes a table of documents and gives the next one's.

A stage returns a DataFrame that is written and read again before the next one; all but the last return the
columns of documents.  Rows without an id count as documents of their own where a stage judges single rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarium.llm import language, near, packing, substring, toxicity
from scalarium.llm.tables import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents whose language is less sure than this are rejected, and those without any.
LEAST_SURE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: not `und`, and sure enough.

    A null text, an empty one and one without letters go; repeated rows and rows without an id are judged by their texts
    like all others.  Nothing learned (an empty table, no languages) keeps nothing.
    """
    return language.known(docs, language.train(docs), LEAST_SURE)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't predicted to be toxic.

    A null or empty text has the score of no features; repeated rows have one score, and rows without an id, which have
    no labels, are judged like all others.  Without labels of both kinds nothing is predicted beyond the share of toxic ones.
    """
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class, that of the least id (rows without an id last), then text digest, then place.

    Each row is a document of its own here, whatever its id: repeated rows and copies without an id are of one class,
    and different texts that share an id are judged apart.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    classes = near.near_duplicates(rows, id_col="__row").select(F.col("doc_id").alias("__row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "__row")
    told = rows.select("__row", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest")).join(classes, "__row")
    kept = told.groupBy("class_id").agg(F.min(order).alias("least")).select(F.col("least.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; a text that has none stays as it is, to the byte."""
    return substring.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens.

    A null or empty text is a piece of its end token alone; repeated rows and rows without an id have pieces of their own.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("toxicity", reject_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Fitted models and signatures can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
