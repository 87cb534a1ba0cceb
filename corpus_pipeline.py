"""The corpus pipeline: five stages, each one of the training-data operators at work on all that the stage before kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.llm import decontamination, language, line_dedup, minhash, packing
from trustmill.llm.shared import materialize, table

#: Least posterior of the predicted language.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those for which no language stands out, go."""
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called, they can't clash
    found = language.predict(docs, model).toDF(*names, "predicted", "posterior")
    return found.filter((F.col("predicted") != language.UNDETERMINED) & (F.col("posterior") >= MIN_LANGUAGE_SCORE)).select(*names).toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and with them the documents of which nothing else is left."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return packing.pack(docs, capacity=2048, end_id=0, payload={"ids_crc32": F.crc32("ids")})


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: A trained model, connected components and a genetic algorithm are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
