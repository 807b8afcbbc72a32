"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on every row of docs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe as bpe
from . import decontaminate, near_dup
from . import secrets as secret_scan
from . import toxicity as toxic_text
from .common import table


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars of a text that a stage changed follows the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return toxic_text.reject(docs, toxic_text.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; documents without words are copies of nothing."""
    return near_dup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; a document that held nothing else goes."""
    return with_length(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return with_length(secret_scan.mask(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digests that show that they decode to it."""
    return bpe.round_trip(docs)
