"""The corpus pipeline: language ID, near-duplicate removal, repeated passages, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenquery.llm.decontaminate import decontaminate
from lumenquery.llm.io import cut, table
from lumenquery.llm.lang_id import keep_accepted
from lumenquery.llm.mixing import mix
from lumenquery.llm.near_dup import keep_one_each
from lumenquery.llm.substring_dedup import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; rejected ones go."""
    return keep_accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return keep_one_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words that repeated 35-word windows cover; texts that lose none stay as they are."""
    out = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and for which shards."""
    return mix(docs)


STAGES = [
    ("language_id", language),
    ("near_dup", near_duplicates),
    ("substring_dedup", passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Language ID, substring removal and alignment aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs.withColumn("shards", F.transform("shards", lambda x: x["shard"])) if "shards" in docs.columns else docs
