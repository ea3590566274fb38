"""The driver's tables and the catalogue views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """All tables as temporary views for spark.sql (SRC1)."""
    for n in NAMES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, vector, label: one vector per asset."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("embedding").alias("vector"), "label")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, ts_secs, vector: five vectors per video."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("asset_id"), (F.col("vec_id") % 5).cast("double").alias("ts_secs"), F.col("embedding").alias("vector"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """face_id, asset_id, person_id (null when unassigned), score, vector, assignment_source."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("face_id"), F.expr("vec_id div 3").alias("asset_id"), F.when(F.col("vec_id") % 3 == 0, F.col("label").cast("long")).alias("person_id"), (F.lit(0.5) + (F.col("vec_id") % 50) / 100.0).alias("score"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 2 == 0, "auto").otherwise("user").alias("assignment_source")
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, ts_secs, end_secs, text: one segment per turn."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset_id"), (F.col("turn") * 5.0).alias("ts_secs"), (F.col("turn") * 5.0 + 5.0).alias("end_secs"), "text")
