"""Store operators: each takes tables and returns the tables after the change (SNK1 to SNK13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Rows of updates replace those of their key (SNK2, SNK11)."""
    return table.join(updates.select(*key).distinct(), key, "left_anti").unionByName(updates)


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of new keys are appended, the first by order of each (SNK1, S6)."""
    first = Window.partitionBy(*key).orderBy(order)
    new = rows.join(table.select(*key), key, "left_anti").withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    return table.unionByName(new)


def replace_children(table: DataFrame, rows: DataFrame, owners: DataFrame, key: str = "asset_id") -> DataFrame:
    """All rows of the owners go, theirs in rows come: also where rows has none (SNK3 to SNK5)."""
    return table.join(owners.select(key).distinct(), key, "left_anti").unionByName(rows)


def with_sentinel(scenes: DataFrame, owners: DataFrame) -> DataFrame:
    """Scene rows without negative times, and one row of -1 per owner that was looked at (SNK4, ST2)."""
    return scenes.where("ts_secs >= 0").unionByName(owners.select("asset_id", F.lit(-1.0).alias("ts_secs")))


def scene_lists(scenes: DataFrame) -> DataFrame:
    """asset_id and scenes in order; an empty list is one shot, no row is never looked at (SRC19, G17)."""
    return scenes.groupBy("asset_id").agg(F.array_sort(F.filter(F.collect_list("ts_secs"), lambda x: x >= 0)).alias("scenes"))


def point_update(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-null values of updates take the place of the columns' (SNK7)."""
    u = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = table.join(u, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete_cascade(ids: DataFrame, tables: dict[str, DataFrame], key: str = "asset_id") -> dict[str, DataFrame]:
    """Every table without the rows of the ids (SNK8)."""
    return {n: t.join(ids.select(key), key, "left_anti") for n, t in tables.items()}


def assign_faces(faces: DataFrame, assignments: DataFrame) -> DataFrame:
    """assignments(face_id, person_id, source): a user's always count, automatic ones only where none of a user stands (SNK9)."""
    a = assignments.select("face_id", F.col("person_id").alias("__p"), F.col("source").alias("__s"))
    wins = F.col("__s").isNotNull() & ((F.col("__s") == "user") | (F.col("assignment_source") != "user") | F.col("assignment_source").isNull())
    out = faces.join(a, "face_id", "left").withColumn("person_id", F.when(wins, F.col("__p")).otherwise(F.col("person_id"))).withColumn("assignment_source", F.when(wins, F.col("__s")).otherwise(F.col("assignment_source")))
    return out.select(*faces.columns)


def reject_faces(faces: DataFrame, rejections: DataFrame) -> DataFrame:
    """Faces whose person is the rejected one lose it and become automatic again (SNK10)."""
    r = rejections.select(F.col("face_id").alias("__f"), F.col("person_id").alias("__p")).distinct().withColumn("__hit", F.lit(True))
    out = faces.join(r, (F.col("face_id") == F.col("__f")) & (F.col("person_id") == F.col("__p")), "left")
    return out.withColumn("person_id", F.when(~F.coalesce("__hit", F.lit(False)), F.col("person_id"))).withColumn("assignment_source", F.when(F.col("__hit"), "auto").otherwise(F.col("assignment_source"))).select(*faces.columns)


def canonical_links(links: DataFrame) -> DataFrame:
    """One row per undirected pair, the latest (by seq) kind counts; self-links go (SNK11, X45)."""
    c = links.where("face_a <> face_b").select(F.least("face_a", "face_b").alias("face_a"), F.greatest("face_a", "face_b").alias("face_b"), "must_link", "seq")
    return c.groupBy("face_a", "face_b").agg(F.max_by("must_link", "seq").alias("must_link"))


def merge_persons(faces: DataFrame, persons: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """Faces of source go to target, and source points at it (SNK12)."""
    f = faces.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target)).otherwise(F.col("person_id")))
    return f, persons.withColumn("merged_into", F.when(F.col("person_id") == source, F.lit(target)).otherwise(F.col("merged_into")))
