"""Catalogue operators: statistics, work queues, people, resolution, integrity and the date tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_sha256, is_uuid


def library_stats(assets: DataFrame, embedded: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row of counts, bytes and the range of times (AG1, J9): two left joins with distinct right sides."""
    e = embedded.select("asset_id").distinct().withColumn("__e", F.lit(True))
    s = scanned.select("asset_id").distinct().withColumn("__s", F.lit(True))
    a = assets.join(e, "asset_id", "left").join(s, "asset_id", "left")
    return a.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("mime_type").startswith("image/")).alias("images"), F.count_if(F.col("mime_type").startswith("video/")).alias("videos"), F.count_if(F.col("latitude").isNotNull()).alias("located"),
        F.count_if("__e").alias("embedded"), F.count_if("__s").alias("scanned"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.min("date_taken").alias("first_taken"), F.max("date_taken").alias("last_taken"),
    )


def queue(items: DataFrame, done: DataFrame, key: str = "asset_id") -> DataFrame:
    """Items without a row in done, by id: a resumable work queue (J3 to J6, K5, ST1)."""
    return items.join(done.select(key), key, "left_anti").orderBy(key)


def persons(people: DataFrame, faces: DataFrame) -> DataFrame:
    """person_id, name, n_faces and cover face of people with faces, most faces first (J10, AG3, AG4)."""
    per = faces.where("person_id is not null").groupBy("person_id").agg(F.count(F.lit(1)).alias("n_faces"), F.min_by("face_id", F.struct(-F.col("score"), "face_id")).alias("cover_face"))
    return people.where("merged_into is null").join(per, "person_id").select("person_id", "name", "n_faces", "cover_face").orderBy(F.desc("n_faces"), "person_id")


def faces_of(person_id: int, faces: DataFrame, assets: DataFrame) -> DataFrame:
    """Faces of a person with their asset, best score first."""
    return faces.where(F.col("person_id") == person_id).join(assets, "asset_id").orderBy(F.desc("score"), "face_id")


def people_in(asset_id: int, faces: DataFrame, people: DataFrame) -> DataFrame:
    """People of one asset in the order of their best face (J12, API3)."""
    best = faces.where((F.col("asset_id") == asset_id) & F.col("person_id").isNotNull()).groupBy("person_id").agg(F.max("score").alias("score"))
    return best.join(people.select("person_id", "name"), "person_id").orderBy(F.desc("score"), "person_id")


def resolve(assets: DataFrame, needle: str) -> DataFrame:
    """The assets that a needle names: an id, else a hash of 64 digits, else a path or file name.

    More than one row is an ambiguity, which the caller reports.
    """
    n = F.lit(needle)
    named = (F.col("storage_path") == n) | (F.col("original_filename") == n)
    return assets.where(F.when(is_uuid(n), F.col("id") == F.lower(n)).when(is_sha256(n), F.col("hash") == F.lower(n)).otherwise(named))


def import_outcomes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming(key, hash) with outcome imported or duplicate: the first of a new hash is imported (SNK1, AG18)."""
    known = stored.select("hash").distinct().withColumn("__known", F.lit(True))
    first = incoming.groupBy("hash").agg(F.min("key").alias("__first"))
    out = incoming.join(first, "hash").join(known, "hash", "left")
    return out.select("key", "hash", F.when(F.col("__known").isNull() & (F.col("key") == F.col("__first")), "imported").otherwise("duplicate").alias("outcome"))


def verify(rows: DataFrame, files: DataFrame) -> DataFrame:
    """key and state: ok, corrupt (hash differs), missing (no file) or orphan (no row) (J24, ALG19)."""
    a, b = rows.select("key", F.col("hash").alias("h1"), F.lit(1).alias("l")), files.select("key", F.col("hash").alias("h2"), F.lit(1).alias("r"))
    state = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "orphan").when(F.col("h1") != F.col("h2"), "corrupt").otherwise("ok")
    return a.join(b, "key", "full").select("key", state.alias("state"))


def date_tree(assets: DataFrame) -> DataFrame:
    """year, month, name, id: later rows of one name in a month get the id's start before the extension (AG20, W11)."""
    at = F.coalesce("date_taken", "imported_at")
    t = assets.withColumn("year", F.year(at)).withColumn("month", F.month(at))
    again = F.row_number().over(Window.partitionBy("year", "month", "name").orderBy(at, "id")) > 1
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    return t.select("year", "month", "id", F.when(again, F.concat(stem, F.lit("-"), F.substring(F.col("id").cast("string"), 1, 8), ext)).otherwise(F.col("name")).alias("name"))


def page(assets: DataFrame, number: int, per_page: int = 48, order: Column | None = None) -> DataFrame:
    """One page, newest first."""
    by = [F.desc("imported_at"), F.col("asset_id")] if order is None else [order, F.col("asset_id")]
    return assets.orderBy(*by).offset(max(0, number - 1) * per_page).limit(per_page)


def removal_manifest(assets: DataFrame, faces: DataFrame) -> DataFrame:
    """asset_id and every path that goes with an asset: file, thumbnails, playback copy, face crops (ALG20)."""
    hh = F.concat_ws("/", F.substring("hash", 1, 2), F.substring("hash", 3, 2), F.col("hash"))
    own = assets.select("asset_id", F.explode(F.array(F.col("storage_path"), F.concat(F.lit(".thumbs/s/"), hh, F.lit(".jpg")), F.concat(F.lit(".thumbs/m/"), hh, F.lit(".jpg")), F.concat(F.lit(".playback/"), hh, F.lit(".mp4")))).alias("path"))
    crops = faces.join(assets.select("asset_id"), "asset_id", "left_semi").select("asset_id", F.concat(F.lit(".faces/"), F.col("face_id").cast("string"), F.lit(".jpg")).alias("path"))
    return own.unionByName(crops)
