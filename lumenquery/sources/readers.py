"""Readers of media folders, gazetteers, captions, probes and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import display_size, parse_iso6709, parse_rational

# Leading bytes (hexadecimal, offset) that tell a file's type.
MAGIC = [
    ("FFD8FF", 0, "image/jpeg"), ("89504E470D0A1A0A", 0, "image/png"), ("47494638", 0, "image/gif"), ("424D", 0, "image/bmp"), ("49492A00", 0, "image/tiff"), ("4D4D002A", 0, "image/tiff"),
    ("57454250", 8, "image/webp"), ("6674797068656963", 4, "image/heif"), ("667479706D696631", 4, "image/heif"), ("6674797061766966", 4, "image/avif"), ("667479707174", 4, "video/quicktime"), ("66747970", 4, "video/mp4"), ("1A45DFA3", 0, "video/webm"), ("41564920", 8, "video/x-msvideo"),
]


def sniff_mime(content: Column) -> Column:
    """Type by the first bytes, never by the name; null when unknown (SRC5)."""
    head = F.hex(F.substring(content, 1, 512))
    out = F.lit(None).cast("string")
    for magic, offset, mime in reversed(MAGIC):
        out = F.when(F.substring(head, 2 * offset + 1, len(magic)) == magic, mime).otherwise(out)
    return out


def media_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, file_size, mime_type, hash and name of every image and video below path (SRC3, SRC5, X14)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(path)
    out = files.select("path", F.col("length").alias("file_size"), sniff_mime(F.col("content")).alias("mime_type"), F.sha2("content", 256).alias("hash"), F.regexp_extract("path", "([^/]*)$", 1).alias("original_filename"), F.col("modificationTime").alias("imported_at"))
    return out.where(F.col("mime_type").rlike("^(image|video)/"))


def geonames_cities(spark: SparkSession, path: str) -> DataFrame:
    """line_no (file order), place, lat, lon, cc and admin1 of a tab-separated city file (SRC10)."""
    rows = spark.read.option("sep", "\t").option("quote", "").csv(path)
    order = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    return rows.select(order["col2"].alias("line_no"), F.col("_c1").alias("place"), F.col("_c4").cast("double").alias("lat"), F.col("_c5").cast("double").alias("lon"), F.col("_c8").alias("cc"), F.col("_c10").alias("admin1")).where("lat is not null and lon is not null")


def geonames_regions(spark: SparkSession, path: str) -> DataFrame:
    """cc, admin1 and name of a region file, whose codes read CC.CODE."""
    rows = spark.read.option("sep", "\t").option("quote", "").csv(path)
    return rows.select(F.split_part("_c0", F.lit("."), F.lit(1)).alias("cc"), F.split_part("_c0", F.lit("."), F.lit(2)).alias("admin1"), F.col("_c1").alias("name"))


def geonames_countries(spark: SparkSession, path: str) -> DataFrame:
    """cc and name of a country file; lines that start with # are comments."""
    rows = spark.read.option("sep", "\t").option("quote", "").option("comment", "#").csv(path)
    return rows.select(F.col("_c0").alias("cc"), F.col("_c4").alias("name"))


def captions(spark: SparkSession, path: str) -> DataFrame:
    """filename, n and caption of a CSV whose raw column is a JSON list of strings (SRC12)."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = {"filename", "raw"} - set(rows.columns)
    if missing:
        raise ValueError(f"caption file without {sorted(missing)}")
    return rows.select("filename", F.posexplode(F.from_json("raw", "array<string>")).alias("n", "caption"))


PROBE = "streams array<struct<codec_type:string,codec_name:string,width:bigint,height:bigint,avg_frame_rate:string,tags:map<string,string>,side_data_list:array<struct<rotation:int>>>>, format struct<duration:string,tags:map<string,string>>"


def video_probe(doc: Column) -> Column:
    """Fields of a probe document: the first video stream, rotation applied (SRC9, X6 to X8)."""
    p = F.from_json(doc, PROBE)
    v = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), 0)
    turn = F.coalesce(F.get(F.filter(F.transform(v["side_data_list"], lambda s: s["rotation"]), lambda r: r.isNotNull()), 0), v["tags"]["rotate"].try_cast("int"))
    size = display_size(v["width"], v["height"], turn)
    tags = p["format"]["tags"]
    at = parse_iso6709(F.coalesce(tags["location"], tags["com.apple.quicktime.location.ISO6709"]))
    return F.when(v.isNotNull(), F.struct(v["codec_name"].alias("codec"), size["width"].alias("width"), size["height"].alias("height"), p["format"]["duration"].try_cast("double").alias("duration"), parse_rational(v["avg_frame_rate"]).alias("fps"), at.alias("location"), F.try_to_timestamp(tags["creation_time"]).alias("created")))
