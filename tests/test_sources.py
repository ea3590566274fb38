"""Readers and streaming jobs on small files."""

import json

from pyspark.sql import functions as F

from lumenquery.sources import readers
from lumenquery.streaming import jobs


def test_media_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(bytes.fromhex("FFD8FFE0") + b"x" * 20)
    (tmp_path / "sub/b.bin").write_bytes(b"\0\0\0\x18ftypisom" + b"x" * 20)
    (tmp_path / "c.jpg").write_text("not a picture")
    got = {r.original_filename: r.mime_type for r in readers.media_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "image/jpeg", "b.bin": "video/mp4"}


def test_geonames(spark, tmp_path):
    line = lambda i, n, la, lo, cc, a: "\t".join([str(i), n, n, "", str(la), str(lo), "P", "PPL", cc, "", a])
    (tmp_path / "c.txt").write_text("\n".join([line(1, 'Dal"housie', 32.5, 75.9, "IN", "11"), line(2, "San Francisco", 37.7, -122.4, "US", "CA")]))
    (tmp_path / "a.txt").write_text("IN.11\tHimachal Pradesh\nUS.CA\tCalifornia\n")
    (tmp_path / "k.txt").write_text("#comment\nIN\tIND\t356\tIN\tIndia\n")
    assert readers.geonames_cities(spark, str(tmp_path / "c.txt")).count() == 2
    assert readers.geonames_regions(spark, str(tmp_path / "a.txt")).where("cc = 'US'").first()["name"] == "California"
    assert [r.name for r in readers.geonames_countries(spark, str(tmp_path / "k.txt")).collect()] == ["India"]


def test_captions(spark, tmp_path):
    (tmp_path / "c.csv").write_text('filename,raw\na.jpg,"[""one"", ""two""]"\n')
    assert [(r.n, r.caption) for r in readers.captions(spark, str(tmp_path / "c.csv")).collect()] == [(0, "one"), (1, "two")]


def test_probe(spark):
    doc = {"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "side_data_list": [{"rotation": -90}]}], "format": {"duration": "12.5", "tags": {"location": "+28.6+077.2/", "creation_time": "2024-05-01T10:00:00Z"}}}
    p = spark.createDataFrame([(json.dumps(doc),)], "d string").select(readers.video_probe(F.col("d")).alias("p")).first()["p"]
    assert (p.codec, p.width, p.height, p.duration) == ("h264", 1080, 1920, 12.5) and p.location.lat == 28.6


def test_backfill_runs_once(spark, tmp_path):
    src, led, res, ck = (str(tmp_path / x) for x in ("src", "ledger", "results", "ck"))
    spark.range(5).withColumnRenamed("id", "asset_id").write.parquet(src)
    work = lambda df: df.withColumn("n", F.col("asset_id") * 2)
    run = lambda: jobs.backfill(spark.readStream.schema("asset_id long").parquet(src), led, res, work, ck).awaitTermination()
    run()
    spark.range(3, 8).withColumnRenamed("id", "asset_id").write.mode("append").parquet(src)
    run()
    assert sorted(r.asset_id for r in spark.read.parquet(res).collect()) == list(range(8))
    assert spark.read.parquet(led).count() == 8


def test_distinct_arrivals(spark, tmp_path):
    rows = [("h1", "2024-01-01 00:00:00"), ("h1", "2024-01-01 00:05:00"), ("h2", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "hash string, t string").select("hash", F.to_timestamp("t").alias("arrived")).write.parquet(str(tmp_path / "s"))
    q = jobs.distinct_arrivals(spark.readStream.schema("hash string, arrived timestamp").parquet(str(tmp_path / "s"))).writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.hash for r in spark.table("arrivals").collect()) == ["h1", "h2"]
