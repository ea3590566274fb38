"""Photo metadata of hand-built files of both byte orders."""

import json
import struct

from pyspark.sql import functions as F

from lumenquery.sources import exif


def tiff(order, tags, exif_dir=(), gps=(), second=(), tail=b""):
    """A TIFF of directories given as (tag, kind, count, packed values) rows; a callable value gets the offset of tail."""
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    dirs = [list(tags), list(exif_dir), list(gps), list(second)]
    dirs[0] += [(34665, 4, 1, "exif"), (34853, 4, 1, "gps")]
    starts, at = [], 8
    for d in dirs:
        starts.append(at)
        at += 2 + 12 * len(d) + 4
    data_at, blob, out = at, b"", b""
    size = sum(len(v) for d in dirs for *_, v in d if isinstance(v, bytes) and len(v) > 4)
    for i, d in enumerate(dirs):
        out += struct.pack(order + "H", len(d))
        for tag, kind, count, v in d:
            v = {"exif": starts[1], "gps": starts[2]}.get(v, v) if isinstance(v, str) else v
            v = data_at + size if callable(v) else v
            v = struct.pack(order + "I", v) if isinstance(v, int) else v
            if len(v) > 4:
                ptr = struct.pack(order + "I", data_at + len(blob))
                blob += v
                v = ptr
            out += struct.pack(order + "HHI", tag, kind, count) + v.ljust(4, b"\0")
        out += struct.pack(order + "I", starts[3] if i == 0 and second else 0)
    return head + out + blob + tail


def photo(order):
    p = lambda code, *v: struct.pack(order + code, *v)
    return tiff(
        order,
        [(271, 2, 6, b"Canon\0"), (274, 3, 1, p("H", 6)), (50706, 1, 4, bytes([1, 4, 0, 0]))],
        [(33434, 5, 1, p("II", 1, 250)), (33437, 5, 1, p("II", 28, 10)), (34855, 3, 1, p("H", 400)), (36867, 2, 20, b"2024:05:01 10:20:30\0"), (37386, 5, 1, p("II", 50, 0)), (37500, 7, 6, b"secret")],
        [(1, 2, 2, b"S\0"), (2, 5, 3, p("IIIIII", 33, 1, 30, 1, 0, 1)), (3, 2, 2, b"E\0"), (4, 5, 3, p("IIIIII", 151, 1, 0, 1, 36, 1)), (5, 1, 1, b"\1"), (6, 5, 1, p("II", 25, 2))],
    )


def jpeg(block):
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", 8 + len(block)) + b"Exif\0\0" + block + b"\xff\xda\0\2"


def read(spark, *files):
    rows = [(i, None if data is None else bytearray(data)) for i, data in enumerate(files)]
    df = spark.createDataFrame(rows, "i int, content binary").coalesce(1).select("i", "content", exif.exif_tags("content").alias("tags"))
    return df.orderBy("i").select(exif.exif_fields(F.col("tags")).alias("f"), exif.upright_orientation(F.col("tags")).alias("up"), exif.jpeg_preview(F.col("content"), F.col("tags")).alias("preview")).collect()


def test_fields(spark):
    wraps = [lambda b: b, jpeg, lambda b: b"....ftypheic....Exif\0\0" + b]
    got = read(spark, *[wrap(photo(order)) for order in "<>" for wrap in wraps])
    assert len(got) == 6 and len(set(got)) == 1
    f, up = got[0].f, got[0].up
    assert (f.camera_make, f.shutter, f.iso, f.orientation, up) == ("Canon", "1/250", 400, 6, 6)
    assert str(f.date_taken) == "2024-05-01 10:20:30" and f.focal_length is None and abs(f.aperture - 2.8) < 1e-6
    assert (f.latitude, f.altitude) == (-33.5, -12.5) and abs(f.longitude - 151.01) < 1e-9
    raw = json.loads(f.exif_raw)
    assert raw["Make"] == "Canon" and raw["FNumber"] == "28/10" and "Tag(Tiff, 50706)" in raw and "MakerNote" not in raw


def test_unreadable_files_have_null_fields(spark):
    outside = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", 271, 2, 1 << 31, 9) + b"\0" * 4
    got = read(spark, None, b"", b"text", b"II*\0", photo("<")[:60], outside)
    assert len(got) == 6
    for r in got:
        assert all(v is None for v in r.f) and r.up is None and r.preview is None


def test_directories_that_point_at_each_other_end(spark):
    loop = b"II*\0" + struct.pack("<IHHHII", 8, 1, 271, 2, 2, 65) + struct.pack("<I", 8)
    assert read(spark, loop)[0].f.camera_make == "A"


def test_largest_preview(spark):
    p = lambda code, *v: struct.pack("<" + code, *v)
    small, large = b"\xff\xd8\xff small", b"\xff\xd8\xff larger"

    def dirs(w, first, second):
        strip = lambda size: [(256, 3, 1, p("H", w)), (257, 3, 1, p("H", 10)), (259, 3, 1, p("H", 7)), (273, 4, 1, lambda: 0), (279, 4, 1, p("I", size))]
        far = [(256, 3, 1, p("H", 20)), (257, 3, 1, p("H", 10)), (259, 3, 1, p("H", 7)), (513, 4, 1, 0), (514, 4, 1, p("I", len(second)))]
        blank = tiff("<", strip(len(first)), second=far, tail=first + second)
        at = len(blank) - len(second)
        far[3] = (513, 4, 1, at)
        return tiff("<", strip(len(first)), second=far, tail=first + second)

    got = read(spark, dirs(10, small, large), dirs(20, small, large), dirs(90, small, large), dirs(10, small, b"no picture"))
    # a tie goes to the earlier directory; the largest is taken though it's no picture
    assert [r.preview and bytes(r.preview) for r in got] == [large, small, small, None]


def test_photo_folder(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(photo("<")))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2")
    got = {r.original_filename: r.camera_make for r in exif.photo_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": "Canon", "b.jpg": None}
