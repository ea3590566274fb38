"""Photo metadata: one Arrow function lists the tags of a file, column functions read them."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.media import exif_timestamp, gps_decimal, shutter, signed_altitude
from .readers import media_folder

# Tag numbers and names of the format, by the directory they belong to.
NAMES = {
    "Tiff": {
        256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 270: "ImageDescription", 271: "Make", 272: "Model", 273: "StripOffsets", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip",
        279: "StripByteCounts", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 305: "Software", 306: "DateTime", 315: "Artist", 513: "JPEGInterchangeFormat", 514: "JPEGInterchangeFormatLength", 531: "YCbCrPositioning", 33432: "Copyright",
    },
    "Exif": {
        33434: "ExposureTime", 33437: "FNumber", 34850: "ExposureProgram", 34855: "PhotographicSensitivity", 34864: "SensitivityType", 34867: "ISOSpeed", 36864: "ExifVersion", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 36880: "OffsetTime", 36881: "OffsetTimeOriginal",
        37121: "ComponentsConfiguration", 37377: "ShutterSpeedValue", 37378: "ApertureValue", 37379: "BrightnessValue", 37380: "ExposureBiasValue", 37381: "MaxApertureValue", 37382: "SubjectDistance", 37383: "MeteringMode", 37384: "LightSource", 37385: "Flash", 37386: "FocalLength",
        37396: "SubjectArea", 37500: "MakerNote", 37510: "UserComment", 37520: "SubSecTime", 37521: "SubSecTimeOriginal", 40960: "FlashpixVersion", 40961: "ColorSpace", 40962: "PixelXDimension", 40963: "PixelYDimension", 41495: "SensingMethod", 41729: "SceneType",
        41985: "CustomRendered", 41986: "ExposureMode", 41987: "WhiteBalance", 41988: "DigitalZoomRatio", 41989: "FocalLengthIn35mmFilm", 41990: "SceneCaptureType", 42032: "CameraOwnerName", 42033: "BodySerialNumber", 42034: "LensSpecification", 42035: "LensMake", 42036: "LensModel",
    },
    "Gps": {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 12: "GPSSpeedRef", 13: "GPSSpeed", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 29: "GPSDateStamp", 31: "GPSHPositioningError"},
    "Interop": {1: "InteroperabilityIndex", 2: "InteroperabilityVersion"},
}
CHILDREN = {34665: "Exif", 34853: "Gps", 40965: "Interop"}
#: Size and struct code of the value kinds; the rationals (5, 10) hold two numbers each.
KINDS = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
_NUMBERS = T.ArrayType(T.LongType())
TAGS = T.ArrayType(T.StructType().add("ifd", "integer").add("name", "string").add("kind", "integer").add("text", "string").add("nums", _NUMBERS).add("dens", _NUMBERS))


def tiff_block(data: bytes) -> bytes | None:
    """The tag block of a file: all of a TIFF, a JPEG's APP1 segment, else what follows an Exif mark."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + max(size, 2)
        return None
    mark = re.search(rb"(?:Exif\0\0|eXIf|EXIF[\s\S]{4})(?=II\*\0|MM\0\*)", data)
    return data[mark.end() :] if mark else None


def tags_of(data: bytes | None) -> list[dict] | None:
    """All tags of the chain of directories and of their child directories; the first of equal tags counts.

    None where there is no block or an offset leads outside of it. MakerNote is left out.
    """
    block = tiff_block(data) if data else None
    if block is None or len(block) < 8:
        return None
    end = "<" if block[:2] == b"II" else ">"
    found: dict[tuple[int, str, int], dict] = {}
    seen: set[int] = set()
    todo = [(struct.unpack_from(end + "I", block, 4)[0], 0, "Tiff")]
    try:
        while todo:
            at, ifd, space = todo.pop(0)
            if at == 0 or at in seen:
                continue
            seen.add(at)
            (n,) = struct.unpack_from(end + "H", block, at)
            for row in range(at + 2, at + 2 + 12 * n, 12):
                tag, kind, count = struct.unpack_from(end + "HHI", block, row)
                if kind not in KINDS:
                    continue
                size, code = KINDS[kind]
                where = row + 8 if size * count <= 4 else struct.unpack_from(end + "I", block, row + 8)[0]
                if where + size * count > len(block):
                    return None
                if tag in CHILDREN and kind == 4 and count:
                    todo.append((struct.unpack_from(end + "I", block, where)[0], ifd, CHILDREN[tag]))
                elif (space, tag) != ("Exif", 37500) and (ifd, space, tag) not in found:
                    found[ifd, space, tag] = _entry(block, end, ifd, space, tag, kind, count, where, code)
            if space == "Tiff":
                todo.append((struct.unpack_from(end + "I", block, at + 2 + 12 * n)[0], ifd + 1, "Tiff"))
    except struct.error:
        return None
    return list(found.values())


def _entry(block: bytes, end: str, ifd: int, space: str, tag: int, kind: int, count: int, where: int, code: str) -> dict:
    name = NAMES[space].get(tag, f"Tag({space}, {tag})")
    nums: list[int] = []
    dens: list[int] = []
    if kind == 2:
        try:
            text = block[where : where + count].split(b"\0")[0].decode().strip()
        except UnicodeDecodeError:
            text = None
    elif kind == 7:
        text = "0x" + block[where : where + count].hex()
    else:
        values = struct.unpack_from(end + code * count, block, where)
        if len(code) == 2:
            nums, dens = list(values[::2]), list(values[1::2])
            text = ", ".join(f"{a}/{b}" for a, b in zip(nums, dens))
        else:
            nums = [] if code in "fd" else list(values)
            text = ", ".join(map(str, values))
    return {"ifd": ifd, "name": name, "kind": kind, "text": text, "nums": nums, "dens": dens}


@F.pandas_udf(TAGS)
def exif_tags(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in content:
        yield part.map(tags_of)


def _tag(tags: Column, name: str, kinds: tuple[int, ...], ifd: int = 0) -> Column:
    """The tag of that name, null where it is absent or of another kind."""
    t = F.get(F.filter(tags, lambda t: (t["ifd"] == ifd) & (t["name"] == name)), 0)
    return F.when(t["kind"].isin(*kinds), t)


def _ascii(tags: Column, name: str) -> Column:
    return _tag(tags, name, (2,))["text"]


def _unsigned(tags: Column, name: str) -> Column:
    return F.get(_tag(tags, name, (1, 3, 4))["nums"], 0)


def _ratio(tags: Column, name: str) -> tuple[Column, Column]:
    """First rational; null where its denominator is 0 (SRC24)."""
    t = _tag(tags, name, (5,))
    den = F.get(t["dens"], 0)
    return F.when(den != 0, F.get(t["nums"], 0)), F.when(den != 0, den)


def _quotient(tags: Column, name: str) -> Column:
    num, den = _ratio(tags, name)
    return num / den


def _degrees(tags: Column, name: str, negative: str) -> Column:
    t, ref = _tag(tags, name, (5,)), F.substring(_ascii(tags, name + "Ref"), 1, 1)
    part = [F.try_divide(F.get(t["nums"], i), F.get(t["dens"], i)) for i in range(3)]
    return F.when(ref != "", gps_decimal(*part, F.when(ref == negative, "S").otherwise("N")))


def exif_fields(tags: Column) -> Column:
    """Typed fields and the JSON tail of exif_tags; all null where there are no tags (SRC6, SRC7, SRC24, X9 to X12).

    The tail holds the tags of the first directory and its children by name, ASCII as it is,
    rationals as n/d, opaque bytes in hexadecimal; no units.
    """
    exposure = _ratio(tags, "ExposureTime")
    altitude_ref = F.get(_tag(tags, "GPSAltitudeRef", (1,))["nums"], 0)
    first = F.filter(tags, lambda t: (t["ifd"] == 0) & t["text"].isNotNull())
    raw = F.to_json(F.map_from_entries(F.array_sort(F.transform(first, lambda t: F.struct(t["name"].alias("key"), t["text"].alias("value"))))))
    fields = {
        "date_taken": exif_timestamp(_ascii(tags, "DateTimeOriginal")),
        "latitude": _degrees(tags, "GPSLatitude", "S"),
        "longitude": _degrees(tags, "GPSLongitude", "W"),
        "altitude": signed_altitude(_quotient(tags, "GPSAltitude"), F.coalesce(altitude_ref, F.lit(0))),
        "gps_direction": _quotient(tags, "GPSImgDirection"),
        "camera_make": _ascii(tags, "Make"),
        "camera_model": _ascii(tags, "Model"),
        "lens_make": _ascii(tags, "LensMake"),
        "lens_model": _ascii(tags, "LensModel"),
        "focal_length": _quotient(tags, "FocalLength").cast("float"),
        "focal_length_35mm": _unsigned(tags, "FocalLengthIn35mmFilm").cast("float"),
        "aperture": _quotient(tags, "FNumber").cast("float"),
        "shutter": shutter(*exposure),
        "iso": F.coalesce(_unsigned(tags, "PhotographicSensitivity"), _unsigned(tags, "ISOSpeed")).try_cast("int"),
        "orientation": _unsigned(tags, "Orientation").try_cast("smallint"),
        "exif_raw": raw,
    }
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def upright_orientation(tags: Column) -> Column:
    """1 to 8 held as SHORT or LONG, else null (SRC23)."""
    n = F.get(_tag(tags, "Orientation", (3, 4))["nums"], 0)
    return F.when(n.between(1, 8), n.try_cast("int"))


def jpeg_preview(content: Column, tags: Column) -> Column:
    """Bytes of the JPEG of most pixels that a directory with compression 7 points at; ties to the earlier (SRC8).

    Null where there is none, it is cut off, or it doesn't start as a JPEG does.
    """

    def first(name: str, ifd: Column) -> Column:
        t = F.get(F.filter(tags, lambda t: (t["ifd"] == ifd) & (t["name"] == name) & t["kind"].isin(3, 4)), 0)
        return F.get(t["nums"], 0)

    def candidate(ifd: Column) -> Column:
        strip = (first("StripOffsets", ifd), first("StripByteCounts", ifd))
        whole = strip[0].isNotNull() & strip[1].isNotNull()
        at = F.when(whole, strip[0]).otherwise(first("JPEGInterchangeFormat", ifd))
        size = F.when(whole, strip[1]).otherwise(first("JPEGInterchangeFormatLength", ifd))
        area = F.coalesce(first("ImageWidth", ifd), F.lit(0)).cast("double") * F.coalesce(first("ImageLength", ifd), F.lit(0))
        return F.when((first("Compression", ifd) == 7) & at.isNotNull() & (size > 0), F.struct(area.alias("area"), (-ifd).alias("rank"), at.alias("at"), size.alias("size")))

    best = F.array_max(F.transform(F.array_distinct(F.transform(tags, lambda t: t["ifd"])), candidate))
    inside = best["at"] + best["size"] <= F.length(content)
    jpeg = F.when(inside, F.substring(content, (best["at"] + 1).try_cast("int"), best["size"].try_cast("int")))
    return F.when(F.hex(F.substring(jpeg, 1, 3)) == "FFD8FF", jpeg)


def photo_folder(spark: SparkSession, path: str) -> DataFrame:
    """media_folder with the fields of exif_fields; files without readable tags have null fields (SRC6)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(path)
    fields = files.select("path", exif_tags("content").alias("tags")).select("path", exif_fields(F.col("tags")).alias("exif"))
    return media_folder(spark, path).join(fields, "path").select("*", "exif.*").drop("exif")
