"""Column functions over media metadata: parsers, sampling, geometry and playback rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null where a coordinate is."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def parse_iso6709(s: Column) -> Column:
    """(lat, lon) of "+28.6139+077.2090+216.000/"; null when malformed or out of range."""
    lat = F.regexp_extract(s, r"^([+-][^+-]+)([+-][^+/-]+)", 1).try_cast("double")
    lon = F.regexp_extract(s, r"^([+-][^+-]+)([+-][^+/-]+)", 2).try_cast("double")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def parse_rational(s: Column) -> Column:
    """n/d or n as a positive double, else null."""
    n = F.split_part(s, F.lit("/"), F.lit(1)).try_cast("double")
    d = F.when(F.instr(s, "/") > 0, F.split_part(s, F.lit("/"), F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
    q = F.try_divide(n, d)
    return F.when(q > 0, q)


def display_size(w: Column, h: Column, rotation: Column) -> Column:
    """(width, height), exchanged when the rotation is an odd number of quarter turns."""
    r = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(360))
    turned = r % 180 != 0
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def exif_timestamp(s: Column) -> Column:
    """"2024:05:01 10:20:30" as UTC, else null."""
    return F.try_to_timestamp(s, F.lit("yyyy:MM:dd HH:mm:ss"))


def gps_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as signed decimal degrees."""
    v = d + m / 60.0 + s / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)


def shutter(num: Column, den: Column) -> Column:
    """1/d for unit numerators, else seconds with three decimals; null for a zero denominator or without numbers (X11)."""
    return F.when(num.isNull() | den.isNull() | (den == 0), None).when(num == 1, F.concat(F.lit("1/"), den.cast("long").cast("string"))).otherwise(F.format_string("%.3f", num / den))


def signed_altitude(metres: Column, ref: Column) -> Column:
    """Below sea level where the reference byte is 1."""
    return F.when(ref == 1, -metres).otherwise(metres)


def thumbnail_second(duration: Column) -> Column:
    """A tenth in, at least half a second, at most nine tenths; 0 when unknown."""
    return F.when(duration > 0, F.least(F.greatest(0.1 * duration, F.lit(0.5)), 0.9 * duration)).otherwise(F.lit(0.0))


def even_samples(duration: Column) -> Column:
    """One sample per two seconds, 1 to 5, spread over the middle 80 %."""
    n = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(duration / 2 + 0.5))).cast("int")
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: duration * (F.lit(0.1) + F.lit(0.8) * i / (n - 1)))
    return F.when(duration.isNull() | (duration <= 0), F.array(F.lit(0.0))).when(n == 1, F.array(duration / 2)).otherwise(spread)


def scene_samples(duration: Column, scenes: Column, shortest: float = 0.5) -> Column:
    """Midpoints of shots between scene cuts; the longest ones only beyond the cap.

    Shots under half a second are dropped; without any the samples are even ones. The cap
    is a fifth of the seconds, 5 to 24; of equally long shots the earlier ones stay.
    """
    inside = F.array_sort(F.filter(scenes, lambda s: (s > 0) & (s < duration)))
    bounds = F.concat(F.array(F.lit(0.0)), inside, F.array(duration))
    shots = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.struct((F.element_at(bounds, i) - F.element_at(bounds, i + 1)).alias("neg"), F.element_at(bounds, i).alias("a"), F.element_at(bounds, i + 1).alias("b")))
    shots = F.filter(shots, lambda x: -x["neg"] >= shortest)
    cap = F.greatest(F.lit(5), F.least(F.lit(24), F.floor(duration / 5 + 0.5))).cast("int")
    mids = F.array_sort(F.transform(F.slice(F.array_sort(shots), 1, cap), lambda x: (x["a"] + x["b"]) / 2))
    return F.when(duration.isNull() | (duration <= 0), F.array(F.lit(0.0))).when(F.coalesce(F.size(shots), F.lit(0)) <= 0, even_samples(duration)).otherwise(mids)


def shot_bounds(ts: Column, duration: Column, scenes: Column) -> Column:
    """(start, end) of the shot that holds ts: last cut at or before it, first one after it."""
    return F.struct(F.coalesce(F.array_max(F.filter(scenes, lambda s: s <= ts)), F.lit(0.0)).alias("start"), F.coalesce(F.array_min(F.filter(scenes, lambda s: s > ts)), duration).alias("end"))


def inside_spans(t: Column, spans: Column) -> Column:
    """Whether any half-open span holds t."""
    return F.exists(spans, lambda x: (t >= x["start"]) & (t < x["end"]))


# Containers that browsers play, and the codecs that each may carry.
PLAYABLE = {"video/mp4": ("h264", "vp9", "av1"), "video/webm": ("vp8", "vp9", "av1"), "video/quicktime": ("h264",)}
SAFE_CODECS = ("h264", "vp8", "vp9", "av1")


def browser_playable(codec: Column, mime: Column) -> Column:
    """Codec and container that a browser plays as they are; false for an unknown codec."""
    fits = F.lit(False)
    for m, codecs in PLAYABLE.items():
        fits = fits | ((F.lower(mime) == m) & F.lower(codec).isin(*codecs))
    return F.coalesce(fits, F.lit(False))


def playback_action(codec: Column, mime: Column) -> Column:
    """none, remux (the codec is safe) or reencode (ALG23)."""
    return F.when(browser_playable(codec, mime), "none").when(F.coalesce(F.lower(codec).isin(*SAFE_CODECS), F.lit(False)), "remux").otherwise("reencode")


def crop_offset(iw: Column, fx: Column, ow: Column) -> Column:
    """Left edge of a crop of width ow about the focus."""
    return F.least(F.greatest(iw * fx - ow / 2, F.lit(0.0)), iw - ow)


def fitted(w: Column, h: Column, edge: int) -> Column:
    """Size scaled down, never up, to fit an edge (SNK17)."""
    k = F.least(F.lit(1.0), edge / F.greatest(w, h).cast("double"))
    return F.struct(F.floor(w * k + 0.5).cast("long").alias("width"), F.floor(h * k + 0.5).cast("long").alias("height"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x, y, w, h)."""
    ix = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    iy = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - ix * iy
    return F.when(union > 0, ix * iy / union).otherwise(F.lit(0.0))


#: Transition names, their meaning and default seconds.
TRANSITIONS = {"cut": ("cut", 0.0), "crossfade": ("crossfade", 0.5), "fade": ("crossfade", 0.5), "dip": ("dip_to_black", 0.7), "dip_to_black": ("dip_to_black", 0.7), "slide": ("slide", 0.4), "whip": ("whip", 0.2)}


def parse_transition(s: Column) -> Column:
    """name[:secs] as (style, secs); null for unknown names and seconds outside 0 to 3."""
    name, secs = F.lower(F.trim(F.split_part(s, F.lit(":"), F.lit(1)))), F.split_part(s, F.lit(":"), F.lit(2))
    has = F.instr(s, ":") > 0
    out = F.lit(None).cast("struct<style:string,secs:double>")
    for k, (style, default) in TRANSITIONS.items():
        value = F.when(has, secs.try_cast("double")).otherwise(F.lit(default))
        ok = (name == k) & ((value > 0) & (value <= 3) if k != "cut" else ~has)
        out = F.when(ok, F.struct(F.lit(style).alias("style"), value.alias("secs"))).otherwise(out)
    return out


def pad_tokens(ids: Column, width: int = 64, pad: int = 1) -> Column:
    """Token ids cut or padded to a width."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), width)), 1, width)


def overlap_fade(available: Column, asked: Column) -> Column:
    """Seconds of overlap that the media allow; under 0.15 s none."""
    fade = F.least(available, asked)
    return F.when(fade < 0.15, F.lit(0.0)).otherwise(fade)


def framing(style: Column, portrait: Column, faces: Column) -> Column:
    """What "auto" means for a clip."""
    return F.when(style != "auto", style).when(~portrait, "pad").when(faces > 0, "cover").otherwise("blur")
