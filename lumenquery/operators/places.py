"""Nearest-place lookup and names with fallback."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import EARTH_RADIUS_M, haversine
from ..session import cut

#: Degrees that divide the circle into three cells or more.
WIDTHS = (*(1 / 2**i for i in range(10, 0, -1)), 1, 2, 3, 4, 5, 6, 9, 10, 12, 15, 18, 20, 30, 45)
#: Places of a band that stand in one row.
HELD = 65_536


def _unit(lat: str, lon: str, names: str, prefix: str = "") -> list[Column]:
    """Columns of the point on the unit sphere."""
    a, o = F.radians(lat), F.radians(lon)
    return [c.alias(prefix + n) for c, n in zip((F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)), names, strict=True)]


def _round(left: DataFrame, here: DataFrame, width: float, meridians: bool, chunks: int) -> DataFrame:
    """left(key, lat, lon) with the best place of the cells about each point, and how far those are sure to reach."""
    around = lambda c, wrap: F.explode(F.array(*[F.pmod(c + i, F.lit(wrap)) if wrap else c + i for i in (-1, 0, 1)]))
    row = lambda c: F.floor(F.col(c) / width)
    n = round(360 / width)
    column = lambda c: F.pmod(F.floor((F.col(c) + 180) / width), F.lit(n)) if meridians else F.lit(0)
    # Places, the smaller side, are put into all nine cells; a point looks into its own, where they stand in one
    # row (bands: chunks rows), so that a task holds no row per point and place.
    near = here.select("*", around(row("plat"), 0).alias("ci")).select("*", around(column("plon"), n).alias("cj") if meridians else F.lit(0).alias("cj"))
    part = F.pmod(F.xxhash64("plat", "plon"), F.lit(chunks)) if chunks > 1 else F.lit(0)
    near = near.withColumn("part", part).groupBy("ci", "cj", "part").agg(F.collect_list(F.struct("plat", "plon", "px", "py", "pz", "at")).alias("places")).drop("part")
    found = left.select("key", "lat", "lon", *_unit("lat", "lon", "xyz"), row("lat").alias("ci"), column("lon").alias("cj")).join(near, ["ci", "cj"], "left")
    # Straight lines, cheaper by far, leave the nearest and what rounding can't tell from it; these are measured.
    gap = lambda p: F.sqrt(sum((F.col(c) - p["p" + c]) * (F.col(c) - p["p" + c]) for c in "xyz"))
    d = lambda p: haversine(F.col("lat"), F.col("lon"), p["plat"], p["plon"])
    few = lambda m: F.filter("places", lambda p: gap(p) <= m)
    nearest = lambda m: F.array_min(F.transform(few(m), lambda p: F.struct(d(p).alias("d"), p["at"].alias("at"))))
    least = F.array(F.array_min(F.transform("places", gap)) + 1e-12)  # an array of one, as its lambda computes it once
    best = found.select("key", "lat", "lon", F.get(F.transform(least, nearest), F.lit(0)).alias("b"))
    if chunks > 1:
        best = best.groupBy("key", "lat", "lon").agg(F.min("b").alias("b"))
    turn = math.radians(width)
    reach = F.least(F.lit(turn), F.asin(F.cos(F.radians("lat")) * math.sin(turn))) if meridians else F.lit(turn)
    return best.withColumn("reach", EARTH_RADIUS_M * (1 - 1e-9) * reach)


def _nearest(points: DataFrame, places: DataFrame, names: list[str]) -> DataFrame:
    """key, line_no, names and distance_m of the nearest of places(line_no, lat, lon, names); see nearest_place."""
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    # Of places at one spot the first line answers for all.
    at = F.struct("line_no", *names)
    here = cut(places.where(known).groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(F.min(at).alias("at")).select("*", *_unit("plat", "plon", "xyz", "p")))
    count = max(here.count(), 1)
    first = math.sqrt(64_800 / count)
    fit = lambda w: next((x for x in WIDTHS if x >= w), WIDTHS[-1])
    cells = sorted({fit(first * 3**i) for i in range(4)})
    steps = [*[(w, True) for w in cells], *[(fit(9 * first) * 2**i, False) for i in range(18) if fit(9 * first) * 2**i < 360]]
    row = lambda x: x.select("key", "b.at.*", F.col("b.d").alias("distance_m"))
    unknown = {f.name: f.dataType for f in here.schema["at"].dataType.fields} | {"distance_m": "double"}
    done = [points.where(~known).select("key", *[F.lit(None).cast(t).alias(c) for c, t in unknown.items()])]
    left = points.where(known)
    for width, meridians in steps:
        got = cut(_round(left, here, width, meridians, 1 if meridians else -(-count // HELD)))
        last = width >= 180 and not meridians
        sure = F.col("b").isNotNull() if last else F.coalesce(F.col("b.d") < F.col("reach"), F.lit(False))
        done.append(row(got.where(sure)))
        left = got.where(~sure).select("key", "lat", "lon")
        if last or not left.limit(1).count():
            break
    return reduce(DataFrame.unionByName, done)


def nearest_place(points: DataFrame, places: DataFrame) -> DataFrame:
    """points(key, lat, lon) with the nearest of places(line_no, lat, lon, place), the first line on ties.

    Points meet places on cells of latitude and longitude, about one place to a cell; an
    answer nearer than the neighbouring cells reach is final. The few others go on with
    wider cells, then with bands of latitude that double. A point without coordinates gets
    a null place; places without them don't count; no places give rows for such points only.
    """
    return _nearest(points, places, ["place"])


def reverse_geocode(points: DataFrame, places: DataFrame, countries: DataFrame, regions: DataFrame) -> DataFrame:
    """key, place, region and country of points, from places(line_no, lat, lon, place, cc, admin1) (ALG17)."""
    at = _nearest(points, places, ["place", "cc", "admin1"])
    return _named(at, countries, regions).select("key", "place", "region", "country", "distance_m")


def _named(rows: DataFrame, countries: DataFrame, regions: DataFrame) -> DataFrame:
    """rows(cc, admin1, ...) with country and region."""
    c = countries.select(F.col("cc"), F.col("name").alias("__cn"))
    r = regions.select("cc", "admin1", F.col("name").alias("__rn"))
    return rows.join(c, "cc", "left").join(r, ["cc", "admin1"], "left").withColumn("country", F.coalesce("__cn", "cc")).withColumn("region", F.coalesce("__rn", "admin1"))


def place_names(rows: DataFrame, countries: DataFrame, regions: DataFrame) -> DataFrame:
    """rows(key, cc, admin1) with names of country and region, or their codes where unknown."""
    return _named(rows, countries, regions).select("key", "country", "region")
