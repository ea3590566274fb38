"""Nearest places: spots with many lines, bands in parts, and what a task holds."""

import numpy as np
import pytest

from lumenquery.operators import places

POINTS, PLACES = "key long, lat double, lon double", "line_no long, lat double, lon double, place string"


def test_no_row_per_point_and_place(spark):
    """A round looks into one row a cell, and doesn't aggregate points."""
    here = spark.createDataFrame([(1.0, 2.0, 0.9, 0.1, 0.1, (1, "a"))], "plat double, plon double, px double, py double, pz double, at struct<line_no:long,place:string>")
    plan = places._round(spark.createDataFrame([(1, 1.0, 2.0)], POINTS), here, 0.5, True, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [key" not in plan and "Aggregate [ci" in plan


@pytest.mark.parametrize("held", [65_536, 50])
def test_copies_of_a_spot_and_bands_in_parts(spark, monkeypatch, held):
    """The first line answers for a spot; far points are settled by bands, in as many rows as it takes."""
    monkeypatch.setattr(places, "HELD", held)
    r = np.random.default_rng(3)
    lat, lon = np.repeat(40 + r.uniform(0, 0.5, 100), 3), np.repeat(10 + r.uniform(0, 0.5, 100), 3)
    plat, plon = np.r_[40 + r.uniform(0, 0.5, 60), r.uniform(-90, 90, 40)], np.r_[10 + r.uniform(0, 0.5, 60), r.uniform(-180, 180, 40)]
    c = spark.createDataFrame([(i, float(lat[i]), float(lon[i]), f"p{i}") for i in range(300)], PLACES)
    p = spark.createDataFrame([(i, float(plat[i]), float(plon[i])) for i in range(100)], POINTS)
    a, b = np.radians(plat)[:, None], np.radians(lat)[None, :]
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon[None, :] - plon[:, None]) / 2) ** 2
    got = {x.key: x for x in places.nearest_place(p, c).collect()}
    assert [got[i].line_no for i in range(100)] == [3 * int(h[i, ::3].argmin()) for i in range(100)]
