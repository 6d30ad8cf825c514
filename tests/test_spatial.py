import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.operators import spatial

MEASURES = ["l1_wrapped", "l1", "cos_squared", "euclidean"]


def plain(measure, lat, lon, lats, lons):
    up, aside = np.abs(lats - lat), np.abs(lons - lon)
    if measure == "l1_wrapped":
        d = np.abs(np.mod(lons, 360) - np.mod(lon, 360))
        return up + np.minimum(d, 360 - d)
    return {"l1": up + aside, "cos_squared": up**2 + (aside * np.cos(np.radians(lat))) ** 2, "euclidean": np.hypot(up, aside)}[measure]


@pytest.mark.parametrize("measure, places", [*[(m, 3) for m in MEASURES], ("cos_squared", 128)])
def test_dense_places_lonely_rows_and_copies(spark, measure, places):
    """Many places in a hundredth of a degree, few elsewhere, copies of one place, rows far from all and beside the date line."""
    rng = np.random.default_rng(6)
    lats = np.r_[rng.uniform(40, 40.01, 3000), rng.uniform(-80, 80, 60), [10.0] * 400, [0.0, 0.0]]
    lons = np.r_[rng.uniform(7, 7.01, 3000), rng.uniform(-180, 180, 60), [20.0] * 400, [179.9, -179.9]]
    right = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(lats, lons))], "cell long, lat_b double, lon_b double").repartition(3)
    asked = np.r_[np.c_[rng.uniform(39.99, 40.02, 200), rng.uniform(6.99, 7.02, 200)], np.c_[rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)], [[10, 20], [10, 20], [0, 180], [-90, 0], [0, -179.95]]]
    left = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(asked)], "q long, lat_a double, lon_a double")
    got = {r.q: (r.cell, r.distance) for r in spatial.nearest_in_space(left, right, "q", "cell", measure, places).collect()}
    assert len(got) == len(asked)
    for i, (a, b) in enumerate(asked):
        d = plain(measure, a, b, lats, lons)
        assert got[i][1] == pytest.approx(d.min(), rel=1e-9, abs=1e-12)
        assert d[got[i][0]] == pytest.approx(d.min(), rel=1e-9, abs=1e-12)
    assert got[260][0] == got[261][0] == 3060  # the smallest of the copies


def test_a_million_places_in_one_degree(spark):
    """What is read of the dense place stays small: each row's distance is below the spacing of places."""
    right = spark.range(1_000_000).select(F.col("id").alias("cell"), (40 + F.floor(F.col("id") / 1000) / 1000).alias("lat_b"), (7 + F.col("id") % 1000 / 1000).alias("lon_b"))
    left = spark.range(2000).select(F.col("id").alias("q"), (40 + F.pmod(F.col("id") * 7919, F.lit(99_900)) / 100_000).alias("lat_a"), (7 + F.pmod(F.col("id") * 104_729, F.lit(99_900)) / 100_000).alias("lon_a"))
    far = spark.createDataFrame([(-1, -60.0, -170.0)], "q long, lat_a double, lon_a double")
    found = spatial.nearest_in_space(left.union(far), right, "q", "cell", "euclidean")
    met = found.join(left, "q").select("cell", "distance", (F.rint((F.col("lat_a") - 40) * 1000) * 1000 + F.rint((F.col("lon_a") - 7) * 1000)).cast("long").alias("want"), (F.abs(F.col("lat_a") * 1000 % 1 - 0.5) > 0.01).alias("sure"), (F.abs(F.col("lon_a") * 1000 % 1 - 0.5) > 0.01).alias("too"))
    assert met.count() == 2000 and met.filter("sure and too and cell <> want").count() == 0 and met.filter("distance > 0.00071").count() == 0
    assert found.filter("q = -1").first().cell == 0


def test_no_places_and_one_place(spark):
    left = spark.createDataFrame([(1, 5.0, 5.0), (2, None, 1.0)], "q long, lat_a double, lon_a double")
    none = spark.createDataFrame([], "cell long, lat_b double, lon_b double")
    assert spatial.nearest_in_space(left, none, "q", "cell").collect() == []
    one = spark.createDataFrame([(9, 1.0, 2.0), (8, 1.0, 2.0), (7, None, 2.0)], "cell long, lat_b double, lon_b double")
    assert [tuple(r) for r in spatial.nearest_in_space(left, one, "q", "cell", "l1").collect()] == [(1, 8, 7.0)]
