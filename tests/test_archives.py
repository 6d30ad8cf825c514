import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.operators import chains, skew, tiles
from orbitweave.sources import rasters, scan_catalogue
from tests.plans import scans


def test_requests_prune_the_catalogue(spark, tmp_path):
    path = f"{tmp_path}/catalogue"
    start = dt.datetime(2023, 12, 31, 18)
    times = [start + dt.timedelta(minutes=20 * i) for i in range(72)]
    scan_catalogue.write_catalogue(spark.createDataFrame([(t, f"G{p}", c) for t in times for p in (16, 17) for c in (1, 2)], "scan_time timestamp_ntz, platform string, channel int"), path)
    assert spark.read.parquet(path).select("year", "doy", "hour").distinct().count() == 24
    asked = spark.createDataFrame([(1, dt.datetime(2023, 12, 31, 23, 50), "G16"), (2, dt.datetime(2024, 1, 1, 0, 9), "G17"), (3, dt.datetime(2030, 1, 1), "G16")], "id long, ts timestamp_ntz, platform string")
    found = scan_catalogue.asked_scans(spark, path, asked, "ts")
    assert found.filter("scan_time is not null").count() == 4 * 12
    found.collect()
    files = sum(n for n, _ in scans(found))
    assert files == 4  # hours 22 and 23 of the old year, 0 and 1 of the new, of 24
    near = scan_catalogue.nearest_complete(spark, path, asked, "id", "ts", 2, 600).collect()
    assert sorted((r.id, r.scan_time, r.abs_micros) for r in near) == [(1, dt.datetime(2023, 12, 31, 23, 40), 600_000_000), (2, dt.datetime(2024, 1, 1), 540_000_000)]
    met = scan_catalogue.scans_by_request(spark, path, asked.withColumnRenamed("platform", "own"), "ts").groupBy("id").count().collect()
    assert sorted(map(tuple, met)) == [(1, 36), (2, 36)]


def test_listings_open_no_file(spark, tmp_path):
    spark.range(40).select("id", (F.col("id") % 4).alias("doy"), (F.col("id") % 2).alias("hour")).write.partitionBy("doy", "hour").parquet(f"{tmp_path}/a")
    listed = scan_catalogue.listing(spark, f"{tmp_path}/a", "*.parquet").filter("doy = 2").select("doy", "hour").distinct()
    assert [tuple(r) for r in listed.collect()] == [(2, 0)]
    assert "PartitionFilters: [isnotnull(doy" in listed._jdf.queryExecution().toString() and "content" not in listed._jdf.queryExecution().executedPlan().toString()
    audit = scan_catalogue.audited(scan_catalogue.listing(spark, f"{tmp_path}/a"), ["doy"], "hour", [0, 1, 2])
    assert sorted((r.doy, r.have, tuple(r.missing)) for r in audit.collect()) == [(0, 1, (1, 2)), (1, 1, (0, 2)), (2, 1, (1, 2)), (3, 1, (0, 2))]


@pytest.fixture(scope="module")
def raster(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('raster')}/r"
    cells = spark.range(300 * 260).select((F.col("id") % 300).cast("int").alias("r"), F.floor(F.col("id") / 300).cast("int").alias("c"), (F.col("id") * 7 % 1000).alias("v"))
    rasters.write_raster(cells, path)
    return path


@pytest.mark.parametrize("rows, cols, stride", [((40, 71), (64, 95), 1), ((0, 299), (0, 259), 8), ((3, 3), (200, 259), 1), ((10, 250), (5, 17), 12), ((290, 400), (250, 999), 1), ((17, 90), (33, 70), 16), ((500, 600), (0, 9), 1)])
def test_windows_and_strides_of_a_raster(spark, raster, rows, cols, stride):
    found = rasters.read_raster(spark, raster, rows, cols, stride)
    assert found.columns == ["r", "c", "v"]
    got = sorted(map(tuple, found.collect()))
    want = sorted((r, c, (c * 300 + r) * 7 % 1000) for r in range(rows[0], min(rows[1], 299) + 1) for c in range(cols[0], min(cols[1], 259) + 1) if r % stride == 0 and c % stride == 0)
    assert got == want


def test_windows_and_strides_read_few_files(spark, raster):
    everything = spark.read.parquet(raster)
    everything.collect()
    (files, cells), = scans(everything)
    window = rasters.read_raster(spark, raster, (64, 127), (64, 127))
    window.collect()
    (few, some), = scans(window)
    assert few <= files / 8 and some <= cells / 8
    assert "PushedFilters: [" in (plan := window._jdf.queryExecution().executedPlan().toString()) and "GreaterThanOrEqual(z," in plan
    coarse = rasters.read_raster(spark, raster, (0, 299), (0, 259), 16)
    coarse.collect()
    (_, read), = scans(coarse)
    assert read == 19 * 17


def test_morton_runs_cover_a_window():
    for rows, cols in (((0, 0), (0, 0)), ((3, 9), (2, 5)), ((0, 15), (0, 15)), ((5, 5), (0, 40)), ((7, 8), (7, 8))):
        for most in (1, 3, 100):
            runs = rasters.runs_of(rows, cols, most)
            inside = {rasters._morton(r, c) for r in range(rows[0], rows[1] + 1) for c in range(cols[0], cols[1] + 1)}
            held = {z for a, b in runs for z in range(a, b + 1)}
            assert inside <= held and len(runs) <= most and (most < 100 or inside == held)


@pytest.mark.parametrize("least", [10, 10_000])
def test_gathering_by_tile_splits_hot_tiles(spark, least):
    rng = random.Random(1)
    cells = {(rng.randrange(-40, 90), rng.randrange(100)): rng.random() for _ in range(3000)}
    raster = tiles.packed(spark.createDataFrame([(r, c, v, str(v)) for (r, c), v in cells.items()], "r int, c int, v double, name string"), ["v", "name"], tile=16)
    assert raster.filter("size(v) <> 256").count() == 0
    points = [(i, *((3, 4) if i % 3 else (rng.randrange(-60, 90), rng.randrange(100)))) for i in range(2000)]
    found = tiles.gathered(spark.createDataFrame(points, "id long, r int, c int"), raster, ["v", "name"], tile=16, least=least)
    want = sorted((i, r, c, cells.get((r, c)), str(cells[r, c]) if (r, c) in cells else None) for i, r, c in points)
    assert sorted(map(tuple, found.collect())) == want


def test_hot_keys_are_few_and_dealt_out(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    hot = skew.hot_keys(df, ["k"], 100)
    assert [r.k for r in hot.collect()] == [0]
    sizes = skew.parted(df, hot, ["k"], F.col("id")).filter("k = 0").groupBy("__part").count().collect()
    assert len(sizes) == hot.first()["__deal"] >= 2 and max(r["count"] for r in sizes) < 2 * 10_000 / 8
    met = skew.parted(df, hot, ["k"], F.col("id")).join(skew.copied(df.select("k").distinct(), hot, ["k"]), ["k", "__part"])
    assert met.count() == 10_000


def walked(strides):
    at, seen = 0, []
    while at < len(strides):
        seen.append(at)
        at += strides[at]
    return seen


def test_strided_scans_of_long_groups(spark):
    rng = random.Random(4)
    groups = {g: [rng.choice([1, 1, 2, 5, 40]) for _ in range(n)] for g, n in ((1, 1), (2, 2), (3, 700), (None, 60), (5, 9000))}
    rows = [(g, i, s) for g, strides in groups.items() for i, s in enumerate(strides)]
    rng.shuffle(rows)
    found = chains.reached(spark.createDataFrame(rows, "g long, i long, s int").repartition(7), ["g"], ["i"], F.col("s")).collect()
    assert sorted(((r.g or 0), r.pos, r.i) for r in found) == sorted((g or 0, p, p) for g, strides in groups.items() for p in walked(strides))
    assert chains.reached(spark.createDataFrame([], "g long, i long, s int"), ["g"], ["i"], F.col("s")).collect() == []
    with pytest.raises(Exception, match="strides are 1 or more"):
        chains.reached(spark.createDataFrame([(1, 0, 0)], "g long, i long, s int"), ["g"], ["i"], F.col("s")).collect()


def test_the_order_dependent_balance_over_many_parts(spark):
    rng = np.random.default_rng(3)
    stretch = lambda p, n: rng.choice(3, n, p=p)
    kinds = np.concatenate([stretch([0.2, 0.4, 0.4], 500), stretch([0, 0.95, 0.05], 5000), stretch([0.1, 0, 0.9], 9000), np.ones(2000, int), stretch([0.3, 0.5, 0.2], 8000)])
    want = np.flatnonzero(chains.replayed(kinds, 0, 0)[0])
    df = spark.createDataFrame([(i, int(k), i) for i, k in enumerate(kinds)], "i long, k int, __at_ long").repartition(6)
    got = chains.balanced_in_order(df, ["i"], F.col("k") == 1, F.col("k") == 2)
    assert got.columns == df.columns and sorted(r.i for r in got.collect()) == want.tolist()
    assert chains.balanced_in_order(df.limit(0), ["i"], F.col("k") == 1, F.col("k") == 2).collect() == []


def test_blocks_chain_as_one_replay():
    rng = np.random.default_rng(1)
    for t in range(120):
        kinds = rng.choice(3, rng.integers(1, 3000), p=rng.dirichlet(rng.choice([0.2, 1, 5], 3)))
        if t % 3 == 0:
            kinds = np.concatenate([np.repeat(rng.integers(0, 3), rng.integers(1, 200)) for _ in range(40)])
        want, low, high = chains.replayed(kinds, 0, 0)
        a = b = 0
        got = []
        for k in np.array_split(kinds, rng.integers(1, 12)):
            lows, highs = int((k == 1).sum()), int((k == 2).sum())
            got.append(chains._taken(k, a, b))
            limited = chains._limited(a, b, lows, highs)
            if limited == 1:
                a, b = a + lows - chains.rejected(chains.peaks(k, 1)[b % chains.Q], a, b), b + highs
            elif limited == 2:
                a, b = a + lows, b + highs - chains.rejected(chains.peaks(k, 2)[a % chains.Q], b, a)
            else:
                _, a, b = chains.replayed(k, a, b)
        assert (np.concatenate(got) == want).all() and (a, b) == (low, high)
