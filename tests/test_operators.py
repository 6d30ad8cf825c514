import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from orbitweave.functions import geo, scaling
from orbitweave.operators import arrays, metrics, sampling, spatial, temporal, tracking
from orbitweave.sources import files, sinks
from orbitweave.streaming.windows import first_arrivals, windowed_counts

T = dt.datetime


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scan_names_and_nearest_complete_scan(spark):
    names = [(f"OR_ABI-L1b-RadF-M6C{c:02d}_{p}_s2019336235959_e2019337000959_c.nc",) for c in range(1, 17) for p in ("G16", "G17")] + [("odd",)]
    scans = files.with_scan_fields(spark.createDataFrame(names, "name string"), "name")
    first = scans.filter("channel = 7 and platform = 'G16'").first()
    assert first.scan_time == T(2019, 12, 2, 23, 59, 59)
    assert scans.filter("channel is null").first().scan_time is None
    groups = temporal.complete_groups(scans.filter("platform = 'G16'"), F.col("scan_time"), "time", "channel", 16)
    asked = spark.createDataFrame([(1, T(2019, 12, 3, 0, 0, 30))], "id int, ts timestamp_ntz")
    got = temporal.nearest_in_time(asked, groups, "id", "ts", "time", "time", 120)
    assert values(got, "time") == [(T(2019, 12, 2, 23, 59, 59),)]
    assert temporal.nearest_in_time(asked, groups, "id", "ts", "time", "time", 30).count() == 0


@pytest.mark.parametrize(("size", "middle"), [(1, 0), (2, 1), (3, 1), (4, 2)])
def test_middle_record(spark, size, middle):
    df = spark.createDataFrame([("a", i) for i in range(size)], "k string, i int")
    assert values(sampling.middle_record(df, ["k"], ["i"]), "i") == [(middle,)]


def test_balanced_anchor_and_modes(spark):
    df = spark.createDataFrame([(k, i) for k in range(4) for i in range(9)], "k int, i int")
    assert values(sampling.balanced_anchor(df, ["k"], ["i"], F.col("k")), "k", "i") == [(0, 1), (1, 3), (2, 5), (3, 7)]
    assert sampling.sample_records(df, ["k"], ["i"], "all").count() == 36
    with pytest.raises(ValueError):
        sampling.sample_records(df, ["k"], ["i"], "other")


def test_dense_index(spark):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "k int").repartition(6)
    assert values(sampling.with_dense_index(df, "k", "at"), "k", "at") == [(i, i) for i in range(1000)]


def test_islands_over_a_month_end(spark):
    days = [dt.date(2020, 1, 30), dt.date(2020, 1, 31), dt.date(2020, 2, 1), dt.date(2020, 2, 3)]
    df = spark.createDataFrame([(1, d) for d in days], "id int, day date")
    assert values(tracking.islands(df, ["id"], "day"), "island") == [(1,), (1,), (1,), (2,)]


def test_nearest_grid_cell_and_wrap(spark):
    grid = spark.range(100).select(F.col("id").cast("double").alias("lat_b")).crossJoin(spark.range(100).select(F.col("id").cast("double").alias("lon_b")))
    grid = grid.filter("lat_b <= 89").withColumn("cell", F.col("lat_b") * 100 + F.col("lon_b"))
    asked = spark.createDataFrame([(1, 52.1, 37.2)], "q int, lat_a double, lon_a double")
    for kind in ("l1_wrapped", "cos_squared", "euclidean"):
        assert values(spatial.nearest_in_space(asked, grid, "q", "cell", kind), "cell") == [(5237.0,)]
    east = spark.createDataFrame([(1, 0.0, 179.9)], "q int, lat_a double, lon_a double")
    west = spark.createDataFrame([(7, 0.0, -179.9), (8, 0.0, 178.0)], "cell int, lat_b double, lon_b double")
    assert values(spatial.nearest_in_space(east, west, "q", "cell"), "cell") == [(7,)]
    assert values(spatial.nearest_in_space(east, west, "q", "cell", "euclidean"), "cell") == [(8,)]
    assert spatial.nearest_in_space(east, west.limit(0), "q", "cell").collect() == []


def test_nearest_place_is_the_nearest_however_far(spark):
    at = lambda rows, s: spark.createDataFrame(rows, f"{'q' if s == 'a' else 'cell'} int, lat_{s} double, lon_{s} double")
    corner = spatial.nearest_in_space(at([(1, 0.0, 0.0), (2, -90.0, 179.0), (3, None, 1.0)], "a"), at([(1, 4.9, 4.9), (2, 5.5, 0.0)], "b"), "q", "cell")
    assert values(corner, "q", "cell", "distance") == [(1, 2, 5.5), (2, 1, 94.9 + 174.1)]
    north = spatial.nearest_in_space(at([(1, 80.0, 0.0)], "a"), at([(1, 84.0, 0.0), (2, 80.0, 6.0)], "b"), "q", "cell", "cos_squared")
    assert values(north, "cell") == [(2,)]


@pytest.mark.parametrize("measure", ["l1_wrapped", "l1", "cos_squared", "euclidean"])
def test_nearest_place_matches_all_pairs(spark, measure):
    rng = random.Random(3)
    place = lambda: (round(rng.triangular(-90, 90, 40), 1), round(rng.uniform(-180, 180), 1))
    a, b = [(i, *place()) for i in range(60)], [(i, *place()) for i in range(25)]

    def apart(x, y):
        up, aside = abs(x[1] - y[1]), abs(x[2] - y[2])
        turn = abs(x[2] % 360 - y[2] % 360)
        return {"l1_wrapped": up + min(turn, 360 - turn), "l1": up + aside, "cos_squared": up**2 + (aside * math.cos(math.radians(x[1]))) ** 2, "euclidean": math.hypot(up, aside)}[measure]

    left = spark.createDataFrame(a, "q int, lat_a double, lon_a double")
    right = spark.createDataFrame(b, "cell int, lat_b double, lon_b double")
    got = {r.q: r.distance for r in spatial.nearest_in_space(left, right, "q", "cell", measure).collect()}
    assert got.keys() == {x[0] for x in a}
    assert all(abs(got[x[0]] - min(apart(x, y) for y in b)) < 1e-9 for x in a)


@pytest.mark.parametrize("rank", [1, 3])
def test_nearest_in_time_matches_all_pairs(spark, rank):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    a = [(i, i % 2, start + dt.timedelta(seconds=rng.randrange(4000))) for i in range(50)]
    b = [(i, i % 2, start + dt.timedelta(seconds=rng.randrange(400) * 10)) for i in range(90)] + [(100 + i, 0, start + dt.timedelta(seconds=60)) for i in range(20)]
    left, right = spark.createDataFrame(a, "q int, g int, at timestamp_ntz"), spark.createDataFrame(b, "r int, g int, ts timestamp_ntz")
    got = sorted((x.q, x.nth, x.r) for x in temporal.nearest_in_time(left, right, "q", "at", "ts", "r", 120, ["g"], rank).collect())
    want = []
    for q, g, t in a:
        near = sorted((abs(t - u), u, r) for r, h, u in b if g == h and abs(t - u).total_seconds() <= 120)[:rank]
        want += [(q, n + 1, r) for n, (_, _, r) in enumerate(near)]
    assert got == sorted(want)


def test_rasterised_layers(spark):
    df = spark.createDataFrame([(0, 2.0, 3.5, 4, 1), (0, 3.0, 3.2, 7, 2), (0, -1.0, -1.0, 9, 3), (1, 19.9, 30.0, 2, 1)], "p int, base double, top double, kind int, layer int")
    assert values(arrays.rasterise(df, ["p"], "base", "top", "kind", "layer", 40, 0.5), "p", "bin", "kind") == [(0, 4, 4), (0, 5, 4), (0, 6, 7), (0, 7, 4), (1, 39, 2)]


def test_layer_masks_tell_missing_from_clear(spark):
    layer, none = (2.0, 3.0, 4), (-1.0, -1.0, 0)
    df = spark.createDataFrame([(0, 1, [layer, none]), (1, 0, [none, none]), (2, -9, [layer, none]), (3, 2, [none, layer])], "p int, n int, layers array<struct<base: double, top: double, kind: int>>")
    mask = {r.p: r.m for r in df.select("p", arrays.layer_mask(F.col("layers"), F.col("n"), 40, 0.5).alias("m")).collect()}
    assert [i for i, k in enumerate(mask[0]) if k] == [4, 5, 6] and set(mask[0]) == {0, 4}
    assert set(mask[1]) == {0} and mask[2] == [-1] * 40 and [i for i, k in enumerate(mask[3]) if k == 4] == [4, 5, 6]
    old = {r.p: r.m for r in df.select("p", arrays.layer_mask(F.col("layers"), F.col("n"), 40, 0.5, clip=False).alias("m")).collect()}
    assert set(old[3]) == {0} and set(old[2]) == {0, 4}
    flags = df.select(arrays.binary_mask(F.lit(-1)).alias("a"), arrays.binary_mask(F.lit(0)).alias("b"), arrays.binary_mask(F.lit(7)).alias("c")).first()
    assert tuple(flags) == (-1, 0, 1)


def test_aligned_arrays_must_agree_in_length(spark):
    df = spark.createDataFrame([([1, 2], [3, 4, 5])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="arrays of 2 and 3 elements"):
        df.select(arrays.zipped(F.col("a"), F.col("b"), ("x", "y"))).collect()
    with pytest.raises(Exception, match="a has 2 elements, not 3"):
        df.select(arrays.checked(F.col("a"), 3, "a")).collect()
    row, col = arrays.unpatched(F.col("p"), F.col("q"), 4, 12)
    cells = spark.range(144).select(F.floor(F.col("id") / 12).alias("r"), (F.col("id") % 12).alias("c"))
    back = arrays.patches(cells, "r", "c", 4, 12).select("r", "c", F.col("patch").alias("p"), F.col("place").alias("q"))
    assert back.filter((row != F.col("r")) | (col != F.col("c"))).count() == 0


def test_shared_folders_are_named_on_a_cluster(spark, monkeypatch):
    from orbitweave import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_interpolation_holds_ends_and_needs_two_points(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0), ("b", 1.0, 5.0), ("a", None, 1.0)], "k string, x double, y double")
    assert values(arrays.interpolate(df, ["k"], "x", "y", [0.0, 1.0, 2.0, 9.0]), "k", "x", "y") == [("a", 0.0, 10.0), ("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 9.0, 30.0), *[("b", g, 0.0) for g in (0.0, 1.0, 2.0, 9.0)]]
    odd = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, -9.0), ("a", 3.0, 30.0), ("c", 1.0, -1.0), ("c", float("nan"), 5.0), ("c", 2.0, 7.0)], "k string, x double, y double")
    assert values(arrays.interpolate(odd, ["k"], "x", "y", [2.0]), "k", "x", "y") == [("a", 2.0, 20.0), ("c", 2.0, 0.0)]
    assert values(arrays.interpolate(odd, ["k"], "x", "y", [9.0], least=1), "k", "y") == [("a", 30.0), ("c", 7.0)]


def test_centred_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    got = df.select(arrays.centred(F.col("a"), 6, F.lit(0)).alias("p"), arrays.centred(F.col("a"), 1, F.lit(0)).alias("c")).first()
    assert got.p == [0, 1, 2, 3, 0, 0] and got.c == [2]


def test_scalars(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.25,), (0.5,), (0.75,), (1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(scaling.stage_class(F.col("x"))).collect()] == [0, 1, 2, 3, 4, 4, 0, 0]
    assert [r[0] for r in df.select(scaling.min_max(F.col("x"), F.lit(0.0), F.lit(0.5))).collect()] == [0, 0, 0.5, 1, 1, 1, 0, 0]
    one = spark.range(1)
    near = lambda c: one.select(c).first()[0]
    assert abs(near(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) - 6371 * 3.141592653589793 / 2) < 1e-6
    assert near(geo.view_zenith(F.lit(0.0), F.lit(-75.0), -75.0)) < 1e-4
    assert near(geo.solar_zenith(F.lit(80), F.lit(12.0), F.lit(0.0), F.lit(0.0), F.lit(365))) < 4
    assert near(geo.normalise_longitude(F.lit(190.0))) == -170
    flags = spark.createDataFrame([("True",), (" true ",), ("False",), (None,)], "f string")
    assert [r[0] for r in flags.select(scaling.is_true(F.col("f"))).collect()] == [True, True, False, None]


def test_metrics_of_exact_and_masked_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 0), ("a", 2.0, 2.0, 0), ("b", 1.0, 3.0, 1)], "band string, p double, t double, m int")
    got = {r.band: r for r in metrics.error_metrics(df, ["band"], "p", "t", 1.0, F.col("m") == 1).collect()}
    assert got["a"].mse == 0 and got["a"].masked_mse == 0 and abs(got["a"].psnr - 120) < 1e-9 and got["b"].bias == -2 and got["b"].masked_mse == 4
    same = metrics.global_ssim(df.filter("band = 'a'"), ["band"], "p", "t", 1.0).first()
    assert abs(same.ssim - 1) < 1e-12


def test_class_scores_ignore_a_label(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (255, 0), (2, 0)], "t int, p int")
    got = {r["class"]: (r.tp, r.fp, r.fn) for r in metrics.class_scores(df, "t", "p", 255).collect()}
    assert got == {0: (1, 1, 1), 1: (1, 1, 0), 2: (0, 0, 1)}


def test_append_new_skips_what_is_there(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.lit(1))
    sinks.append_new(df, f"{tmp_path}/out", ["id"])
    sinks.append_new(spark.range(8).withColumn("v", F.lit(2)), f"{tmp_path}/out", ["id"])
    assert values(spark.read.parquet(f"{tmp_path}/out"), "id", "v") == [(i, 1 if i < 5 else 2) for i in range(8)]
    grouped = sinks.grouped_by_prefix(spark.createDataFrame([(1, 2, 3)], "id int, abi_a int, abi_b int"), {"abi_": "abi"})
    assert grouped.first().abi.b == 3


def test_metadata_files_and_missing_members(spark, tmp_path):
    (tmp_path / "m.csv").write_text("datetime,system_id,center_y,center_x,latitude,longitude,longitude_norm,satellite,inside_inner_disk\n2020-01-01 00:20:00,1,2,3,4.5,5.5,5.5,east, True \n")
    row = files.read_metadata(spark, str(tmp_path / "m.csv")).first()
    assert row.inside_inner_disk is True and row.file == "m.csv" and row.datetime == T(2020, 1, 1, 0, 20)
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "k string, m string")
    assert [tuple(r) for r in files.missing_members(df, ["k"], "m", ["x", "y"]).collect()] == [("b", ["y"])]
    assert files.synthetic(spark.range(3), "id", 4).collect() == files.synthetic(spark.range(3).repartition(3), "id", 4).orderBy("id").collect()


def test_stream_gives_the_closed_windows(spark, tmp_path):
    rows = [(i, T(2024, 1, 1, i // 60, i % 60), "view", 1.0) for i in range(0, 300, 7)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    events.write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got, want = set(values(spark.table("windows"), "start", "n")), set(values(windowed_counts(events), "start", "n"))
    assert got <= want and len(want) - len(got) <= 2
    assert first_arrivals(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), ["event_id"], "ts", "5 minutes").isStreaming
