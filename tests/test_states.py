import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.functions import geo
from orbitweave.operators import arrays, metrics, states
from orbitweave.sources import sinks, staged
from tests.plans import scans, shuffled


def test_an_early_stop_opens_few_files(spark, tmp_path):
    path = f"{tmp_path}/ordered"
    rows = [(g, i) for g in range(200) for i in range(1 + g * 7 % 11)] + [(3, 1000 + i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, i int").repartition(8)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        staged.write_ordered(df, path, ["g"], ["i"])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    seen, want = {}, []
    for g, i in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        if seen[g] <= 4:
            want.append((g, i))
    opened = []
    for limit in (1, 14, 30, 300, 10**6):
        found = staged.first_of_groups(spark, path, ["g"], ["i"], 4, limit)
        assert [tuple(r) for r in found.collect()] == want[:limit]
        opened.append(len(staged.needed_files(spark, path, ["g"], 4, limit)))
        assert sum(n for n, _ in scans(found)) == opened[-1]
    assert opened == sorted(opened) and opened[0] == 1 and opened[1] <= 3 and 4 < opened[-1] < 10  # most of 20 files, those of group 3, are never needed
    assert staged.first_of_groups(spark, path, ["g"], ["i"], 4, 0).collect() == []


def test_writes_skip_known_keys(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/once"
    of = lambda rows: spark.createDataFrame(rows, "k string, j long, v string")
    told = lambda df: sorted(((r.k or "", r.j, r.created) for r in df.collect()))
    with pytest.raises(ValueError, match="nothing is written"):
        sinks.read_written(spark, path)
    first = sinks.write_new(of([("a", 1, "x"), ("a", 1, "y"), (None, 2, "z")]), path, ["k", "j"])
    assert told(first) == [("", 2, True), ("a", 1, True)]
    second = sinks.write_new(of([("a", 1, "other"), ("a", 2, "n"), (None, 2, "other")]), path, ["k", "j"])
    assert told(second) == [("", 2, False), ("a", 1, False), ("a", 2, True)]
    paths = {r.created: r.path for r in second.collect()}
    assert paths[True] != paths[False] and spark.read.parquet(paths[False]).count() == 3
    monkeypatch.setattr(sinks, "MOST_ASKED", 0)
    assert told(sinks.write_new(of([("a", 2, "other")]), path, ["k", "j"])) == [("a", 2, False)]
    assert sorted(r.v for r in sinks.read_written(spark, path).collect()) == ["n", "x", "y", "z"]
    of([("b", 9, "lost")]).write.parquet(f"{path}/data/commit=unfinished")  # rows of a write that failed before its log
    assert sinks.read_written(spark, path).count() == 4
    assert told(sinks.write_new(of([("b", 9, "again")]), path, ["k", "j"])) == [("b", 9, True)]


def test_a_write_reads_only_the_log(spark, tmp_path):
    path = f"{tmp_path}/once"
    rows = spark.range(5000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 200).alias("v"))
    sinks.write_new(rows, path, ["k"])
    log = spark.read.parquet(f"{path}/log")
    assert log.columns == ["k", "hash", "commit", "bucket"] and log.count() == 5000
    again = sinks.write_new(rows.filter("k < 10").union(spark.createDataFrame([(-1, "y")], "k long, v string")), path, ["k"])
    assert sorted((r.k, r.created) for r in again.collect()) == [(-1, True)] + [(i, False) for i in range(10)]


def test_states_of_runs_merge_to_one_run(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(int(b), float(p), float(t), bool(m)) for b, p, t, m in zip(rng.integers(0, 3, 3000), rng.normal(size=3000), rng.normal(1000, 5, 3000), rng.random(3000) < 0.3)]
    data += [(7, float("nan"), 1.0, True), (7, 2.0, 5.0, False), (8, None, None, True)]
    df = spark.createDataFrame(data, "band int, pred double, target double, masked boolean")
    one = lambda rows, file: states.band_states(rows, ["band", file], "pred", "target", F.col("masked"))
    added = []
    for part in (df.limit(1000), df.subtract(df.limit(1000))):
        part.repartition(3).write.mode("append").parquet(f"{tmp_path}/rows")
        added.append(states.add_new_files(spark, f"{tmp_path}/rows", f"{tmp_path}/states", one))
    assert added == [3, 3] and states.add_new_files(spark, f"{tmp_path}/rows", f"{tmp_path}/states", one) == 0
    rows = spark.read.parquet(f"{tmp_path}/rows")
    whole = states.band_report(states.band_states(rows, ["band"], "pred", "target", F.col("masked")), ["band"], 10.0).drop("sketch")
    parts = states.band_report(states.merged(spark.read.parquet(f"{tmp_path}/states"), ["band"]), ["band"], 10.0).drop("sketch")
    a, b = ({r.band: r for r in x.collect()} for x in (whole, parts))
    assert a.keys() == b.keys() == {0, 1, 2, 7, 8}
    for k in a:
        assert all(x is y is None or x == pytest.approx(y, rel=1e-9) for x, y in zip(a[k], b[k]))
    assert b[7].masked_count == 0 and b[7].visible_mse == 9 and b[7].full_count == 1 and b[8].full_mse == 0


@pytest.mark.parametrize("kind", ["normal", "few values", "rising"])
def test_sketches_keep_their_rank_error_over_merges(spark, tmp_path, kind):
    n = 60_000
    x = {"normal": F.randn(3), "few values": (F.rand(3) * 7).cast("int").cast("double"), "rising": F.col("id").cast("double")}[kind]
    df = spark.range(0, n, 1, 12).select((F.col("id") % 2).alias("band"), x.alias("target"), F.lit(0.0).alias("pred"), F.spark_partition_id().alias("file"))
    df.write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    held = states.merged(states.band_states(df, ["band", "file"], "pred", "target", F.lit(True)), ["band"])
    shares = [0.01, 0.25, 0.5, 0.9, 0.98]
    found = {r.band: r.q for r in held.select("band", F.array(*states.quantiles("sketch", shares)).alias("q")).collect()}
    values = {b: np.sort([r.target for r in df.filter(F.col("band") == b).collect()]) for b in (0, 1)}
    for b, qs in found.items():
        for p, q in zip(shares, qs):
            low, high = np.searchsorted(values[b], q, "left") / len(values[b]), np.searchsorted(values[b], q, "right") / len(values[b])
            assert low - 2 * states.RANK_ERROR <= p <= high + 2 * states.RANK_ERROR


def plain_ssim(p, t, w, r):
    n = max(w.sum(), 1.0)
    mp, mt = (p * w).sum() / n, (t * w).sum() / n
    vp, vt, c = (((p - mp) ** 2) * w).sum() / n, (((t - mt) ** 2) * w).sum() / n, ((p - mp) * (t - mt) * w).sum() / n
    c1, c2 = (0.01 * r) ** 2, (0.03 * r) ** 2
    return (2 * mp * mt + c1) * (2 * c + c2) / max((mp**2 + mt**2 + c1) * (vp + vt + c2), 1e-12)


def test_reconstruction_statistics_match_plain(spark):
    rng = np.random.default_rng(2)
    rows = [(b, f, float(p), float(t), bool(m)) for b in range(3) for f in range(4) for p, t, m in zip(rng.normal(1e6, 1e-2, 30), rng.normal(1e6, 1e-2, 30), rng.random(30) < (0.5 if f else 0))]
    rows += [(5, 0, 3.0, 3.0, True)] * 4
    df = spark.createDataFrame(rows, "band int, frame int, pred double, target double, masked boolean")
    got = {r.band: r for r in metrics.reconstruction_metrics(df, ["band"], ["frame"], "pred", "target", F.col("masked"), 0.05).collect()}
    for band, r in got.items():
        b, f, p, t, m = (np.array(x) for x in zip(*[x for x in rows if x[0] == band]))
        for name, w in (("masked", m.astype(float)), ("visible", 1.0 - m), ("full", np.ones(len(m)))):
            n = max(w.sum(), 1.0)
            mse = (((p - t) ** 2) * w).sum() / n
            ssim = np.mean([plain_ssim(p[f == i], t[f == i], w[f == i], 0.05) for i in sorted(set(f))])
            want = (w.sum(), mse, math.sqrt(mse), (abs(p - t) * w).sum() / n, ((p - t) * w).sum() / n, 10 * math.log10(0.05**2 / max(mse, 1e-12)), ssim)
            assert [r[f"{name}_{c}"] for c in ("count", "mse", "rmse", "mae", "bias", "psnr", "ssim")] == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert r.target_mean == pytest.approx(t.mean()) and r.prediction_mean == pytest.approx(p.mean())
    # without rows the product of the constants, 0.5625e-12, is over the floor of 1e-12
    assert got[5].visible_count == 0 and got[5].visible_ssim == pytest.approx(0.5625) and got[5].masked_psnr == pytest.approx(10 * math.log10(0.0025 / 1e-12))


def test_weighted_similarity_is_centred_and_bears_empty_masks(spark):
    rng = np.random.default_rng(4)
    rows = [("a" if i % 2 else None, float(p), float(t), float(w)) for i, (p, t, w) in enumerate(zip(rng.normal(1e8, 1, 200), rng.normal(1e8, 1, 200), rng.random(200)))] + [("empty", 5.0, 2.0, 0.0)] * 3
    df = spark.createDataFrame(rows, "g string, x double, y double, w double")
    got = {r.g: r.ssim for r in metrics.global_ssim(df, ["g"], "x", "y", 4.0, F.col("w")).collect()}
    for g in ("a", None, "empty"):
        p, t, w = (np.array(x) for x in list(zip(*[r for r in rows if r[0] == g]))[1:])
        assert got[g] == pytest.approx(plain_ssim(p, t, w, 4.0), rel=1e-6)


def test_weighted_similarity_shuffles_sums_and_not_rows(spark, tmp_path):
    """Rows of two groups that are joined with their means go to two tasks, half the table each."""
    rows = spark.range(0, 40_000, 1, 4).select((F.col("id") % 2).alias("g"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("y"), (F.col("id") % 7).alias("w"))
    rows.write.parquet(f"{tmp_path}/x")
    df = metrics.global_ssim(spark.read.parquet(f"{tmp_path}/x"), ["g"], "x", "y", 100.0, F.col("w"))
    assert len(df.collect()) == 2
    assert [n for _, n in scans(df)] == [40_000] and sum(shuffled(df)) <= 2 * 4


def test_weighted_similarity_bears_fills_nulls_and_light_weights(spark):
    rng = np.random.default_rng(5)
    rows = [("fills", *((p, t, 1.0 + i % 3) if i % 4 else (1e30, -9999.0, 0.0))) for i, (p, t) in enumerate(rng.normal(1e6, 1, (200, 2)).tolist())]
    rows += [("light", p, t, 1e-4 * (1 + i % 3)) for i, (p, t) in enumerate(rng.normal(300, 1, (50, 2)).tolist())]
    nulls = [(p if i % 3 else None, t if i % 5 else None, 1.0 + i % 2) for i, (p, t) in enumerate(rng.normal(300, 1, (200, 2)).tolist())]
    df = spark.createDataFrame(rows + [("nulls", *r) for r in nulls] + [("apart", 1.0, None, 1.0), ("apart", None, 2.0, 1.0)], "g string, x double, y double, w double")
    got = {r.g: r.ssim for r in metrics.global_ssim(df, ["g"], "x", "y", 4.0, F.col("w")).collect()}
    for g in ("fills", "light"):
        p, t, w = (np.array(x) for x in list(zip(*[r for r in rows if r[0] == g]))[1:])
        assert got[g] == pytest.approx(plain_ssim(p, t, w, 4.0), rel=1e-9)
    # a null stays out of the sums that it takes part in, its weight counts
    p, t, w = (np.array([np.nan if v is None else v for v in x]) for x in zip(*nulls))
    mean = lambda v: np.nansum(v * w) / w.sum()
    mp, mt = mean(p), mean(t)
    vp, vt, c = mean((p - mp) ** 2), mean((t - mt) ** 2), mean((p - mp) * (t - mt))
    assert got["nulls"] == pytest.approx((2 * mp * mt + 0.04**2) * (2 * c + 0.12**2) / ((mp**2 + mt**2 + 0.04**2) * (vp + vt + 0.12**2)), rel=1e-9)
    assert got["apart"] is None


def test_the_sun_in_leap_years(spark):
    """Values by the same series in plain floats: a leap year divides by 366."""

    def plain(t, lat, lon):
        h = t.hour + t.minute / 60 + t.second / 3600 + t.microsecond / 3.6e9
        days = 366 if t.year % 4 == 0 and (t.year % 100 or t.year % 400 == 0) else 365
        g = 2 * math.pi / days * (t.timetuple().tm_yday - 1 + (h - 12) / 24)
        eq = 229.18 * (0.000075 + 0.001868 * math.cos(g) - 0.032077 * math.sin(g) - 0.014615 * math.cos(2 * g) - 0.040849 * math.sin(2 * g))
        tilt = 0.006918 - 0.399912 * math.cos(g) + 0.070257 * math.sin(g) - 0.006758 * math.cos(2 * g) + 0.000907 * math.sin(2 * g) - 0.002697 * math.cos(3 * g) + 0.00148 * math.sin(3 * g)
        a, p = math.radians((h * 60 + eq + 4 * lon) / 4 - 180), math.radians(lat)
        return math.degrees(math.acos(max(-1, min(1, math.sin(p) * math.sin(tilt) + math.cos(p) * math.cos(tilt) * math.cos(a)))))

    times = [dt.datetime(2024, 9, 22, 12, 0, 41, 500_000), dt.datetime(2023, 9, 22, 12, 0, 41), dt.datetime(2024, 1, 30, 12), dt.datetime(2000, 12, 31, 23, 59, 59), dt.datetime(1900, 7, 1, 3, 4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, ts timestamp_ntz")
    hour = F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts)") / 3.6e9
    got = {r.i: (r.z, r.days) for r in df.select("i", geo.year_days("ts").alias("days"), geo.solar_zenith(F.dayofyear("ts"), hour, F.lit(30.0), F.lit(7.5), geo.year_days("ts")).alias("z")).collect()}
    assert [got[i][1] for i in range(5)] == [366, 365, 366, 366, 365]
    assert [got[i][0] for i in range(5)] == pytest.approx([plain(t, 30.0, 7.5) for t in times], abs=1e-7)


def test_chip_layouts_match_numpy(spark):
    rng = np.random.default_rng(5)
    shapes = [(2, 4, 3, 5), (2, 3, 5, 4), (1, 6, 3, 3), (2, 3, 2, 9), (1, 4, 4, 4), (3, 1, 1, 4), (2, 9, 1, 4)]
    chips = [rng.normal(size=s) for s in shapes]
    chips[0][0, 0, 0, 0] = float("nan")
    df = spark.createDataFrame([(i, c.ravel().tolist(), list(c.shape)) for i, c in enumerate(chips)], "i int, a array<double>, s array<int>")
    for r in df.select("i", arrays.channels_first(F.col("a"), F.col("s"), 4).alias("x")).collect():
        c = chips[r.i]
        c = c if c.shape[1] == 4 else np.moveaxis(c, 3, 1) if c.shape[3] == 4 else c[:, :4] if c.shape[1] > 4 else np.moveaxis(c[..., :4], 3, 1)
        assert r.x == np.nan_to_num(c).ravel().tolist()
    for bad in ([1.0] * 8, [2, 2, 2, 1]), ([1.0], [1]):
        with pytest.raises(Exception, match="no axis of 4 channels"):
            spark.createDataFrame([bad], "a array<double>, s array<int>").select(arrays.channels_first(F.col("a"), F.col("s"), 4)).collect()
