"""Queries on file names, catalogues, time keys and written tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.operators import spatial, temporal
from orbitweave.plans.registry import LAT, LON, query, table
from orbitweave.session import shared_dir
from orbitweave.sources import files, scan_catalogue, sinks

r6 = lambda c: F.round(c, 6)
#: Names of scan files made from the events: a channel, a platform, and the start of their hour.
NAMES = "SELECT event_id, ts, printf('OR_RadF-M6C%02d_G%02d_s%s', event_id % 16 + 1, 16 + event_id % 2, strftime(date_trunc('hour', ts), '%Y%j%H%M%S')) AS name FROM events"
SCANS = f"SELECT DISTINCT regexp_extract(name, 'C(..)_', 1)::INTEGER AS channel, regexp_extract(name, '_(G..)_', 1) AS platform, strptime(regexp_extract(name, '_s([0-9]+)', 1), '%Y%j%H%M%S') AS scan_time FROM ({NAMES})"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_format(F.date_trunc("HOUR", "ts"), "yyyyDDDHHmmss")
    name = F.format_string("OR_RadF-M6C%02d_G%02d_s%s", F.col("event_id") % 16 + 1, 16 + F.col("event_id") % 2, start)
    return table(spark, sf_dir, "events").select("event_id", "ts", name.alias("name"))


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_scan_fields(_names(spark, sf_dir), "name").select("channel", "platform", "scan_time").distinct()


@query(f"SELECT event_id, regexp_extract(name, 'C(..)_', 1)::INTEGER AS channel, regexp_extract(name, '_(G..)_', 1) AS platform, strptime(regexp_extract(name, '_s([0-9]+)', 1), '%Y%j%H%M%S') AS scan_time, substr(name, 12, 2)::INTEGER AS by_place, regexp_replace(name, '[^0-9]', '', 'g') AS digits FROM ({NAMES})")
def scan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of scan names by pattern and by place, and their digits alone."""
    named = files.with_scan_fields(_names(spark, sf_dir), "name")
    return named.select("event_id", "channel", "platform", "scan_time", files.at_place("name", 11, 13).cast("int").alias("by_place"), F.regexp_replace("name", "[^0-9]", "").alias("digits"))


@query(f"""WITH s AS (SELECT scan_time, count(DISTINCT channel) AS n FROM ({SCANS}) WHERE platform = 'G16' GROUP BY 1 HAVING count(DISTINCT channel) = 8), e AS (SELECT event_id, ts FROM events WHERE event_type = 'error'),
  p AS (SELECT event_id, scan_time, abs(epoch_us(ts) - epoch_us(scan_time)) AS apart FROM e JOIN s ON scan_time BETWEEN ts - INTERVAL 900 SECOND AND ts + INTERVAL 900 SECOND)
  SELECT event_id, scan_time, apart FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY apart, scan_time) AS nth FROM p) WHERE nth = 1""")
def nearest_complete_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest scan within 15 minutes that has all eight channels of its platform."""
    scans = _scans(spark, sf_dir).filter("platform = 'G16'")
    complete = temporal.complete_groups(scans, F.col("scan_time"), "scan_time", "channel", 8).select("scan_time", F.lit(0).alias("scan"))
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "ts")
    return temporal.nearest_in_time(e, complete, "event_id", "ts", "scan_time", "scan", 900).select("event_id", "scan_time", F.col("abs_micros").alias("apart"))


@query(f"SELECT scan_time, string_agg(channel || platform, ',' ORDER BY channel, platform) AS members FROM ({SCANS}) WHERE year(scan_time) = 2024 AND dayofyear(scan_time) = 2 AND hour(scan_time) BETWEEN 3 AND 9 GROUP BY 1")
def scans_of_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue written by year, day and hour, of which a few hours are read."""
    keyed = _scans(spark, sf_dir).withColumn("year", F.year("scan_time")).withColumn("doy", F.dayofyear("scan_time")).withColumn("hour", F.hour("scan_time"))
    path = f"{shared_dir(spark)}/scans-{uuid.uuid4().hex}"
    keyed.repartition("year", "doy", "hour").write.partitionBy("year", "doy", "hour").parquet(path)
    few = spark.read.parquet(path).filter("year = 2024 AND doy = 2 AND hour BETWEEN 3 AND 9")
    members = F.transform(F.array_sort(F.collect_list(F.struct("channel", "platform"))), lambda x: F.concat(x["channel"].cast("string"), x["platform"]))
    return few.groupBy("scan_time").agg(F.array_join(members, ",").alias("members"))


@query("SELECT DISTINCT dayofyear(ts)::INTEGER AS day, user_id % 9 AS orbit, count(*) OVER (PARTITION BY dayofyear(ts), user_id % 9) AS files FROM events WHERE dayofyear(ts) BETWEEN 1 AND 20 AND user_id % 9 IN (2, 5, 7)")
def distinct_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orbits of a range of days, each once, with how many files name it."""
    day, orbit = F.dayofyear("ts").alias("day"), (F.col("user_id") % 9).alias("orbit")
    return table(spark, sf_dir, "events").select(day, orbit).filter(F.col("day").between(1, 20) & F.col("orbit").isin(2, 5, 7)).groupBy("day", "orbit").agg(F.count("*").alias("files"))


@query("SELECT DISTINCT strftime(ts, '%Y-%j') AS day, event_type AS job FROM events")
def distinct_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-DDD").alias("day"), F.col("event_type").alias("job")).distinct()


@query("SELECT event_type, count(*) FILTER (value > 20) AS ok, count(*) FILTER (value <= 20) AS failed, sum(CASE WHEN value > 20 THEN event_id % 5 ELSE 0 END)::BIGINT AS saved FROM events GROUP BY 1")
def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("value") > 20
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col("event_id") % 5).otherwise(0)).alias("saved"))


@query("SELECT lang, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n) AS med, round(stddev_pop(n), 6) AS std FROM (SELECT lang, regexp_extract(printf('%s_len%d.npz', lang, n_chars), '_len([0-9]+)', 1)::BIGINT AS n FROM documents) GROUP BY 1")
def lengths_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a length that file names carry."""
    name = F.format_string("%s_len%d.npz", "lang", "n_chars")
    n = table(spark, sf_dir, "documents").select("lang", F.regexp_extract(name, "_len([0-9]+)", 1).cast("long").alias("n"))
    return n.groupBy("lang").agg(F.min("n").alias("least"), F.max("n").alias("most"), r6(F.avg("n")).alias("mean"), F.median("n").alias("med"), r6(F.stddev_pop("n")).alias("std"))


FILES = "SELECT DISTINCT ts::DATE AS day, 'daily' AS kind, (user_id % 4)::INTEGER AS collection FROM events WHERE event_type = 'purchase' AND value > 95 UNION SELECT DISTINCT date_trunc('month', ts)::DATE, 'monthly', (user_id % 4)::INTEGER FROM events"
CHOSEN = f"""SELECT day, collection, kind FROM (SELECT d.day, f.collection, f.kind, row_number() OVER (PARTITION BY d.day, f.collection ORDER BY f.kind) AS nth FROM (SELECT DISTINCT ts::DATE AS day FROM events) d JOIN ({FILES}) f ON f.day = CASE WHEN f.kind = 'daily' THEN d.day ELSE date_trunc('month', d.day)::DATE END WHERE f.collection < 3) WHERE nth = 1"""


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.trunc("ts", "month").alias("month"), (F.col("user_id") % 4).cast("int").alias("collection"), "event_type", "value")
    daily = e.filter("event_type = 'purchase' AND value > 95").select("day", F.lit("daily").alias("kind"), "collection").distinct()
    monthly = e.select(F.col("month").alias("day"), F.lit("monthly").alias("kind"), "collection").distinct()
    return files.preferred(e.select("day").distinct(), daily, monthly, "day", ["collection"]).filter("collection < 3")


@query(f"SELECT day::VARCHAR AS day, collection, kind FROM ({CHOSEN})")
def reanalysis_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day and collection the daily file, where there is one, else the month's."""
    return _chosen(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "collection", "kind")


FIELD = "SELECT i, j, t, avg(v) AS v FROM (SELECT (c_custkey % 19)::INTEGER AS i, (c_custkey % 36)::INTEGER AS j, (c_custkey % 4)::INTEGER AS t, c_acctbal AS v FROM customer) GROUP BY 1, 2, 3"


@query(f"""WITH e AS (SELECT event_id, least(greatest(ceil((({LAT})::DOUBLE + 90) / 10 - 0.5), 0), 18)::INTEGER AS i, (((ceil((({LON})::DOUBLE + 180) / 10 - 0.5)::INTEGER % 36) + 36) % 36)::INTEGER AS j, hour(ts) + minute(ts) / 60.0::DOUBLE AS h FROM events WHERE event_type = 'error'),
  n AS (SELECT *, CASE WHEN h <= 3 THEN 0 WHEN h <= 9 THEN 1 WHEN h <= 15 THEN 2 ELSE 3 END::INTEGER AS t FROM e), f AS ({FIELD}) SELECT event_id, n.i, n.j, n.t, round(coalesce(f.v, c.v), 6) AS v, f.v IS NULL AS from_constant, round((n.i * 500 + n.j) / 9.80665, 6) AS height
  FROM n LEFT JOIN f ON f.i = n.i AND f.j = n.j AND f.t = n.t LEFT JOIN (SELECT i, avg(v) AS v FROM f GROUP BY 1) c ON c.i = n.i""")
def reanalysis_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field at the nearest grid point and six-hourly time, the earlier of two as near; a constant field where it has none."""
    lat, lon, hour = F.expr(LAT).cast("double"), F.expr(LON).cast("double"), F.hour("ts") + F.minute("ts") / 60.0
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        "event_id", spatial.regular_axis_index(lat, -90.0, 10.0, 19).alias("i"), spatial.regular_axis_index(lon, -180.0, 10.0, 36, wraps=True).alias("j"), spatial.axis_index(hour, [0.0, 6.0, 12.0, 18.0]).alias("t"))
    at = lambda n: (F.col("c_custkey") % n).cast("int")
    field = table(spark, sf_dir, "customer").groupBy(at(19).alias("i"), at(36).alias("j"), at(4).alias("t")).agg(F.avg("c_acctbal").alias("v"))
    constant = field.groupBy("i").agg(F.avg("v").alias("constant"))
    found = e.join(field, ["i", "j", "t"], "left").join(constant, "i", "left")
    return found.select("event_id", "i", "j", "t", r6(F.coalesce("v", "constant")).alias("v"), F.col("v").isNull().alias("from_constant"), r6((F.col("i") * 500 + F.col("j")) / 9.80665).alias("height"))


def _slot(ts: str, minutes: int) -> str:
    m = f"round_even((epoch_us({ts}) - epoch_us(date_trunc('hour', {ts}))) / 60000000.0 / {minutes}, 0)::INTEGER * {minutes}"
    return f"date_trunc('hour', {ts}) + (CASE WHEN hour({ts}) = 23 AND {m} = 60 THEN {60 - minutes} ELSE {m} END) * INTERVAL 1 MINUTE"


@query(f"SELECT event_id, {_slot('ts', 10)} AS by_ten, {_slot('ts', 15)} AS by_fifteen, n FROM (SELECT *, count(*) OVER (PARTITION BY {_slot('ts', 10)}) AS n FROM events)")
def rounded_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at the nearest 10 and 15 minutes, and how many share the first: what passes the hour carries, but not past the day."""
    e = table(spark, sf_dir, "events").select("event_id", temporal.rounded_slot("ts", 10).alias("by_ten"), temporal.rounded_slot("ts", 15).alias("by_fifteen"))
    return e.join(e.groupBy("by_ten").agg(F.count("*").alias("n")), "by_ten").select("event_id", "by_ten", "by_fifteen", "n")


@query("""SELECT event_id, year(t)::INTEGER AS year, dayofyear(t)::INTEGER AS doy, round(hour(t) + minute(t) / 60.0, 6)::DOUBLE AS hours FROM (SELECT event_id, make_date(2023 + (event_id % 3)::INTEGER, 1, 1)::TIMESTAMP + (event_id % 365)::INTEGER * INTERVAL 1 DAY + (event_id % 24)::INTEGER * INTERVAL 1 HOUR + (event_id % 5000 - 2500)::INTEGER * INTERVAL 1 MINUTE AS t FROM events)""")
def shifted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, day of year and fractional hour moved by minutes, over the ends of days and leap years."""
    e = F.col("event_id")
    t = temporal.of_day_of_year((2023 + e % 3).cast("int"), (e % 365 + 1).cast("int"), e % 24 + (e % 5000 - 2500) / 60)
    shifted = table(spark, sf_dir, "events").select("event_id", t.alias("t"))
    return shifted.select("event_id", F.year("t").alias("year"), F.dayofyear("t").alias("doy"), r6(F.hour("t") + F.minute("t") / 60.0).alias("hours"))


@query(f"SELECT event_id, CASE WHEN abs(lat) <= 23.5 THEN 'tropics' WHEN abs(lat) <= 60 THEN 'middle' ELSE 'polar' END AS zone FROM (SELECT event_id, ({LAT})::DOUBLE AS lat FROM events) WHERE abs(lat) <= 60")
def copies_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written apart by zone, of which two zones are read back."""
    size = F.abs(F.expr(LAT).cast("double"))
    zone = F.when(size <= 23.5, "tropics").when(size <= 60, "middle").otherwise("polar")
    path = f"{shared_dir(spark)}/zones-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select("event_id", zone.alias("zone")).write.partitionBy("zone").parquet(path)
    return spark.read.parquet(path).filter(F.col("zone").isin("tropics", "middle")).select("event_id", "zone")


@query("SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*)::INTEGER AS num_time_steps, (count(*) * 20)::INTEGER AS duration_min, count(*) FILTER (event_id % 2 = 0) AS members FROM events GROUP BY 1")
def lifetimes_and_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetimes and their records written as CSV by date of their files, read back by a pattern, and paired."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyyMMdd")
    life = e.groupBy(F.col("user_id").cast("int").alias("system_id")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").cast("int").alias("num_time_steps"), (F.count("*") * 20).cast("int").alias("duration_min"))
    sinks.write_csv(life, f"{path}/lifetimes")
    meta = e.select(F.col("ts").alias("datetime"), F.col("user_id").cast("int").alias("system_id"), (F.col("event_id") % 200).cast("int").alias("center_y"), F.lit(0).alias("center_x"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"),
                    F.lit(0.0).alias("longitude_norm"), F.lit("east").alias("satellite"), (F.col("event_id") % 2 == 0).cast("string").alias("inside_inner_disk"), day.alias("day"))
    sinks.write_csv(meta, f"{path}/metadata", ["day"])
    read = files.read_metadata(spark, f"{path}/metadata/day=*")
    pairs = files.read_lifetimes(spark, f"{path}/lifetimes").join(read.filter("inside_inner_disk").groupBy("system_id").agg(F.count("*").alias("members")), "system_id", "left")
    return pairs.select(F.col("system_id").cast("long").alias("user_id"), "start_time", "end_time", "num_time_steps", "duration_min", F.coalesce("members", F.lit(0)).alias("members"))


@query("""SELECT event_type, '{"count":' || count(*) || ',"first":' || min(event_id) || ',"name":"' || event_type || '"}' AS manifest, count(*) AS n FROM events GROUP BY 1""")
def json_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest a run as JSON with its keys in order, written and read back."""
    runs = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("count"), F.min("event_id").alias("first"))
    path = f"{shared_dir(spark)}/manifests-{uuid.uuid4().hex}"
    sinks.write_manifests(runs.withColumn("name", F.col("event_type")).select("name", "first", "count"), path)
    back = spark.read.text(path).select(F.col("value").alias("manifest"), F.from_json("value", "count long, name string").alias("m"))
    return back.select(F.col("m.name").alias("event_type"), "manifest", F.col("m.count").alias("n"))


ASKED = "SELECT event_id, ts, 'G' || (16 + event_id % 2) AS platform FROM events WHERE value > 95"


def _catalogue(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    scan_catalogue.write_catalogue(_scans(spark, sf_dir), path)
    return path


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value > 95")
    return e.select("event_id", "ts", F.format_string("G%d", 16 + F.col("event_id") % 2).alias("platform"))


@query(f"""SELECT event_id, count(*) AS scans, count(*) FILTER (s.platform = a.platform) AS own, min(scan_time) AS first_scan FROM ({ASKED}) a JOIN ({SCANS}) s
  ON date_trunc('hour', scan_time) BETWEEN date_trunc('hour', ts) - INTERVAL 1 HOUR AND date_trunc('hour', ts) + INTERVAL 1 HOUR GROUP BY 1""")
def scans_by_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans of the hour before, of and after each request; only folders of asked hours are opened."""
    asked = _asked(spark, sf_dir).withColumnRenamed("platform", "own_platform")
    met = scan_catalogue.scans_by_request(spark, _catalogue(spark, sf_dir), asked, "ts")
    return met.groupBy("event_id").agg(F.count("*").alias("scans"), F.count_if(F.col("platform") == F.col("own_platform")).alias("own"), F.min("scan_time").alias("first_scan"))


@query(f"""WITH s AS (SELECT platform, scan_time FROM ({SCANS}) GROUP BY 1, 2 HAVING count(DISTINCT channel) >= 2),
  p AS (SELECT event_id, scan_time, abs(epoch_us(ts) - epoch_us(scan_time)) AS apart FROM ({ASKED}) a JOIN s USING (platform) WHERE scan_time BETWEEN ts - INTERVAL 3000 SECOND AND ts + INTERVAL 3000 SECOND)
  SELECT event_id, scan_time, apart FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY apart, scan_time) AS nth FROM p) WHERE nth = 1""")
def nearest_requested_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest scan of a request's platform within 50 minutes that has two channels at least, from the folders of its candidate hours."""
    found = scan_catalogue.nearest_complete(spark, _catalogue(spark, sf_dir), _asked(spark, sf_dir), "event_id", "ts", 2, 3000)
    return found.select("event_id", "scan_time", F.col("abs_micros").alias("apart"))


DAYS = f"SELECT DISTINCT platform, channel, dayofyear(scan_time)::INTEGER AS doy FROM ({SCANS})"


def _archives(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Two archives with a folder for each day's scans of a channel group: the near one lacks every third day."""
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    folders = ["platform", "doy"]
    keyed = _scans(spark, sf_dir).select("platform", F.dayofyear("scan_time").alias("doy"), "channel", "scan_time")
    keyed.repartition(*folders).write.partitionBy(*folders).parquet(f"{path}/far")
    keyed.filter("doy % 3 <> 0 AND NOT (platform = 'G17' AND doy % 4 = 1)").repartition(*folders).write.partitionBy(*folders).parquet(f"{path}/near")
    return f"{path}/near", f"{path}/far"


@query(f"SELECT DISTINCT platform, doy, CASE WHEN doy % 3 = 0 OR platform = 'G17' AND doy % 4 = 1 THEN 'far' ELSE 'near' END AS source FROM ({DAYS}) WHERE doy BETWEEN 2 AND 19")
def listed_near_else_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of scans by the names of their folders, of the near archive, else of the far one; no file is opened."""
    each = [scan_catalogue.listing(spark, p, "*.parquet").filter("doy BETWEEN 2 AND 19").select("platform", "doy").distinct().withColumn("source", F.lit(n)) for p, n in zip(_archives(spark, sf_dir), ("near", "far"))]
    return files.local_first(*each, ["platform", "doy"])


@query(f"SELECT doy, count(DISTINCT platform)::INTEGER AS have, CASE WHEN count(*) FILTER (platform = 'G16') = 0 THEN 'G16 ' ELSE '' END || CASE WHEN count(*) FILTER (platform = 'G17') = 0 THEN 'G17 ' ELSE '' END || 'G18' AS missing FROM ({DAYS}) WHERE doy % 3 <> 0 AND NOT (platform = 'G17' AND doy % 4 = 1) GROUP BY 1")
def audited_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three platforms each day of an archive lacks, by the listing of its folders."""
    near, _ = _archives(spark, sf_dir)
    return scan_catalogue.audited(scan_catalogue.listing(spark, near), ["doy"], "platform", ["G16", "G17", "G18"]).select("doy", "have", F.array_join("missing", " ").alias("missing"))
