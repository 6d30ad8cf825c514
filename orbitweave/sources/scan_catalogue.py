"""A catalogue of scans in folders by year, day of year and hour, read by what requests ask for.

Requests name hours; these reach the scan as a dynamic partition filter, so that only the folders of asked hours are
opened. Listings parse folder names without opening files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.operators.temporal import nearest_in_time
from orbitweave.session import durable

HOUR = ["year", "doy", "hour"]
#: Asked hours are broadcast up to this number, which is 114 years of them; beyond it they are joined by shuffle.
MOST_HOURS = 1_000_000


def hour_keys(df: DataFrame, ts: str) -> DataFrame:
    """``df`` with the year, day of year and hour of a timestamp."""
    return df.withColumn("year", F.year(ts)).withColumn("doy", F.dayofyear(ts)).withColumn("hour", F.hour(ts))


def write_catalogue(scans: DataFrame, path: str, ts: str = "scan_time") -> None:
    """Appends ``scans`` to the catalogue: a file a task and hour, rows in order of time."""
    hour_keys(scans, ts).repartition(*HOUR).sortWithinPartitions(*HOUR, ts).write.mode("append").partitionBy(*HOUR).parquet(path)


def candidate_hours(requests: DataFrame, ts: str, around: int = 1) -> DataFrame:
    """``requests`` once for each hour from ``around`` before its own to ``around`` after it, over the ends of days and years."""
    shift = F.explode(F.sequence(F.lit(-around), F.lit(around)))
    hours = requests.withColumn("__shift", shift).withColumn("__at", F.date_trunc("HOUR", F.col(ts)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("__shift")))
    return hour_keys(hours, "__at").drop("__shift", "__at")


def asked_scans(spark: SparkSession, path: str, requests: DataFrame, ts: str, around: int = 1) -> DataFrame:
    """Scans of the catalogue in the candidate hours of any request, each once."""
    hours = durable(candidate_hours(requests.select(ts), ts, around).select(*HOUR).distinct())
    few = hours.filter("hour BETWEEN 0 AND 23 AND year > 0")  # a filter that Spark takes for selective, so that it prunes by the join
    if hours.count() <= MOST_HOURS:
        few = F.broadcast(few)
    return spark.read.parquet(path).join(few, HOUR, "left_semi")


def scans_by_request(spark: SparkSession, path: str, requests: DataFrame, ts: str, around: int = 1) -> DataFrame:
    """Each request with each scan of its own candidate hours; column names must differ but for the hour's keys."""
    scans = asked_scans(spark, path, requests, ts, around)
    return candidate_hours(requests, ts, around).join(scans, HOUR).drop(*HOUR)


def nearest_complete(spark: SparkSession, path: str, requests: DataFrame, key: str, ts: str, required: int, tolerance_s: int, around: int = 1) -> DataFrame:
    """(key, scan_time, abs_micros): the nearest scan of each request's platform with ``required`` channels at least, ties to the earlier.

    ``requests`` has key, platform and a timestamp; the catalogue has platform, channel and scan_time.
    """
    scans = asked_scans(spark, path, requests, ts, around)
    whole = scans.groupBy("platform", "scan_time").agg(F.count_distinct("channel").alias("n")).filter(F.col("n") >= required)
    found = nearest_in_time(requests.select(key, ts, "platform"), whole.select("platform", "scan_time", F.lit(0).alias("scan")), key, ts, "scan_time", "scan", tolerance_s, ["platform"])
    return found.select(key, "scan_time", "abs_micros")


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime, folder fields): the files below ``path``, without opening any.

    Filters on the fields of folder names prune the listing; ``pattern`` holds for file names.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if pattern:
        files = files.option("pathGlobFilter", pattern)
    return files.load(path).drop("content")


def audited(listed: DataFrame, keys: list[str], member: str, required: list) -> DataFrame:
    """(keys, have, missing): by group the number of members there, and in order those of ``required`` that are not."""
    have = listed.groupBy(*keys).agg(F.sort_array(F.collect_set(member)).alias("__have"))
    wanted = F.array(*[F.lit(x) for x in required])
    return have.select(*keys, F.size("__have").alias("have"), F.array_except(wanted, "__have").alias("missing"))
