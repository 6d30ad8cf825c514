"""Reading records and scan catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "datetime TIMESTAMP_NTZ, system_id INT, center_y INT, center_x INT, latitude DOUBLE, longitude DOUBLE, longitude_norm DOUBLE, satellite STRING, inside_inner_disk STRING"
LIFETIMES = "system_id INT, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, num_time_steps INT, duration_min INT"
#: Fixed value: the pattern of scan file names (channel, platform, start token).
SCAN_NAME = r"-M\d+C(\d{2})_(G\d{2})_s(\d{13})"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Convection records from CSV, with the disk flag as a boolean and the file they come from."""
    rows = spark.read.schema(METADATA).csv(path, header=True).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("inside_inner_disk", F.lower(F.trim("inside_inner_disk")) == "true")


def read_lifetimes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIFETIMES).csv(path, header=True)


def with_scan_fields(df: DataFrame, name: str) -> DataFrame:
    """Adds channel, platform and scan_time of scan file names; nulls where a name doesn't fit."""
    part = lambda i: F.nullif(F.regexp_extract(name, SCAN_NAME, i), F.lit(""))
    return df.withColumn("channel", part(1).cast("int")).withColumn("platform", part(2)).withColumn("scan_time", F.to_timestamp_ntz(part(3), F.lit("yyyyDDDHHmmss")))


def at_place(name: str, first: int, last: int) -> Column:
    """The characters [first, last) of a name, counted from 0, as fixed-offset names are cut."""
    return F.substring(name, first + 1, last - first)


def preferred(days: DataFrame, daily: DataFrame, monthly: DataFrame, day: str, keys: list[str]) -> DataFrame:
    """(day, keys, kind): by day and keys the daily file where there is one, else that of the month's first day."""
    of_day = days.join(daily, day).select(day, *keys, "kind")
    of_month = days.withColumn("__month", F.trunc(day, "month")).join(monthly.withColumnRenamed(day, "__month"), "__month").select(day, *keys, "kind")
    return of_day.unionByName(of_month).groupBy(day, *keys).agg(F.min("kind").alias("kind"))  # 'daily' comes before 'monthly'


def first_present(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first of ``names`` that ``df`` has, for schemas that differ in spelling."""
    found = [F.col(n) for n in names if n in df.columns]
    if not found and default is None:
        raise ValueError(f"none of {names} in {df.columns}")
    return found[0] if found else default


def local_first(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Local rows, and remote ones of keys that local lacks."""
    return local.unionByName(remote.join(local, keys, "left_anti").select(*local.columns))


def missing_members(df: DataFrame, keys: list[str], member: str, required: list[str]) -> DataFrame:
    """(keys, missing) of groups that lack some of ``required``."""
    have = df.groupBy(*keys).agg(F.collect_set(member).alias("__have"))
    missing = F.sort_array(F.array_except(F.array(*[F.lit(r) for r in required]), "__have"))
    return have.select(*keys, missing.alias("missing")).filter(F.size("missing") > 0)


def synthetic(df: DataFrame, key: str, dim: int, seed: int = 42) -> DataFrame:
    """``df`` with ``vector``: ``dim`` numbers in [0, 1) drawn from each row's whole-number key, the same in every run and partitioning."""
    value = lambda i: F.pmod((F.col(key).cast("long") * dim + i + seed) * F.lit(2654435761), F.lit(1 << 32)) / float(1 << 32)
    return df.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value))
