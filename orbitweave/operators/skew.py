"""Keys with more rows than a partition should hold, and dealing their rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.session import durable

#: Rows that a key may have before it is dealt out, whatever the number of partitions.
LEAST = 10_000


def hot_keys(df: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame:
    """(keys, __deal) of keys with more than ``least`` rows and more than a shuffle partition's share of all rows.

    Fewer keys than there are shuffle partitions can have that many, so the table may be broadcast whatever the input.
    ``__deal`` is the number of parts whose rows are again within the larger of the two.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = durable(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    large = max(least, total // parts)
    return durable(counts.filter(F.col("__n") > large).select(*keys, F.ceil(F.col("__n") / large).cast("int").alias("__deal")))


def parted(df: DataFrame, hot: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """``df`` with ``__part``: 0, or for rows of hot keys a part by the hash of ``number``, which should differ from row to row."""
    met = df.join(F.broadcast(hot), keys, "left")
    return met.withColumn("__part", F.coalesce(F.pmod(F.xxhash64(number), F.col("__deal")), F.lit(0)).cast("int")).drop("__deal")


def copied(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``__part``: a row once, or once for each part of a hot key."""
    met = df.join(F.broadcast(hot), keys, "left")
    return met.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__deal", F.lit(1)) - 1))).drop("__deal")
