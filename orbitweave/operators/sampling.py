"""Picking representative records of groups, splits and masks, all by stable rules instead of random draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.session import durable


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys)
    return df.withColumn("__pos", F.row_number().over(by.orderBy(*order)) - 1).withColumn("__size", F.count(F.lit(1)).over(by))


def middle_record(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The record at position size // 2 of each group; ``order`` should be total."""
    return _placed(df, keys, order).filter(F.col("__pos") == F.floor(F.col("__size") / 2)).drop("__pos", "__size")


def balanced_anchor(df: DataFrame, keys: list[str], order: list[str], bin_of: Column) -> DataFrame:
    """One record of each group at 1/8, 3/8, 5/8 or 7/8 of its life, by the group's bin modulo 4.

    The position is fraction * (size - 1), rounded half to even.
    """
    share = F.element_at(F.array(*[F.lit(x) for x in (0.125, 0.375, 0.625, 0.875)]), (F.pmod(bin_of, F.lit(4)) + 1).cast("int"))
    return _placed(df, keys, order).filter(F.col("__pos") == F.rint(share * (F.col("__size") - 1))).drop("__pos", "__size")


def sample_records(df: DataFrame, keys: list[str], order: list[str], mode: str, bin_of: Column | None = None) -> DataFrame:
    """Dispatch on ``mode``: 'middle', 'balanced' (needs ``bin_of``) or 'all'."""
    if mode == "all":
        return df
    if mode == "middle":
        return middle_record(df, keys, order)
    if mode == "balanced" and bin_of is not None:
        return balanced_anchor(df, keys, order, bin_of)
    raise ValueError(f"no sampling mode {mode!r}")


def with_dense_index(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """Adds the place of each row by ``key`` (one column or several, distinct), from 0, without a window over the whole table.

    Rows are range-partitioned by key and numbered in their part; parts are told apart by an id in key order, and the
    sizes of the parts before, one row a part, are added. The numbered rows are written once, so that both see the same parts.
    """
    keys = [key] if isinstance(key, str) else key
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    parts = durable(parts.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return parts.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__id", "__part", "__at", "__start")


def balanced_classes(df: DataFrame, cls: str, order: list[str], factor: float = 1.25) -> DataFrame:
    """Of each class the first rows by ``order``, at most ``factor`` times as many as the smallest class has.

    The least size comes from one aggregate, of a row a class. A class is ranked in hashed parts first, of which each keeps
    as many rows as the class may, so that a class far larger than the smallest is never sorted in one task.
    """
    most = df.groupBy(cls).agg(F.count("*").alias("__n")).agg(F.floor(F.lit(factor) * F.min("__n"))).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts))).withColumn("__nth", nth(cls, "__part")).filter(F.col("__nth") <= most)
    return few.withColumn("__nth", nth(cls)).filter(F.col("__nth") <= most).drop("__nth", "__part")
