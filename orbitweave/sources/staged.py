"""Reads that stop early: what each file holds is known beforehand, so that only files that are needed are opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_ordered(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Writes ``df`` in files that follow each other in the order of ``keys`` and ``order``, and what each holds of every group."""
    df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).write.parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    rows.groupBy(F.col("_metadata.file_name").alias("file"), *keys).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")


def needed_files(spark: SparkSession, path: str, keys: list[str], per_group: int, limit: int) -> list[str]:
    """The files that hold the first ``per_group`` rows of the first groups, until ``limit`` rows are there.

    Counts are summed by group over its files, then over files: a row a file.
    """
    counts = spark.read.parquet(f"{path}/counts")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier(Window.partitionBy(*keys).orderBy("file"))), F.lit(0))
    takes = counts.select("file", F.greatest(F.least(per_group - before, F.col("n")), F.lit(0)).alias("take"))
    files = takes.groupBy("file").agg(F.sum("take").alias("take"))
    so_far = F.coalesce(F.sum("take").over(earlier(Window.orderBy("file"))), F.lit(0))
    found = files.withColumn("so_far", so_far).filter((F.col("take") > 0) & (F.col("so_far") < limit)).orderBy("file")
    return [f"{path}/rows/{r.file}" for r in found.collect()]  # at most ``limit``


def first_of_groups(spark: SparkSession, path: str, keys: list[str], order: list[str], per_group: int, limit: int) -> DataFrame:
    """Of what :func:`write_ordered` wrote the first ``per_group`` rows of each group, groups in order, ``limit`` rows in all."""
    files = needed_files(spark, path, keys, per_group, limit)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/rows").limit(0)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).filter(F.col("__nth") <= per_group).orderBy(*keys, *order).limit(limit).drop("__nth")
