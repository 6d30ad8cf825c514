"""Runs of successive records: islands, tracks, windows along a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.functions.geo import haversine_km


def islands(df: DataFrame, keys: list[str], day: str, most_gap: int = 1) -> DataFrame:
    """Adds ``island``: within each key a new one begins where the gap to the day before exceeds ``most_gap`` days."""
    w = Window.partitionBy(*keys).orderBy(day)
    starts = F.when(F.datediff(day, F.lag(day).over(w)) <= most_gap, 0).otherwise(1)
    return df.withColumn("__starts", starts).withColumn("island", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def inside_run(df: DataFrame, keys: list[str], order: list[str], inside: Column, anchor: Column) -> DataFrame:
    """The unbroken run of rows that are ``inside`` around each key's anchor row, which has to be inside."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = F.sum(F.when(inside, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("__in", inside).withColumn("__run", run).withColumn("__anchor", anchor)
    home = F.max(F.when(F.col("__anchor") & F.col("__in"), F.col("__run"))).over(Window.partitionBy(*keys))
    return marked.withColumn("__home", home).filter(F.col("__in") & (F.col("__run") == F.col("__home"))).drop("__in", "__run", "__anchor", "__home")


def sliding_windows(df: DataFrame, keys: list[str], order: list[str], size: int, stride: int, aggregates: dict[str, Column]) -> DataFrame:
    """Centres from size // 2 by ``stride`` whose window [c - size // 2, c - size // 2 + size) lies in the group."""
    by = Window.partitionBy(*keys)
    w, half = by.orderBy(*order), size // 2
    span = w.rowsBetween(-half, size - half - 1)
    placed = df.withColumn("center", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(by))
    for name, c in aggregates.items():
        placed = placed.withColumn(name, c.over(span))
    fits = (F.col("center") >= half) & (F.col("center") < F.col("__n") - half) & ((F.col("center") - half) % stride == 0)
    return placed.filter(fits).drop("__n")


def along_track(df: DataFrame, keys: list[str], order: list[str], lat: str, lon: str) -> DataFrame:
    """Adds the great-circle kilometres from each key's first point, along its points."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.coalesce(haversine_km(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)), F.lit(0.0))
    return df.withColumn("__step", step).withColumn("track_km", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def first_seen(df: DataFrame, cell: list[str], order: list[str]) -> DataFrame:
    """The first row of each cell."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).filter("__nth = 1").drop("__nth")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """Of each group the rows at round(linspace(0, n - 1, count)), halves to even; all rows of smaller groups."""
    by = Window.partitionBy(*keys)
    placed = df.withColumn("__pos", F.row_number().over(by.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(by))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (count - 1)))
    return placed.filter((F.col("__n") <= count) | F.array_contains(wanted, F.col("__pos").cast("double"))).drop("__pos", "__n")


def typical_step(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """(keys, step): the median of the positive distances between neighbours along each key's order."""
    apart = F.abs(F.col(x) - F.lag(x).over(Window.partitionBy(*keys).orderBy(*order)))
    return df.select(*keys, apart.alias("__apart")).filter("__apart > 0").groupBy(*keys).agg(F.median("__apart").alias("step"))


def with_repeats(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Adds pos, the place of each row in its group, and again: whether its group had ``same`` values before."""
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    nth = F.row_number().over(Window.partitionBy(*keys, *same).orderBy(*order))
    return df.withColumn("pos", pos).withColumn("again", nth > 1)


def cut_to_length(df: DataFrame, keys: list[str], order: list[str], same: list[str], length: int) -> DataFrame:
    """Groups of more than ``length`` rows cut to it: rows that repeat ``same`` values go first, else others too, evenly spaced in order.

    What goes of m rows are those at round(i * (m - 1) / (k - 1)), halves to even, for the k to go.
    """
    kind, group = Window.partitionBy(*keys, "again"), Window.partitionBy(*keys)
    rows = with_repeats(df, keys, order, same).withColumn("__m", F.count("*").over(kind)).withColumn("__j", F.row_number().over(kind.orderBy("pos")) - 1)
    need, repeats = F.count("*").over(group) - length, F.count_if("again").over(group)
    rows = rows.withColumn("__need", need).withColumn("__d", repeats)
    k = F.when(F.col("again"), F.least("__need", "__d")).otherwise(F.col("__need") - F.col("__d"))
    at = lambda i: F.when(F.col("__k") == 1, 0.0).otherwise(F.rint(i * (F.col("__m") - 1) / (F.col("__k") - 1)))
    # the i that may round to a row's own place is next to its place over the spacing, which is 1 at least
    near = F.rint(F.col("__j") * (F.col("__k") - 1) / F.greatest(F.col("__m") - 1, F.lit(1)))
    goes = (F.col("__k") > 0) & F.exists(F.array(*[F.least(F.greatest(near + d, F.lit(0.0)), (F.col("__k") - 1).cast("double")) for d in (-1, 0, 1)]), lambda i: at(i) == F.col("__j"))
    return rows.withColumn("__k", k).filter(~goes).drop("__m", "__j", "__need", "__d", "__k", "pos", "again")
