"""Joins and expansions in time. Timestamps may lack a zone; differences are in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970, of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def candidates_in_tolerance(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, tolerance_s: int, by: list[str] | None = None) -> DataFrame:
    """All pairs at most ``tolerance_s`` apart, with their distance as ``abs_micros``.

    An equi-join on time buckets as wide as the tolerance: each right row is dealt to its bucket and both neighbours,
    so the join shuffles on (by, bucket) and never compares all pairs. Column names of the sides must differ, but for ``by``.
    """
    width = tolerance_s * 1_000_000
    bucket = lambda ts: F.floor(micros(ts) / width).cast("long")
    asked = left.withColumn("__bucket", bucket(left_ts))
    offered = right.withColumn("__own", bucket(right_ts)).withColumn("__bucket", F.explode(F.array(F.col("__own") - 1, F.col("__own"), F.col("__own") + 1))).drop("__own")
    apart = F.abs(micros(left_ts) - micros(right_ts))
    return asked.join(offered, [*(by or []), "__bucket"]).withColumn("abs_micros", apart).filter(F.col("abs_micros") <= width).drop("__bucket")


def nearest_in_time(left: DataFrame, right: DataFrame, left_key: str, left_ts: str, right_ts: str, right_key: str, tolerance_s: int, by: list[str] | None = None, rank: int = 1) -> DataFrame:
    """The ``rank`` nearest right rows of each left row within the tolerance, as ``nth`` from 1; ties to the earlier, then the smaller key.

    Each side is sorted once in buckets of time, in which right rows of one time are one entry of at most ``rank`` keys,
    numbered in order. A left row meets the ``rank`` entries on either side of it by their numbers, so that work follows
    the rows, not the pairs within the tolerance. Column names of the sides must differ, but for ``by``.
    """
    width, by = tolerance_s * 1_000_000, by or []
    bucket = lambda ts: F.floor(micros(ts) / width).cast("long")
    first = F.row_number().over(Window.partitionBy(*by, right_ts).orderBy(right_key))
    others = [c for c in right.columns if c not in by]
    entries = right.withColumn("__n", first).filter(F.col("__n") <= rank).groupBy(*by, F.col(right_ts).alias("__ts")).agg(F.collect_list(F.struct(*others)).alias("__right"))
    entries = entries.withColumn("__bucket", F.explode(F.sequence(bucket("__ts") - 1, bucket("__ts") + 1)))
    mine = [c for c in left.columns if c not in by]
    asked = left.select(*by, F.col(left_ts).alias("__ts"), F.struct(*mine).alias("__left"), bucket(left_ts).alias("__bucket"))
    order = Window.partitionBy(*by, "__bucket").orderBy("__ts", F.col("__left").isNotNull())  # at one time entries come first
    placed = entries.unionByName(asked, allowMissingColumns=True).withColumn("__seq", F.sum(F.when(F.col("__left").isNull(), 1).otherwise(0)).over(order))
    entry = placed.filter("__left IS NULL").select(*by, "__bucket", "__seq", "__right")
    wanted = placed.filter("__left IS NOT NULL").select(*by, "__bucket", "__left", F.explode(F.sequence(F.col("__seq") - (rank - 1), F.col("__seq") + rank)).alias("__seq"))
    pairs = wanted.join(entry, [*by, "__bucket", "__seq"]).select(*by, "__left.*", F.inline("__right"))
    pairs = pairs.withColumn("abs_micros", F.abs(micros(left_ts) - micros(right_ts))).filter(F.col("abs_micros") <= width)
    nth = F.row_number().over(Window.partitionBy(left_key).orderBy("abs_micros", right_ts, right_key))
    return pairs.withColumn("nth", nth).filter(F.col("nth") <= rank)


def complete_groups(df: DataFrame, group: Column, name: str, member: str, required: int) -> DataFrame:
    """Groups that hold all ``required`` distinct members."""
    return df.groupBy(group.alias(name)).agg(F.count_distinct(member).alias("n_members"), F.count("*").alias("n_rows")).filter(F.col("n_members") == required)


def frames(df: DataFrame, ts: str, count: int, event_index: int, step_minutes: int) -> DataFrame:
    """``count`` rows a record, ``step_minutes`` apart, with the record's own time at ``event_index``."""
    at = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    return df.withColumn("frame", at).withColumn("frame_ts", F.col(ts) + F.make_dt_interval(mins=(F.col("frame") - event_index) * step_minutes))


def slot_of_day(ts: str, seconds: int = 1200) -> tuple[Column, Column]:
    """(date, slot): the nearest slot of the day, halves up; what rounds past midnight is slot 0 of the next day."""
    second = F.expr(f"timestampdiff(SECOND, date_trunc('DAY', {ts}), {ts})")
    slot = F.floor(second / seconds + 0.5).cast("int")
    last = 86400 // seconds
    return F.when(slot == last, F.date_add(F.to_date(ts), 1)).otherwise(F.to_date(ts)), F.when(slot == last, 0).otherwise(slot)


def at_offsets(df: DataFrame, ts: str, minutes: list[int]) -> DataFrame:
    """A row for each record and offset: minutes, frame_ts."""
    each = df.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in minutes])))
    return each.withColumn("frame_ts", F.col(ts) + F.make_dt_interval(mins=F.col("minutes")))


def rounded_slot(ts: str, minutes: int) -> Column:
    """The time rounded to the nearest ``minutes`` of its hour, halves to even; what would pass 24:00 stays in the day's last slot."""
    hour = F.date_trunc("HOUR", F.col(ts))
    past = (micros(ts) - micros("date_trunc('HOUR', " + ts + ")")) / 60_000_000
    slot = (F.rint(past / minutes) * minutes).cast("int")
    late = (F.hour(ts) == 23) & (slot == 60)
    return (hour + F.make_dt_interval(mins=F.when(late, 60 - minutes).otherwise(slot))).cast("timestamp_ntz")


def of_day_of_year(year: Column, day: Column, hours: Column) -> Column:
    """The timestamp of a year, day of year and fractional hour of day, to the second; days and hours may carry."""
    return F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz") + F.make_dt_interval(days=day - 1, secs=F.round(hours * 3600).cast("decimal(18,6)"))
