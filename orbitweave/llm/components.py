"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from orbitweave.session import durable


def _towards_least(edges: DataFrame) -> DataFrame:
    """Large star: every neighbour larger than ``u`` is tied to the least node around ``u``."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _through_smaller(edges: DataFrame) -> DataFrame:
    """Small star: ``u`` and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Each node of ``edges`` (u, v; any comparable type) but the roots, with the least node of its component.

    Returns (u, v) with v the root. Self links, nulls, repeated and reversed edges do no harm; an empty table
    gives an empty one. Per-node minima are combined before the shuffle, so a hub costs one row a task; each
    round is written to the shared folder, and its count and sum of hashes are observed on the way.
    """
    now = durable(edges.filter("u is not null and v is not null and u <> v").select("u", "v").distinct())
    seen = None
    for _ in range(max_rounds):
        watch = Observation()
        sums = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("sum")
        now = durable(_through_smaller(_towards_least(now)).observe(watch, *sums))
        state = watch.get
        if state == seen:
            return now
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
