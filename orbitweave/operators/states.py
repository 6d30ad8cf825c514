"""Aggregates kept by file and merged when they are read, so that a new run reads only new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from orbitweave.functions.scaling import psnr
from orbitweave.sources.scan_catalogue import listing

#: Size of a quantile sketch; its ranks are off by less than RANK_ERROR in 99 of 100 cases.
SKETCH_K = 400
RANK_ERROR = 0.01
REGIONS = ("masked", "visible", "full")


def add_new_files(spark: SparkSession, source: str, states: str, aggregate: Callable[[DataFrame, str], DataFrame]) -> int:
    """Appends the states of files at ``source`` that ``states`` has none of; how many files they were.

    ``aggregate(rows, file)`` gives a state by group and by the column ``file``. A file is told by its path: one that is
    written anew under another name counts again, and one whose rows give no group is read again.
    """
    listed = listing(spark, source, "*.parquet").select(F.col("_metadata.file_path").alias("file"))
    try:
        listed = listed.join(spark.read.parquet(states).select("file").distinct(), "file", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = [r.file for r in listed.collect()]  # names, as the driver lists them for any scan
    if new:
        rows = spark.read.parquet(*new).withColumn("file", F.col("_metadata.file_path"))
        aggregate(rows, "file").write.mode("append").parquet(states)
    return len(new)


def band_states(df: DataFrame, by: list[str], pred: str, target: str, masked: Column, k: int = SKETCH_K) -> DataFrame:
    """(by, sums of squared, absolute and plain errors of masked, visible and all rows, sums and extremes of the target, its sketch).

    NaN and null pairs count nowhere.
    """
    good = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    p, t = good(pred), good(target)
    e = p - t
    on = {"masked": masked, "visible": ~masked, "full": F.lit(True)}
    sums = []
    for r in REGIONS:
        x = F.when(on[r], e)
        sums += [F.count(x).alias(f"{r}_count"), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{r}_{n}") for n, v in (("sse", x * x), ("sae", F.abs(x)), ("se", x))]]
    return df.groupBy(*by).agg(*sums, F.sum(F.when(e.isNotNull(), t)).alias("target_sum"), F.sum(F.when(e.isNotNull(), p)).alias("pred_sum"), F.min(t).alias("low"), F.max(t).alias("high"), F.kll_sketch_agg_double(t, F.lit(k)).alias("sketch"))


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    """One state of each group: sums add up, extremes and sketches merge."""
    sums = [c for c in states.columns if c.endswith(("_count", "_sse", "_sae", "_se", "_sum"))]
    return states.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))


def band_report(state: DataFrame, by: list[str], value_range: float) -> DataFrame:
    """count, mse, rmse, mae, bias and psnr of masked, visible and all rows, the means, extremes and sketch; no rows count as one."""
    out = []
    for r in REGIONS:
        n = F.greatest(F.col(f"{r}_count"), F.lit(1))
        mse = F.col(f"{r}_sse") / n
        out += [F.col(f"{r}_count"), mse.alias(f"{r}_mse"), F.sqrt(mse).alias(f"{r}_rmse"), (F.col(f"{r}_sae") / n).alias(f"{r}_mae"), (F.col(f"{r}_se") / n).alias(f"{r}_bias"), psnr(mse, max(value_range, 1e-6)).alias(f"{r}_psnr")]
    n = F.greatest("full_count", F.lit(1))
    return state.select(*by, *out, (F.col("target_sum") / n).alias("target_mean"), (F.col("pred_sum") / n).alias("prediction_mean"), "low", "high", "sketch")


def quantiles(sketch: str, shares: list[float]) -> list[Column]:
    """The values of a sketch at ``shares``; ranks are off by RANK_ERROR or so, whatever the number of rows or merges."""
    return [F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))) for p in shares]
