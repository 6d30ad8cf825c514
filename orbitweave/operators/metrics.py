"""Reconstruction, regression and segmentation metrics as single aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.functions.scaling import psnr


def finite(x: str) -> Column:
    """A column with NaN as null, so that aggregates leave it out."""
    return F.when(~F.isnan(x), F.col(x))


def error_metrics(df: DataFrame, by: list[str], pred: str, target: str, value_range: float, masked: Column | None = None) -> DataFrame:
    """n, mse, rmse, mae, bias, psnr of each group over all rows, and mse of masked and visible ones."""
    e = F.col(pred).cast("double") - F.col(target)
    m = masked if masked is not None else F.lit(True)
    mean = lambda x, on: F.coalesce(F.avg(F.when(on, x)), F.lit(0.0))
    sums = df.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), mean(e * e, m).alias("masked_mse"), mean(e * e, ~m).alias("visible_mse")
    )
    return sums.withColumn("rmse", F.sqrt("mse")).withColumn("psnr", psnr(F.col("mse"), value_range))


def _ssim(mx: Column, my: Column, vx: Column, vy: Column, cxy: Column, value_range: float) -> Column:
    c1, c2 = (0.01 * value_range) ** 2, (0.03 * value_range) ** 2
    top = (2 * mx * my + c1) * (2 * cxy + c2)
    return top / F.greatest((mx * mx + my * my + c1) * (vx + vy + c2), F.lit(1e-12))


def reconstruction_metrics(df: DataFrame, by: list[str], frame: list[str], pred: str, target: str, masked: Column, value_range: float) -> DataFrame:
    """Of masked, visible and all rows of each group: count, mse, rmse, mae, bias, psnr and ssim; and the means of both columns.

    Similarity is of each frame, with the group's rows of one ``frame``, and its mean is given; a frame without rows of a
    kind counts as 1, as its means and variances are 0. Errors without rows are 0. Sums and centred moments come from one
    aggregate by group and frame, and a second of a row a frame.
    """
    value_range = max(value_range, 1e-6)
    p, t = F.col(pred).cast("double"), F.col(target).cast("double")
    on, sums, outs = {"masked": masked, "visible": ~masked, "full": F.lit(True)}, [], []
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for r, m in on.items():
        a, b = F.when(m, p), F.when(m, t)
        e = a - b
        similar = _ssim(zero(F.avg(a)), zero(F.avg(b)), zero(F.var_pop(a)), zero(F.var_pop(b)), zero(F.covar_pop(a, b)), value_range)
        sums += [F.count(e).alias(f"{r}_n"), F.sum(e * e).alias(f"{r}_sse"), F.sum(F.abs(e)).alias(f"{r}_sae"), F.sum(e).alias(f"{r}_se"), similar.alias(f"{r}_ssim")]
        n = F.greatest(F.sum(f"{r}_n"), F.lit(1))
        mse = zero(F.sum(f"{r}_sse")) / n
        outs += [F.sum(f"{r}_n").alias(f"{r}_count"), mse.alias(f"{r}_mse"), F.sqrt(mse).alias(f"{r}_rmse"), (zero(F.sum(f"{r}_sae")) / n).alias(f"{r}_mae"), (zero(F.sum(f"{r}_se")) / n).alias(f"{r}_bias"),
                 psnr(mse, value_range).alias(f"{r}_psnr"), F.avg(f"{r}_ssim").alias(f"{r}_ssim")]
    frames = df.groupBy(*by, *frame).agg(*sums, F.sum(t).alias("__t"), F.sum(p).alias("__p"))
    n = F.greatest(F.sum("full_n"), F.lit(1))
    return frames.groupBy(*by).agg(*outs, (F.sum("__t") / n).alias("target_mean"), (F.sum("__p") / n).alias("prediction_mean"))


def global_ssim(df: DataFrame, by: list[str], x: str, y: str, value_range: float, weight: Column | None = None) -> DataFrame:
    """Structural similarity of each group from its means and population (co)variances, rows weighted where ``weight`` is given.

    Weighted moments come from one aggregate too, and no row is joined with its group's means: over n rows the sum of w (a - ma) (b - mb)
    is n (cov(wa, b) - ma cov(w, b) + (avg(b) - mb) avg(w (a - ma))), whatever ma and mb are. These covariances are centred as they are
    summed, both by the same running mean of b, so the digits that are lost grow with the mean over the deviation, not with its square.
    Rows of weight 0 stay out of them, whatever they hold; weights that add up to less than 1 count as 1.
    """
    if weight is None:
        s = df.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
        return s.select(*by, _ssim(*[F.col(c) for c in ("mx", "my", "vx", "vy", "cxy")], value_range).alias("ssim"))
    x, y, total = F.col(x).cast("double"), F.col(y).cast("double"), F.greatest(F.sum(weight), F.lit(1.0))
    mx, my = F.sum(weight * x) / total, F.sum(weight * y) / total

    def moment(a: Column, b: Column, ma: Column, mb: Column) -> Column:
        known = a.isNotNull() & b.isNotNull() & weight.isNotNull()
        w = F.when(known & (weight != 0), weight)
        centred = F.count(w) * (F.covar_pop(w * a, b) - ma * F.covar_pop(w, b)) + (F.avg(F.when(w.isNotNull(), b)) - mb) * (F.sum(w * a) - ma * F.sum(w))
        return F.coalesce(centred / total, F.max(F.when(known, 0.0)))  # 0 where all weights are

    return df.groupBy(*by).agg(_ssim(mx, my, moment(x, x, mx, mx), moment(y, y, my, my), moment(x, y, mx, my), value_range).alias("ssim"))


def regression_metrics(df: DataFrame, by: list[str], pred: str, target: str, wet: float) -> DataFrame:
    """mae, bias, the same where the target reaches ``wet``, and Pearson's correlation; 0 where nothing counts."""
    e = F.col(pred) - F.col(target)
    on = F.col(target) >= wet
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return df.groupBy(*by).agg(
        zero(F.avg(F.abs(e))).alias("mae"), zero(F.avg(e)).alias("bias"), zero(F.avg(F.when(on, F.abs(e)))).alias("wet_mae"), zero(F.avg(F.when(on, e))).alias("wet_bias"), zero(F.corr(pred, target)).alias("corr")
    )


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(true_class, pred_class, n, share): counts of class pairs, and their share of the true class."""
    n = df.groupBy(F.col(true).alias("true_class"), F.col(pred).alias("pred_class")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true_class")))


def class_scores(df: DataFrame, true: str, pred: str, ignore: int | None = None) -> DataFrame:
    """(class, tp, fp, fn, iou, f1, dice) by class from one pass; undefined ratios are null, dice then is 1."""
    kept = df.filter(F.col(true).isNotNull() & F.col(pred).isNotNull())
    if ignore is not None:
        kept = kept.filter(F.col(true) != ignore)
    pairs = kept.groupBy(true, pred).agg(F.count("*").alias("n"))
    both = F.array(F.struct(F.col(true).alias("class"), F.lit(True).alias("is_true")), F.struct(F.col(pred).alias("class"), F.lit(False).alias("is_true")))
    rows = pairs.select("n", (F.col(true) == F.col(pred)).alias("hit"), F.explode(both).alias("c")).select("n", "hit", "c.class", "c.is_true")
    add = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0))
    counts = rows.groupBy("class").agg(add(F.col("hit") & F.col("is_true")).alias("tp"), add(~F.col("hit") & ~F.col("is_true")).alias("fp"), add(~F.col("hit") & F.col("is_true")).alias("fn"))
    union, twice = F.col("tp") + F.col("fp") + F.col("fn"), 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.withColumn("iou", F.col("tp") / F.nullif(union, F.lit(0))).withColumn("f1", 2 * F.col("tp") / F.nullif(twice, F.lit(0))).withColumn("dice", (2 * F.col("tp") + 1e-6) / (twice + 1e-6))


def filled_histogram(df: DataFrame, cls: str, classes: int) -> DataFrame:
    """(class, n) for classes 0 to ``classes`` - 1, those without rows too."""
    n = df.groupBy(F.col(cls).cast("long").alias("class")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(classes).withColumnRenamed("id", "class").join(n, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def degenerate(x: str) -> Column:
    """Aggregate: whether a tile has no value, only zeros, or one value throughout."""
    return (F.count(x) == 0) | F.coalesce(F.max(F.abs(x)) == 0, F.lit(False)) | F.coalesce(F.stddev_pop(x) == 0, F.lit(False))


def losses(df: DataFrame, by: list[str], pred: str, target: str, logit: str, label: str, masked: Column) -> DataFrame:
    """mse, log1p_mse, masked_mae, max_abs and bce (of logits, in the form that can't overflow) by group; 0 where nothing counts."""
    p, t, x = F.col(pred), F.col(target), F.col(logit)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    bce = F.greatest(x, F.lit(0.0)) - x * F.col(label) + F.log1p(F.exp(-F.abs(x)))
    return df.groupBy(*by).agg(
        zero(F.avg((p - t) * (p - t))).alias("mse"), zero(F.avg(F.pow(F.log1p(p) - F.log1p(t), 2))).alias("log1p_mse"), zero(F.avg(F.when(masked, F.abs(p - t)))).alias("masked_mae"),
        zero(F.max(F.abs(p - t))).alias("max_abs"), zero(F.avg(bce)).alias("bce"),
    )


def binned_counts(df: DataFrame, by: list[str], x: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, n) of equal bins over [low, high); what lies beyond counts in the end bins."""
    at = F.least(F.greatest(F.floor((F.col(x) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("long")
    return df.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def binned_counts_2d(df: DataFrame, by: list[str], x: tuple[str, float, float, int], y: tuple[str, float, float, int]) -> DataFrame:
    """(by, x, y, n): :func:`binned_counts` on two axes, each a column with its low, high and bins."""
    at = lambda c, low, high, bins: F.least(F.greatest(F.floor((F.col(c) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("long")
    return df.groupBy(*by, at(*x).alias("x"), at(*y).alias("y")).agg(F.count("*").alias("n"))


def boxplot(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, q1, med, q3, low, high, outliers): quartiles, the furthest values within 1.5 boxes of them, and how many lie beyond.

    Equal values are counted first, so that quartiles and whiskers come from one table of distinct values.
    """
    n = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("__x")).agg(F.count("*").alias("__n"))
    q = n.groupBy(*by).agg(F.percentile("__x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("__n")).alias("q"))
    q = q.select(*by, *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "med", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("__x") >= F.col("q1") - reach) & (F.col("__x") <= F.col("q3") + reach)
    low = F.min(F.when(F.col("__x") >= F.col("q1") - reach, F.col("__x")))
    high = F.max(F.when(F.col("__x") <= F.col("q3") + reach, F.col("__x")))
    return n.join(q, by).groupBy(*by, "q1", "med", "q3").agg(low.alias("low"), high.alias("high"), F.coalesce(F.sum(F.when(~inside, F.col("__n"))), F.lit(0)).alias("outliers"))


def contrast_limits(df: DataFrame, by: list[str], x: str, factor: float) -> DataFrame:
    """(by, low, high): the percentiles 50 -/+ 25 * factor, kept within 0 and 100."""
    share = lambda p: min(max(p, 0.0), 100.0) / 100
    q = df.groupBy(*by).agg(F.percentile(x, F.array(F.lit(share(50 - 25 * factor)), F.lit(share(50 + 25 * factor)))).alias("q"))
    return q.select(*by, F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
