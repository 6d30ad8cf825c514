"""Layers, grids, patches and embeddings held in arrays or long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layer_mask(layers: Column, count: Column, bins: int, width: float, clip: bool = True) -> Column:
    """The class of each bin as an array: 0 where clear, all -1 where ``count`` is negative, as the retrieval is missing.

    ``layers`` is an array of (base, top, kind) in order; the first ``count`` of them that have a base cover the bins
    floor(base / width) to floor(top / width), and a later layer wins. Without ``clip`` it is the older rule: layers end
    at the first negative base, and missing retrievals are clear.
    """
    at = lambda x: F.floor(x / width).cast("int")
    if clip:
        used = F.filter(F.slice(layers, 1, F.greatest(count, F.lit(0))), lambda x: x["base"] >= 0)
    else:
        ends = F.array_position(F.transform(layers, lambda x: x["base"] < 0), True)
        used = F.when(ends > 0, F.slice(layers, 1, F.greatest(ends.cast("int") - 1, F.lit(0)))).otherwise(layers)
    spans = F.transform(used, lambda x: F.struct(F.greatest(at(x["base"]), F.lit(0)).alias("first"), F.least(at(x["top"]), F.lit(bins - 1)).alias("last"), x["kind"].cast("int").alias("kind")))

    def over(mask: Column, s: Column) -> Column:
        laid = F.concat(F.slice(mask, F.lit(1), s["first"]), F.array_repeat(s["kind"], s["last"] - s["first"] + 1), F.slice(mask, s["last"] + 2, F.lit(bins)))
        return F.when(s["first"] <= s["last"], laid).otherwise(mask)

    mask = F.aggregate(spans, F.array_repeat(F.lit(0), bins), over)
    return F.when(count < 0, F.array_repeat(F.lit(-1), bins)).otherwise(mask) if clip else mask


def rasterise(layers: DataFrame, keys: list[str], base: str, top: str, kind: str, order: str, bins: int, width: float) -> DataFrame:
    """(keys, bin, kind) of the bins that layers cover, by the rule of :func:`layer_mask`; the later layer by ``order`` wins.

    Layers are gathered before they are spread over bins, so that a layer is shuffled once whatever it covers.
    """
    one = F.struct(F.col(order).alias("order"), F.col(base).alias("base"), F.col(top).alias("top"), F.col(kind).alias("kind"))
    held = layers.filter(F.col(base) >= 0).groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("__layers"))
    mask = held.select(*keys, F.posexplode(layer_mask(F.col("__layers"), F.size("__layers"), bins, width)).alias("bin", kind))
    return mask.filter(F.col(kind) != 0)


def binary_mask(kind: Column) -> Column:
    """1 where there is a class, 0 where clear, -1 kept."""
    return F.when(kind < 0, -1).otherwise((kind != 0).cast("int"))


def line_through(points: Column, at: Column) -> Column:
    """The value at ``at`` of straight lines between ``points``, an array of (x, y) in order of x; ends hold."""
    below, above = F.filter(points, lambda p: p["x"] <= at), F.filter(points, lambda p: p["x"] >= at)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    line = a["y"] + (b["y"] - a["y"]) * (at - a["x"]) / (b["x"] - a["x"])
    return F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == b["x"]), a["y"]).otherwise(line)


def interpolate(points: DataFrame, keys: list[str], x: str, y: str, grid: list[float], least: int = 2) -> DataFrame:
    """(keys, x, y) on ``grid`` by straight lines between neighbours, ends held.

    Only finite points with y above zero count, those of equal x as their mean; groups with fewer than ``least`` of them
    give zeros. A group's points travel once, as an array.
    """
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    good = px.isNotNull() & (py > 0) & ~bad(px) & ~bad(py)
    once = points.groupBy(*keys, F.when(good, px).alias("__x")).agg(F.avg(F.when(good, py)).alias("__y"), F.count_if(good).alias("__n"))
    point = F.when(F.col("__x").isNotNull(), F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))
    held = once.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("__points"), F.sum("__n").alias("__n"))
    axis = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    value = F.when(F.col("__n") >= least, line_through(F.col("__points"), F.col(x))).otherwise(0.0)
    return held.withColumn(x, axis).select(*keys, x, value.alias(y))


def patches(cells: DataFrame, row: str, col: str, size: int, columns: int) -> DataFrame:
    """Adds the patch of each cell and its place in it, both row by row."""
    patch = F.floor(F.col(row) / size) * (columns // size) + F.floor(F.col(col) / size)
    return cells.withColumn("patch", patch).withColumn("place", F.pmod(F.col(row), F.lit(size)) * size + F.pmod(F.col(col), F.lit(size)))


def unpatched(patch: Column, place: Column, size: int, columns: int) -> tuple[Column, Column]:
    """Row and column of a cell from its patch and its place in it: the way back from :func:`patches`."""
    wide = columns // size
    row = F.floor(patch / wide) * size + F.floor(place / size)
    return row, F.pmod(patch, F.lit(wide)) * size + F.pmod(place, F.lit(size))


def sincos(position: Column, dim: int) -> Column:
    """Sine then cosine embedding of a position, ``dim`` values."""
    half = dim // 2
    angle = lambda i: position / F.pow(F.lit(10000.0), i / F.lit(float(half)))
    ks = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(ks, lambda i: F.sin(angle(i))), F.transform(ks, lambda i: F.cos(angle(i))))


def rank_mask(df: DataFrame, keys: list[str], noise: Column, ratio: float) -> DataFrame:
    """Adds ``masked``: of each group of n rows all but the int(n * (1 - ratio)) of least noise."""
    by = Window.partitionBy(*keys)
    keep = F.floor(F.count(F.lit(1)).over(by) * (1 - ratio))
    return df.withColumn("masked", (F.row_number().over(by.orderBy(noise)) > keep).cast("int"))


def dimension_statistics(df: DataFrame, vector: str) -> DataFrame:
    """(dim, low, high, mean, std) of each place of a vector column, population deviation; NaN is left out."""
    long = df.select(F.posexplode(vector).alias("dim", "x")).select("dim", F.nanvl(F.col("x").cast("double"), F.lit(None)).alias("x"))
    return long.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def centred(a: Column, size: int, fill: Column) -> Column:
    """An array padded on both sides, or cut around its middle, to ``size``; the odd element goes to the end."""
    n = F.size(a)
    left = F.floor((size - n) / 2).cast("int")
    padded = F.concat(F.array_repeat(fill, left), a, F.array_repeat(fill, size - n - left))
    return F.when(n <= size, padded).otherwise(F.slice(a, F.floor((n - size) / 2).cast("int") + 1, size))


def permuted(a: Column, shape: tuple[int, ...], axes: tuple[int, ...]) -> Column:
    """A row-major array of ``shape`` with its axes in the order ``axes``."""
    strides = [1] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        strides[k] = strides[k + 1] * shape[k + 1]
    places = [0]
    for k in axes:
        places = [p + i * strides[k] for p in places for i in range(shape[k])]
    return gather(a, places)


def checked(a: Column, size: int, what: str) -> Column:
    """An array of ``size`` elements; raises where it has another."""
    return F.when(F.size(a) == size, a).otherwise(F.raise_error(F.concat(F.lit(f"{what} has "), F.size(a).cast("string"), F.lit(f" elements, not {size}"))))


def zipped(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Two aligned arrays as one of structs; raises where their lengths differ."""
    short = F.raise_error(F.concat(F.lit("arrays of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" elements")))
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.struct(x.alias(names[0]), y.alias(names[1])))).otherwise(short)


def gather(a: Column, places: list[int]) -> Column:
    """The elements of an array at ``places``, from 0, in that order; null beyond its end."""
    return F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get(a, i))


def channels_first(a: Column, shape: Column, channels: int) -> Column:
    """A row-major chip of (time, channels, rows, columns) from one whose channel axis its ``shape`` of four tells.

    The second axis is it where it has ``channels`` places, else the last where that has; else the second where it has
    more, else the last, and the first ``channels`` places are taken. NaN becomes 0. Raises where no axis fits.
    """
    dim = lambda i: F.get(shape, F.lit(i))
    second = (dim(1) == channels) | ((dim(3) != channels) & (dim(1) > channels))
    last = ~second & (dim(3) >= channels)
    rows, cols = F.when(second, dim(2)).otherwise(dim(1)), F.when(second, dim(3)).otherwise(dim(2))

    def source(i: Column) -> Column:
        x, y, c, t = i % cols, F.floor(i / cols) % rows, F.floor(i / (rows * cols)) % channels, F.floor(i / (rows * cols * channels))
        of_second = ((t * dim(1) + c) * dim(2) + y) * dim(3) + x
        of_last = ((t * dim(1) + y) * dim(2) + x) * dim(3) + c
        return F.when(second, of_second).otherwise(of_last).cast("int")

    values = F.transform(F.sequence(F.lit(0), dim(0) * channels * rows * cols - 1), lambda i: F.nanvl(F.get(a, source(i)), F.lit(0.0)))
    bad = F.raise_error(F.concat(F.lit(f"no axis of {channels} channels in "), shape.cast("string")))
    return F.when((F.size(shape) == 4) & (second | last), values).otherwise(bad.cast("array<double>"))
