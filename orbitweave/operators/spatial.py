"""Nearest neighbours, grids and boxes on a plane of degrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.functions.geo import longitude_apart
from orbitweave.session import durable

#: Places that a cell of a search may hold before it is split, and halvings of each axis to the first cells, and from a cell to its parts.
CELL_PLACES = 128
FIRST, STEP = 5, 4
#: The finest cells: so many bits an axis, of which the earth's round has 2 metres.
FINEST = 24
#: Rows up to which cells and places are broadcast, some 60 bytes each.
MOST_BROADCAST = 50_000
#: Masks and shifts that spread the bits of a 32-bit number.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _measure(measure: str, up: Column, aside: Column) -> Column:
    shrink = F.cos(F.radians("lat_a"))
    return {"l1_wrapped": up + aside, "l1": up + aside, "cos_squared": up * up + F.pow(aside * shrink, 2), "euclidean": F.sqrt(F.pow(up, 2) + F.pow(aside, 2))}[measure]


def _spread(x: Column) -> Column:
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _to_box(measure: str, near: bool, wraps: bool) -> Column:
    """Distance to the nearest, or to the farthest, point of a box; round the earth the shorter way is taken."""
    of = lambda lo, hi, x: F.greatest(F.col(lo) - x, x - F.col(hi), F.lit(0.0)) if near else F.greatest(F.abs(F.col(lo) - x), F.abs(F.col(hi) - x))
    lon = F.col("lon_a")
    aside = F.least(*[of("lon_lo", "lon_hi", lon + turn) for turn in (0, -360, 360)]) if wraps else of("lon_lo", "lon_hi", lon)
    return _measure(measure, of("lat_lo", "lat_hi", F.col("lat_a")), aside)


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def nearest_in_space(left: DataFrame, right: DataFrame, left_key: str, right_key: str, measure: str = "l1_wrapped", places: int = CELL_PLACES) -> DataFrame:
    """(left_key, right_key, distance): the nearest right row of each left row; ties to the smaller right key.

    Sides have (lat_a, lon_a) and (lat_b, lon_b); rows that lack one take no part, and without right rows there are none.
    ``measure`` is 'l1_wrapped', 'l1', 'cos_squared' (by the left latitude) or 'euclidean'; only the first wraps.

    Right rows of one place are one. Places lie in cells, which are split into 256 parts while they hold more than
    ``places`` of them and some left row needs them. A left row goes down from the first cells: of the parts of those that it
    has opened it keeps those whose box may hold something as near as the farthest corner of the one that is surely nearest.
    So a row opens few cells where places are dense, and few where they are far. Cells that are
    not split are read at last.
    """
    wraps = measure == "l1_wrapped"
    around = lambda c: F.pmod(F.col(c).cast("double"), F.lit(360.0)) if wraps else F.col(c).cast("double")
    asked = left.select(F.col(left_key).alias("__left"), F.col("lat_a").cast("double").alias("lat_a"), around("lon_a").alias("lon_a")).dropna()
    offered = right.select(F.col(right_key).alias("__right"), F.col("lat_b").cast("double").alias("lat_b"), around("lon_b").alias("lon_b")).dropna()
    offered = durable(offered.groupBy("lat_b", "lon_b").agg(F.min("__right").alias("__right")))
    edge = offered.agg(F.min("lat_b").alias("lat"), F.min("lon_b").alias("lon"), F.greatest(F.max("lat_b") - F.min("lat_b"), F.max("lon_b") - F.min("lon_b")).alias("width"), F.count("*").alias("n")).first()
    width, last = max(edge.width or 0.0, 1e-6), (1 << FINEST) - 1
    at = lambda c, lo: F.least(F.floor((F.col(c) - F.lit(lo or 0.0)) / width * (1 << FINEST)), F.lit(last)).cast("long")
    code = F.shiftleft(_spread(at("lat_b", edge.lat)), 1).bitwiseOR(_spread(at("lon_b", edge.lon)))
    rest = offered.withColumn("code", code)
    box = [f(f"{c}_b").alias(f"{c}_{n}") for c in ("lat", "lon") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    aside = longitude_apart(F.col("lon_a"), F.col("lon_b")) if wraps else F.abs(F.col("lon_a") - F.col("lon_b"))
    apart, parallel = _measure(measure, F.abs(F.col("lat_a") - F.col("lat_b")), aside), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = asked.repartition(parallel).withColumn("__open", F.lit(0).cast("long")).withColumn("__bound", F.lit(float("inf")))
    pairs, found, shift, up = whole, [], 2 * (FINEST - FIRST), 2 * FIRST
    while True:
        cells = durable(rest.groupBy(F.shiftright("code", shift).alias("cell")).agg(F.count(F.lit(1)).alias("n"), *box))
        n_cells = cells.count()
        parts = _few(cells.withColumn("__open", F.shiftright("cell", up)), n_cells)
        surely = pairs.join(parts, "__open").groupBy("__left").agg((F.min(_to_box(measure, False, wraps)) * (1 + 1e-9) + 1e-12).alias("__far"))
        pairs = pairs.join(surely, "__left").withColumn("__bound", F.least("__bound", "__far")).drop("__far")
        split = (F.col("n") > places) & F.lit(shift > 0)
        met = pairs.join(parts, "__open").filter(_to_box(measure, True, wraps) <= F.col("__bound"))
        met = durable(met.select("__left", "lat_a", "lon_a", "__bound", "cell", split.alias("__split")))
        held = rest.withColumn("cell", F.shiftright("code", shift)).join(_few(cells.filter(~split).select("cell"), n_cells), "cell", "left_semi")
        read = met.filter("not __split").repartition(parallel, "cell").join(held, "cell").withColumn("distance", apart)
        found.append(read.filter("distance <= __bound").select("__left", "__right", "distance"))
        pairs = met.filter("__split").select("__left", "lat_a", "lon_a", "__bound", F.col("cell").alias("__open"))
        if pairs.isEmpty():
            break
        opened = durable(pairs.select("__open").distinct())
        rest = rest.join(_few(opened, opened.count()), F.shiftright("code", shift) == F.col("__open"), "left_semi")
        up = min(2 * STEP, shift)
        shift -= up
    near = reduce(DataFrame.union, found)  # met twice: numbers alone are aggregated without a sort
    least = near.groupBy("__left").agg(F.min("distance").alias("__least"))
    best = near.join(least, "__left").filter("distance = __least").groupBy("__left").agg(F.min("__right").alias("__right"), F.min("distance").alias("distance"))
    return best.select(F.col("__left").alias(left_key), F.col("__right").alias(right_key), "distance")


def grid_index(value: Column, start: float, step: float, size: int, tolerance: float = 0.51) -> Column:
    """Index of the grid point next to a value (halves to even); null off the grid or beyond ``tolerance`` steps."""
    i = F.rint((value - start) / step)
    good = (i >= 0) & (i < size) & (F.abs(value - (start + i * step)) <= tolerance * step)
    return F.when(good, i.cast("int"))


def in_boxes(boxes: DataFrame, points: DataFrame, x: str, cell: float, key: list[str] | None = None) -> DataFrame:
    """Pairs of boxes [lo, hi] and points with lo <= x <= hi, by an equi-join on cells of ``x`` that a box touches."""
    touched = boxes.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    return touched.join(points.withColumn("__cell", F.floor(F.col(x) / cell)), [*(key or []), "__cell"]).filter(F.col(x).between(F.col("lo"), F.col("hi"))).drop("__cell")


def inside_disk(c: Column, low: float, high: float, half: float = 0, closed: bool = False) -> Column:
    """Whether a tile of ``half`` around a cell lies in [low, high), or in [low, high] where ``closed``."""
    return (c - half >= low) & ((c + half <= high) if closed else (c + half < high))


def axis_index(value: Column, axis: list[float]) -> Column:
    """Index of the nearest point of an ascending axis; the lower one wins ties, ends hold. The axis is a literal."""
    middles = [(a + b) / 2 for a, b in zip(axis, axis[1:], strict=False)]
    return F.size(F.filter(F.array(*[F.lit(m) for m in middles]).cast("array<double>"), lambda m: m < value))


def in_boxes_2d(boxes: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (lat_lo, lat_hi, lon_lo, lon_hi) and points (lat, lon) inside, ends included.

    An equi-join on the square cells that a box touches; a box should span few of them.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    touched = boxes.withColumn("__row", F.explode(F.sequence(at("lat_lo"), at("lat_hi")))).withColumn("__col", F.explode(F.sequence(at("lon_lo"), at("lon_hi"))))
    met = touched.join(points.withColumn("__row", at("lat")).withColumn("__col", at("lon")), ["__row", "__col"]).drop("__row", "__col")
    return met.filter(F.col("lat").between(F.col("lat_lo"), F.col("lat_hi")) & F.col("lon").between(F.col("lon_lo"), F.col("lon_hi")))


def regular_axis_index(value: Column, start: float, step: float, size: int, wraps: bool = False) -> Column:
    """Index of the nearest point of the axis start + i * step, in closed form; the lower one wins ties.

    Ends hold, or an axis round the earth wraps: there beyond the last point the first is next.
    """
    i = F.ceil((value - start) / step - 0.5)
    return F.pmod(i, F.lit(size)).cast("int") if wraps else F.least(F.greatest(i, F.lit(0)), F.lit(size - 1)).cast("int")
