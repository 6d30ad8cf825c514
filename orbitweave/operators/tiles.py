"""Rasters as one packed array a tile, and values gathered at points inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.operators.skew import LEAST, copied, hot_keys, parted

#: Cells along a tile.
TILE = 32


def _tile(row: str, col: str, tile: int) -> tuple[Column, Column, Column]:
    r, c = F.col(row), F.col(col)
    return F.floor(r / tile), F.floor(c / tile), (F.pmod(r, F.lit(tile)) * tile + F.pmod(c, F.lit(tile))).cast("int")


def packed(cells: DataFrame, values: list[str], row: str = "r", col: str = "c", tile: int = TILE) -> DataFrame:
    """(tile_r, tile_c, one array of tile * tile a value): cells by tile, null where a tile has none; a cell should come once."""
    tr, tc, at = _tile(row, col, tile)
    held = cells.groupBy(tr.alias("tile_r"), tc.alias("tile_c")).agg(F.collect_list(F.struct(at.alias("at"), *values)).alias("held"))
    kinds = dict(cells.dtypes)
    rest = F.array_except(F.sequence(F.lit(0), F.lit(tile * tile - 1)), F.col("held.at"))
    none = F.transform(rest, lambda i: F.struct(i.alias("at"), *[F.lit(None).cast(kinds[v]).alias(v) for v in values]))
    whole = held.select("tile_r", "tile_c", F.sort_array(F.concat("held", none)).alias("held"))
    return whole.select("tile_r", "tile_c", *[F.col(f"held.{v}").alias(v) for v in values])


def gathered(points: DataFrame, raster: DataFrame, values: list[str], row: str = "r", col: str = "c", tile: int = TILE, least: int = LEAST) -> DataFrame:
    """``points`` with the values of :func:`packed` ``raster`` at their cells; null where it has none.

    Points are packed by tile, meet their tile once, and take their values from its arrays, so that the join carries
    tiles, not cells. A tile with more than ``least`` points, and a partition's share of all, is split: its points go to
    parts, and its arrays to each.
    """
    tr, tc, at = _tile(row, col, tile)
    keys, mine = ["tile_r", "tile_c"], F.struct(*[F.col(c) for c in points.columns])
    placed = points.select(tr.alias("tile_r"), tc.alias("tile_c"), at.alias("at"), mine.alias("point"))
    hot = hot_keys(placed, keys, least)
    packs = parted(placed, hot, keys, F.monotonically_increasing_id()).groupBy(*keys, "__part").agg(F.collect_list(F.struct("at", "point")).alias("points"))
    met = packs.join(copied(raster, hot, keys), [*keys, "__part"], "left").select(F.explode("points").alias("p"), *values)
    return met.select("p.point.*", *[F.get(v, F.col("p.at")).alias(v) for v in values])
