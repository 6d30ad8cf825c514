"""Rasters as tables of cells in hierarchical Z order, so that windows and strided reads open few files.

A cell's level is the largest power of two that divides both its indices (up to a top level), so that every eighth cell
of every eighth row is what levels 3 and above hold. Cells lie in folders by level and by block, a square of tiles; in a
file they are sorted by the Morton number of their tile. A read names levels and blocks, which prune folders, and runs of
Morton numbers, which prune row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells along a tile, tiles along a block (both powers of two), and the coarsest level.
TILE, BLOCK, TOP = 16, 4, 4
#: Runs of Morton numbers in a read; nearest ones are merged beyond it, and cells outside go by their indices.
MOST_RUNS = 16
#: Bytes of a row group; small, so that runs of tiles are skipped inside a file.
ROW_GROUP = 256 << 10
#: Masks and shifts that spread the bits of a 16-bit number.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(x: Column) -> Column:
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(row: Column, col: Column) -> Column:
    """The Morton number of two indices from 0 to 32,767, rows in the higher bits of each pair."""
    return F.shiftleft(_spread(row.cast("int")), 1).bitwiseOR(_spread(col.cast("int")))


def _morton(row: int, col: int) -> int:
    return sum(((col >> i & 1) << 2 * i) | ((row >> i & 1) << 2 * i + 1) for i in range(16))


def level_of(row: Column, col: Column, top: int = TOP) -> Column:
    """The largest k up to ``top`` for which 2**k divides both indices."""
    level = F.lit(0)
    for k in range(1, top + 1):
        level = F.when((row % 2**k == 0) & (col % 2**k == 0), k).otherwise(level)
    return level


def write_raster(cells: DataFrame, path: str, by: list[str] | None = None, row: str = "r", col: str = "c") -> None:
    """Writes ``cells`` with indices from 0 below 2**19; ``by`` are more folders, as a slice or a channel."""
    r, c = F.col(row), F.col(col)
    z = morton(F.floor(r / TILE), F.floor(c / TILE))
    placed = cells.withColumn("level", level_of(r, c)).withColumn("z", z).withColumn("block", F.floor(F.col("z") / (BLOCK * BLOCK)).cast("int"))
    folders = [*(by or []), "level", "block"]
    placed.repartitionByRange(*folders, "z").sortWithinPartitions(*folders, "z", row, col).write.option("parquet.block.size", ROW_GROUP).partitionBy(*folders).parquet(path)


def runs_of(rows: tuple[int, int], cols: tuple[int, int], most: int = MOST_RUNS) -> list[tuple[int, int]]:
    """Runs [first, last] of Morton numbers that cover a window of tiles, ends included: whole quadrants, and at most ``most`` runs."""
    runs: list[tuple[int, int]] = []

    def cover(r: int, c: int, size: int) -> None:
        if r > rows[1] or c > cols[1] or r + size <= rows[0] or c + size <= cols[0]:
            return
        if rows[0] <= r and r + size - 1 <= rows[1] and cols[0] <= c and c + size - 1 <= cols[1]:
            first = _morton(r, c)
            if runs and runs[-1][1] == first - 1:
                runs[-1] = runs[-1][0], first + size * size - 1
            else:
                runs.append((first, first + size * size - 1))
            return
        for i in (0, 1):
            for j in (0, 1):
                cover(r + i * size // 2, c + j * size // 2, size // 2)

    size = 1
    while size <= max(rows[1], cols[1]):
        size *= 2
    cover(0, 0, size)
    while len(runs) > most:
        gap = min(range(len(runs) - 1), key=lambda i: runs[i + 1][0] - runs[i][1])
        runs[gap : gap + 2] = [(runs[gap][0], runs[gap + 1][1])]
    return runs


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], stride: int = 1, row: str = "r", col: str = "c") -> DataFrame:
    """Cells of a window, ends included, whose indices ``stride`` divides; with the raster's own columns.

    A power of two up to 2**TOP leaves whole levels unread; of another stride its largest such divisor does.
    """
    runs = runs_of((rows[0] // TILE, rows[1] // TILE), (cols[0] // TILE, cols[1] // TILE))
    near, block = F.lit(False), F.lit(False)
    for a, b in runs:
        near = near | F.col("z").between(a, b)
        block = block | F.col("block").between(a // (BLOCK * BLOCK), b // (BLOCK * BLOCK))
    least = next(k for k in range(TOP, -1, -1) if stride % 2**k == 0)
    found = spark.read.parquet(path).filter((F.col("level") >= least) & block & near & F.col(row).between(*rows) & F.col(col).between(*cols))
    if stride > 1:
        found = found.filter((F.col(row) % stride == 0) & (F.col(col) % stride == 0))
    return found.drop("level", "z", "block")
