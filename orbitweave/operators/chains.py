"""Scans whose next step depends on what they met before, without one task that walks them from end to end."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.operators.sampling import with_dense_index
from orbitweave.session import durable


def reached(df: DataFrame, keys: list[str], order: list[str], stride: Column, name: str = "pos") -> DataFrame:
    """The rows that a scan of each group visits which goes on by a row's own ``stride`` (1 or more), with their places from 0.

    Pointers double: round k joins each row's 2**k-th next row with that row's own, and gives the rows that 2**k to
    2**(k+1) - 1 steps reach, so that the rounds are the logarithm of the longest scan. Rows are numbered in range parts
    over all groups, and every join is on that number, so that no group is held in one task. ``order`` should be total.
    """
    step = F.when(stride >= 1, stride).otherwise(F.raise_error(F.lit("strides are 1 or more"))).cast("long")
    placed = durable(with_dense_index(df.withColumn("__stride", step), [*keys, *order], "__place"))
    group = F.struct(*keys)
    rows = placed.select("__place", F.col("__place").alias("__own"), group.alias("__group"), (F.col("__place") + F.col("__stride")).alias("__to"))
    there = rows.select(F.col("__place").alias("__to"), F.col("__group").alias("__its"))
    jump = durable(rows.join(there, "__to").filter(F.col("__group").eqNullSafe(F.col("__its"))).select(F.col("__place").alias("__a"), F.col("__to").alias("__b")))
    now = durable(rows.groupBy("__group").agg(F.min("__place").alias("__start")).select("__start", F.col("__start").alias("__now")))
    while not jump.isEmpty():
        now = durable(now.union(now.join(jump, F.col("__now") == F.col("__a")).select("__start", F.col("__b").alias("__now"))))
        jump = durable(jump.select("__a", F.col("__b").alias("__mid")).join(jump.select(F.col("__a").alias("__mid"), "__b"), "__mid").select("__a", "__b"))
    found = placed.join(now, F.col("__place") == F.col("__now"))
    return found.withColumn(name, F.col("__place") - F.col("__start")).select(*df.columns, name)


# ---- Balance of two classes in order ----

#: A class takes a row while it has at most P / Q times as many as the other.
P, Q = 5, 4


def replayed(kinds: np.ndarray, low: int, high: int) -> tuple[np.ndarray, int, int]:
    """Which rows of a block are taken by the rule, row by row, and the counts after it. ``kinds``: 0 free, 1 low, 2 high."""
    taken = np.ones(len(kinds), dtype=bool)
    for i in np.flatnonzero(kinds):
        if kinds[i] == 1:
            if Q * low <= P * high:
                low += 1
            else:
                taken[i] = False
        elif Q * high <= P * low:
            high += 1
        else:
            taken[i] = False
    return taken, low, high


def peaks(kinds: np.ndarray, limited: int) -> list[int]:
    """By the other class's count modulo Q: how far the arrivals of ``limited`` run ahead of what that class allows."""
    mine, others = np.cumsum(kinds == limited), np.cumsum(kinds == 3 - limited)
    at = kinds == limited
    return [int((mine - P * (r + others) // Q)[at].max(initial=-(1 << 62))) for r in range(Q)]


def rejected(peak: int, mine: int, other: int) -> int:
    """Rows of the limited class that find no room, where all of the other class are taken: how far the counts would overrun."""
    return max(0, mine - P * (other - other % Q) // Q - 1 + peak)


def _limited(low: int, high: int, lows: int, highs: int) -> int | None:
    """The class that alone can be refused in a block, if that is sure: of the other even the last has room."""
    if not highs or Q * (high + highs - 1) <= P * low:
        return 1
    if not lows or Q * (low + lows - 1) <= P * high:
        return 2
    return None


def _taken(kinds: np.ndarray, low: int, high: int) -> np.ndarray:
    limited = _limited(low, high, int((kinds == 1).sum()), int((kinds == 2).sum()))
    if limited is None:
        return replayed(kinds, low, high)[0]
    mine, other = (low, high) if limited == 1 else (high, low)
    at = kinds == limited
    over = np.where(at, mine + np.cumsum(at) - P * (other + np.cumsum(kinds == 3 - limited)) // Q - 1, 0)
    most = np.maximum.accumulate(np.maximum(over, 0))
    return ~(at & (np.diff(most, prepend=0) > 0))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        kinds = np.concatenate([b.column("__kind").to_numpy() for b in held])
        row = {"part": held[0].column("__part")[0].as_py(), "lows": int((kinds == 1).sum()), "highs": int((kinds == 2).sum()), "low_peaks": peaks(kinds, 1), "high_peaks": peaks(kinds, 2)}
        yield pa.RecordBatch.from_pylist([row])


def _replays(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    held = [b.column("__kind").to_numpy() for b in batches if b.num_rows]
    if held:
        _, a, b = replayed(np.concatenate(held), low, high)
        yield pa.RecordBatch.from_pylist([{"low": a, "high": b}])


def _picked(batches: Iterator[pa.RecordBatch], states: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        kinds = np.concatenate([b.column("__kind").to_numpy() for b in held])
        taken = _taken(kinds, *states[held[0].column("__part")[0].as_py()])
        at = 0
        for b in held:
            yield pa.RecordBatch.from_arrays([b.column("__at"), pa.array(taken[at : at + b.num_rows])], ["__at", "__taken"])
            at += b.num_rows


def balanced_in_order(df: DataFrame, order: list[str], low: Column, high: Column) -> DataFrame:
    """The rows that are taken one by one in ``order``: a low one while lows are at most 5/4 of the highs, a high one likewise, others always.

    Rows are sorted in range parts, one block each. Where of one class even the last row of a block has room, what the
    other loses is how far its arrivals overrun the room, a running maximum; a block's summary holds its peak, and the
    driver chains one summary a part. Such room is missing only while the counts are small beside a block: those blocks,
    whose number is logarithmic as counts must grow between them, are replayed as they come. Then all blocks pick side
    by side, from their own counts. A part's classes, a number a row, are held in its task. ``order`` should be total.
    """
    kind = F.when(low, 1).when(high, 2).otherwise(0).cast("byte")
    rows = durable(df.withColumn("__kind", kind).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    slim = rows.select("__at", "__part", "__kind")
    found = slim.mapInArrow(_summaries, "part long, lows long, highs long, low_peaks array<long>, high_peaks array<long>").collect()  # a row a part
    states, a, b = {}, 0, 0
    for s in sorted(found, key=lambda s: s.part):
        states[s.part] = a, b
        limited = _limited(a, b, s.lows, s.highs)
        if limited == 1:
            a, b = a + s.lows - rejected(s.low_peaks[b % Q], a, b), b + s.highs
        elif limited == 2:
            a, b = a + s.lows, b + s.highs - rejected(s.high_peaks[a % Q], b, a)
        else:
            a, b = slim.filter(F.col("__part") == s.part).mapInArrow(partial(_replays, low=a, high=b), "low long, high long").first()
    taken = slim.mapInArrow(partial(_picked, states=states), "__at long, __taken boolean").filter("__taken")
    return rows.join(taken.select("__at"), "__at").select(*df.columns)
