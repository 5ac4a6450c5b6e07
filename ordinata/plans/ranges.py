"""Arguments shared by the operators, and joins of positions with many ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literal requests (symbols, offsets, positions) that a call may carry; more come as a DataFrame.
MAX_LITERALS = 100_000


def check_range(first: int | None, last: int | None, length: int) -> tuple[int, int]:
    """[first, last) within a sequence; the whole of it by default."""
    first, last = 0 if first is None else first, length if last is None else last
    if not 0 <= first <= last <= length:
        raise ValueError(f"positions must have 0 <= first <= last <= {length}")
    return first, last


def check_bounds(lower: int, upper: int) -> None:
    if lower > upper:
        raise ValueError("lower must not exceed upper")


def check_ignored(ignore_bits: int) -> None:
    if not 0 <= ignore_bits <= 32:
        raise ValueError("ignore_bits must be from 0 to 32")


def check_literals(values: list[int]) -> list[int]:
    if len(values) > MAX_LITERALS:
        raise ValueError(f"more than {MAX_LITERALS} requests: pass them as a DataFrame")
    return values


def overlap(first: Column | int, last: Column | int) -> Column:
    """How many of a run's positions lie in [first, last)."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("long")
    return F.least(F.col("end"), lit(last)) - F.greatest(F.col("start"), lit(first))


def join_ranges(runs: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """runs (start, end, ...) with the ranges (first, last, ...) that they overlap, by equal bins of this many
    positions: no side is broadcast and no pair is formed that shares no bin. A run and a range that share several
    bins meet in the first of them alone."""
    size = F.lit(width).cast("long")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor((b - 1) / size)))
    left = runs.filter("start < end").withColumn("_bin", bins(F.col("start"), F.col("end")))
    right = ranges.filter("first < last").withColumn("_bin", bins(F.col("first"), F.col("last")))
    meet = F.floor(F.greatest("start", "first") / size)
    return left.join(right, "_bin").filter((F.col("start") < F.col("last")) & (F.col("end") > F.col("first")) & (F.col("_bin") == meet)).drop("_bin")
