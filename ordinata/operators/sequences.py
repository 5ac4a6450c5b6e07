"""Queries on positions [first, last) and symbols of a sequence.

Each gives a DataFrame of a fixed schema, LONG throughout. Positions are 0-based and half-open, n-th
occurrences count from 1, and no result has an order unless it says so. Plain and run-length sequences share
one expression: a run counts as often as it overlaps the range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinata.functions.bits import group_label, in_box
from ordinata.plans.prefix import running_total, shift_for
from ordinata.plans.ranges import check_bounds, check_ignored, check_literals, check_range, join_ranges, overlap
from ordinata.sources.sequence import Sequence


def _window(seq: Sequence, first: int | None, last: int | None) -> tuple[DataFrame, Column, int, int]:
    """(runs that meet the range, how often each counts, first, last)."""
    first, last = check_range(first, last, seq.length)
    if seq.unit:  # a filter that parquet row groups can answer, and plain counting
        return seq.df.filter((F.col("start") >= first) & (F.col("start") < last)), F.lit(1).cast("long"), first, last
    return seq.df.filter((F.col("start") < last) & (F.col("end") > first)), overlap(first, last), first, last


def _total(weight: Column) -> Column:
    return F.coalesce(F.sum(weight), F.lit(0)).cast("long")


def _list(seq: Sequence, values: list[int], names: str) -> DataFrame:
    return seq.df.sparkSession.createDataFrame([(int(v),) if not isinstance(v, tuple) else v for v in check_literals(values)], names)


#: Literals of a filter that the scan gets as they are; of more it gets the bounds.
PUSHED = 1000


def _among(df: DataFrame, name: str, values: list[int]) -> DataFrame:
    some = sorted(set(map(int, values)))
    if len(some) <= PUSHED:
        return df.filter(F.col(name).isin(some))
    return df.filter(F.col(name).between(some[0], some[-1]))


# Access


def access(seq: Sequence, index: int) -> DataFrame:
    """sym at a position."""
    if not 0 <= index < seq.length:
        raise IndexError(index)
    at = F.col("start") == index if seq.unit else (F.col("start") <= index) & (F.col("end") > index)
    return seq.df.filter(at).select("sym")


def access_batch(seq: Sequence, indices: list[int] | DataFrame) -> DataFrame:
    """(ord, idx, sym) for each request, repeated ones too. Requests: a list, or a DataFrame (ord, idx)."""
    if not isinstance(indices, DataFrame):
        if any(not 0 <= i < seq.length for i in indices):
            raise IndexError("position out of range")
        asked = _list(seq, list(enumerate(indices)), "ord long, idx long")
        if seq.unit:  # the scan reads no more than the positions asked for, and meets a bounded list
            return _among(seq.df, "start", indices).join(F.broadcast(asked), F.col("idx") == F.col("start")).select("ord", "idx", "sym")
        indices = F.broadcast(asked)
    if seq.unit:
        return indices.join(seq.df, F.col("idx") == F.col("start")).select("ord", "idx", "sym")
    width = max(1, seq.length >> 12)
    asked = indices.withColumn("first", F.col("idx")).withColumn("last", F.col("idx") + 1)
    return join_ranges(seq.df, asked, width).select("ord", "idx", "sym")


# Counting


def rank(seq: Sequence, symbol: int, first: int | None = None, last: int | None = None, ignore_bits: int = 0) -> DataFrame:
    """cnt: how often a symbol, or its group of 2**ignore_bits, occurs. 0 for symbols beyond the alphabet."""
    check_ignored(ignore_bits)
    w, weight, _, _ = _window(seq, first, last)
    return w.filter(F.shiftright("sym", ignore_bits) == symbol >> ignore_bits).agg(_total(weight).alias("cnt"))


def count_less_than(seq: Sequence, symbol: int, first: int | None = None, last: int | None = None) -> DataFrame:
    w, weight, _, _ = _window(seq, first, last)
    return w.filter(F.col("sym") < symbol).agg(_total(weight).alias("cnt"))


def count(seq: Sequence, lower: int, upper_exclusive: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """cnt of lower <= sym < upper_exclusive."""
    check_bounds(lower, upper_exclusive)
    w, weight, _, _ = _window(seq, first, last)
    return w.filter((F.col("sym") >= lower) & (F.col("sym") < upper_exclusive)).agg(_total(weight).alias("cnt"))


def rank_batch(seq: Sequence, symbols: list[int] | DataFrame, first: int | None = None, last: int | None = None, ignore_bits: int = 0) -> DataFrame:
    """(sym, cnt) for each distinct symbol or group asked for, zeros too. Symbols: a list, or a DataFrame (sym)."""
    check_ignored(ignore_bits)
    w, weight, _, _ = _window(seq, first, last)
    if isinstance(symbols, DataFrame):
        asked = symbols.select(group_label(F.col("sym"), ignore_bits).alias("sym")).distinct()
    else:  # a bounded list: only these symbols are counted
        labels = sorted({int(s) >> ignore_bits << ignore_bits for s in symbols})
        asked = _list(seq, labels, "sym long")
        if not ignore_bits:
            w = _among(w, "sym", labels)
    h = w.groupBy(group_label(F.col("sym"), ignore_bits).alias("sym")).agg(_total(weight).alias("cnt"))
    return asked.join(h, "sym", "left").select("sym", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def counts(seq: Sequence, first: int | None = None, last: int | None = None, lower: int = 0, upper: int | None = None, *, ignore_bits: int = 0, separator: int = 0, sort: bool = False, aligned: bool = False) -> DataFrame:
    """(sym, cnt) of the distinct symbols in [lower, upper], inclusive. With ignore_bits, of whole groups of
    2**ignore_bits symbols that meet the bounds, named by their least member; aligned demands that the bounds
    are group boundaries. With a separator, of symbols whose every field lies within its own bounds."""
    upper = seq.max_symbol if upper is None else upper
    check_bounds(lower, upper)
    check_ignored(ignore_bits)
    if aligned and (lower % (1 << ignore_bits) or (upper + 1) % (1 << ignore_bits)):
        raise ValueError("bounds must be group boundaries")
    w, weight, _, _ = _window(seq, first, last)
    if separator:
        if upper > (1 << seq.levels) - 1:
            raise ValueError("bounds must lie within the alphabet when fields are given")
        w = w.filter(in_box(F.col("sym"), lower, upper, separator, seq.levels, ignore_bits))
    else:
        w = w.filter(F.shiftright("sym", ignore_bits).between(lower >> ignore_bits, upper >> ignore_bits))
    out = w.groupBy(group_label(F.col("sym"), ignore_bits).alias("sym")).agg(F.sum(weight).cast("long").alias("cnt"))
    return out.orderBy("sym") if sort else out


def level_zeros(seq: Sequence) -> DataFrame:
    """(level, zeros): how many symbols have a zero at each level, the highest bit first. One scan."""
    top = seq.levels - 1
    weight = F.lit(1) if seq.unit else F.col("end") - F.col("start")
    sums = [F.coalesce(F.sum(F.when(F.shiftright("sym", top - k).bitwiseAND(1) == 0, weight)), F.lit(0)).cast("long").alias(f"z{k}") for k in range(seq.levels)]
    pairs = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("level"), F.col(f"z{k}").alias("zeros")) for k in range(seq.levels)))).alias("x")
    return seq.df.agg(*sums).select(pairs).select("x.level", "x.zeros")


def empty_result(seq: Sequence) -> DataFrame:
    return seq.df.sparkSession.createDataFrame([], "sym long, cnt long")


# Order statistics


def histogram(seq: Sequence, first: int | None = None, last: int | None = None) -> DataFrame:
    w, weight, _, _ = _window(seq, first, last)
    return w.groupBy("sym").agg(F.sum(weight).cast("long").alias("cnt"))


def ranked(seq: Sequence, first: int | None = None, last: int | None = None) -> DataFrame:
    """(sym, cnt, lo, hi): sorted offsets lo..hi-1 of the range hold sym."""
    return running_total(histogram(seq, first, last), "sym", "cnt", seq.max_symbol)


def quantile(seq: Sequence, offset: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """(sym, cnt) of the offset-th least symbol, from 0."""
    first, last = check_range(first, last, seq.length)
    if not 0 <= offset < last - first:
        raise IndexError(offset)
    return ranked(seq, first, last).filter((F.col("lo") <= offset) & (F.col("hi") > offset)).select("sym", "cnt")


def quantile_batch(seq: Sequence, offsets: list[int] | DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(sym, cnt, num_offsets) of the symbols that the offsets fall on. Offsets: a list, or a DataFrame (off), of which
    those out of range fall on nothing."""
    first, last = check_range(first, last, seq.length)
    if isinstance(offsets, DataFrame):
        asked = offsets.select(F.col("off").cast("long").alias("first"), (F.col("off") + 1).cast("long").alias("last")).filter((F.col("first") >= 0) & (F.col("first") < last - first))
    else:
        if any(not 0 <= o < last - first for o in offsets):
            raise IndexError("offset out of range")
        asked = F.broadcast(_list(seq, [(o, o + 1) for o in offsets], "first long, last long"))
    spans = ranked(seq, first, last).select("sym", "cnt", F.col("lo").alias("start"), F.col("hi").alias("end"))
    return join_ranges(spans, asked, max(1, (last - first) >> 10)).groupBy("sym", "cnt").agg(F.count("*").alias("num_offsets"))


def quantiles(seq: Sequence, first_offset: int, last_offset: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """(sym, cnt) of the symbols at sorted offsets [first_offset, last_offset); counts are of the whole range."""
    first, last = check_range(first, last, seq.length)
    if not 0 <= first_offset <= last_offset <= last - first:
        raise IndexError("offsets out of range")
    if first_offset == last_offset:
        return empty_result(seq)
    return ranked(seq, first, last).filter((F.col("hi") > first_offset) & (F.col("lo") < last_offset)).select("sym", "cnt")


def majority(seq: Sequence, k: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """(sym, cnt) of symbols that occur more than floor(n / k) times, exactly."""
    if k < 1:
        raise ValueError("k must be positive")
    first, last = check_range(first, last, seq.length)
    return histogram(seq, first, last).filter(F.col("cnt") > (last - first) // k)


def simple_majority(seq: Sequence, first: int | None = None, last: int | None = None) -> DataFrame:
    return majority(seq, 2, first, last)


def top_k(seq: Sequence, k: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """(sym, cnt) of the k most frequent symbols, of equals the least."""
    return histogram(seq, first, last).orderBy(F.desc("cnt"), "sym").limit(k)


def most_frequent(seq: Sequence, k: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """(sym, cnt) of at least the k most frequent symbols with their ties, unsorted: those above floor(n / (k * 2**i)) for
    the least i from 0 to 6 (with k * 2**i within the alphabet) that gives k, or else all."""
    if k < 1:
        raise ValueError("k must be positive")
    first, last = check_range(first, last, seq.length)
    h = histogram(seq, first, last)
    steps = [i for i in range(7) if i == 0 or k << i <= seq.max_symbol + 1]
    limits = [(last - first) // (k << i) for i in steps]
    # one row of counts decides the threshold within the plan
    enough = h.agg(*(F.count(F.when(F.col("cnt") > x, 1)).alias(f"n{i}") for i, x in enumerate(limits)))
    least = F.coalesce(*(F.when(F.col(f"n{i}") >= k, F.lit(x).cast("long")) for i, x in enumerate(limits)), F.lit(0).cast("long"))
    return h.crossJoin(F.broadcast(enough.select(least.alias("_x")))).filter("cnt > _x").select("sym", "cnt")


def select(seq: Sequence, symbol: int, n: int, first: int | None = None, last: int | None = None, ignore_bits: int = 0) -> DataFrame:
    """pos of the n-th occurrence (from 1) of a symbol or its group, -1 if there is none. Bucket counts find the bucket
    that holds it; only that bucket's positions are numbered."""
    check_ignored(ignore_bits)
    w, weight, first, last = _window(seq, first, last)
    mine = w.filter(F.shiftright("sym", ignore_bits) == symbol >> ignore_bits).select(F.greatest("start", F.lit(first)).alias("at"), weight.alias("n")).withColumn("b", F.shiftright("at", shift_for(max(1, seq.length))))
    totals = mine.groupBy("b").agg(F.sum("n").alias("t"))
    before = totals.select("b", "t", (F.sum("t").over(W.orderBy("b")) - F.col("t")).alias("before")).filter((F.col("before") < n) & (F.col("before") + F.col("t") >= n))
    inside = mine.join(F.broadcast(before.select("b", "before")), "b")  # one row at most
    hi = F.col("before") + F.sum("n").over(W.partitionBy("b").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    hit = inside.withColumn("hi", hi).filter((F.col("hi") >= n) & (F.col("hi") - F.col("n") < n))
    return hit.agg(F.coalesce(F.max(F.col("at") + n - 1 - (F.col("hi") - F.col("n"))), F.lit(-1)).cast("long").alias("pos"))


# Set operations over several ranges


def set_op(seq: Sequence, ranges: list[tuple[int, int]], having: Callable[[list[Column]], Column], lower: int = 0, upper: int | None = None, *, separator: int = 0, sort: bool = False) -> DataFrame:
    """(sym, cnt, c0, c1, ...): symbols in [lower, upper] that having accepts, given how often each occurs in each range;
    cnt is the sum. One scan."""
    upper = seq.max_symbol if upper is None else upper
    check_bounds(lower, upper)
    if not ranges:
        raise ValueError("no ranges")
    ranges = [check_range(a, b, seq.length) for a, b in ranges]
    low, high = min(a for a, _ in ranges), max(b for _, b in ranges)
    rows = seq.df.filter((F.col("end") > low) & (F.col("start") < high))
    rows = rows.filter(in_box(F.col("sym"), lower, upper, separator, seq.levels) if separator else F.col("sym").between(lower, upper))
    each = [F.coalesce(F.sum(F.greatest(overlap(a, b), F.lit(0))), F.lit(0)).cast("long").alias(f"c{j}") for j, (a, b) in enumerate(ranges)]
    names = [f"c{j}" for j in range(len(ranges))]
    cols = [F.col(c) for c in names]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    out = rows.groupBy("sym").agg(*each).filter(having(cols)).select("sym", total.alias("cnt"), *names)
    return out.orderBy("sym") if sort else out


def union(seq: Sequence, ranges: list[tuple[int, int]], **how) -> DataFrame:
    """Symbols of any range."""
    return set_op(seq, ranges, lambda c: F.greatest(F.lit(0), *c) > 0, **how)


def intersect(seq: Sequence, ranges: list[tuple[int, int]], **how) -> DataFrame:
    """Symbols of every range."""
    return set_op(seq, ranges, lambda c: F.least(c[0], *c) > 0, **how)


def difference(seq: Sequence, ranges: list[tuple[int, int]], **how) -> DataFrame:
    """Symbols of the first range that no other range has."""
    return set_op(seq, ranges, lambda c: (c[0] > 0) & (F.greatest(F.lit(0), F.lit(0), *c[1:]) == 0), **how)


# Many ranges at once


def counts_batch(seq: Sequence, ranges: DataFrame, width: int | None = None) -> DataFrame:
    """(rid, sym, cnt) for each range of a DataFrame (rid, first, last), by binned joins."""
    width = width or max(1, seq.length >> 10)
    met = join_ranges(seq.df, ranges, width)
    return met.groupBy("rid", "sym").agg(F.sum(overlap(F.col("first"), F.col("last"))).cast("long").alias("cnt"))


def quantile_ranges(seq: Sequence, ranges: DataFrame, width: int | None = None) -> DataFrame:
    """(rid, sym, cnt): the off-th least symbol of each range of a DataFrame (rid, first, last, off)."""
    h = counts_batch(seq, ranges.select("rid", "first", "last"), width)
    hi = F.sum("cnt").over(W.partitionBy("rid").orderBy("sym").rowsBetween(W.unboundedPreceding, 0))
    asked = h.join(ranges.select("rid", "off"), "rid").withColumn("hi", hi)
    return asked.filter((F.col("hi") > F.col("off")) & (F.col("hi") - F.col("cnt") <= F.col("off"))).select("rid", "sym", "cnt")


def next_value(seq: Sequence, symbol: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """sym: the least symbol of the range that is at least this one (no row if there is none)."""
    w, _, _, _ = _window(seq, first, last)
    return w.filter(F.col("sym") >= symbol).agg(F.min("sym").alias("sym")).filter("sym is not null")


def min_max(seq: Sequence, first: int | None = None, last: int | None = None) -> DataFrame:
    w, _, _, _ = _window(seq, first, last)
    return w.agg(F.min("sym").alias("min_sym"), F.max("sym").alias("max_sym"))


def size_in_bits(seq: Sequence) -> int:
    """An estimate: one bit a level and position, and as much again for ranks."""
    return 2 * seq.levels * seq.length
