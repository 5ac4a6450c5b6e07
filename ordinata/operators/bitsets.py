"""Rank, select and access on bit sets; rank and access on sorted multisets.

rank1(i) and rank0(i) count places up to and with i: 0 below the first, all beyond the last. select counts from 1
and gives -1 where there is none. access outside the set raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinata.plans.prefix import running_total, shift_for
from ordinata.sources.sequence import BitSet, Multiset


def rank1(bits: BitSet, i: int) -> DataFrame:
    return bits.df.filter(F.col("pos") <= i).agg(F.count("*").alias("cnt"))


def rank0(bits: BitSet, i: int) -> DataFrame:
    places = max(0, min(i + 1, bits.length))
    return bits.df.filter(F.col("pos") <= i).agg((F.lit(places) - F.count("*")).cast("long").alias("cnt"))


def _nth(df: DataFrame, n: int, length: int) -> DataFrame:
    """The n-th least pos: bucket counts find its bucket, and only that bucket is numbered."""
    keyed = df.withColumn("b", F.shiftright("pos", shift_for(max(1, length))))
    totals = keyed.groupBy("b").agg(F.count("*").alias("t"))
    before = totals.select("b", "t", (F.sum("t").over(W.orderBy("b")) - F.col("t")).alias("before")).filter((F.col("before") < n) & (F.col("before") + F.col("t") >= n))
    at = keyed.join(F.broadcast(before.select("b", "before")), "b").withColumn("k", F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("pos")))
    return at.filter(F.col("k") == n).agg(F.coalesce(F.max("pos"), F.lit(-1)).cast("long").alias("pos"))


def select1(bits: BitSet, n: int) -> DataFrame:
    return _nth(bits.df, n, bits.length)


def select0(bits: BitSet, n: int) -> DataFrame:
    """Zeros of a bucket are its width less its ones. In the bucket that holds the n-th zero, that lies as many places
    further as there are ones that fewer zeros precede."""
    shift = shift_for(max(1, bits.length))
    width, keyed = 1 << shift, bits.df.withColumn("b", F.shiftright("pos", shift))
    ones = keyed.groupBy("b").agg(F.count("*").alias("ones"))
    buckets = bits.df.sparkSession.range((bits.length + width - 1) // width).withColumnRenamed("id", "b")  # at most BUCKETS + 1
    zeros = F.least(F.lit(width).cast("long"), F.lit(bits.length) - F.col("b") * width) - F.coalesce("ones", F.lit(0))
    per = buckets.join(ones, "b", "left").select("b", zeros.alias("z"))
    before = per.select("b", "z", (F.sum("z").over(W.orderBy("b")) - F.col("z")).alias("before")).filter((F.col("before") < n) & (F.col("before") + F.col("z") >= n))
    first = F.col("b") * width
    inside = keyed.join(F.broadcast(before.select("b", "before")), "b")  # one row at most
    rank = F.row_number().over(W.partitionBy("b").orderBy("pos"))
    less = inside.withColumn("zeros", F.col("before") + F.col("pos") - first - (rank - 1)).filter(F.col("zeros") < n).groupBy("b").agg(F.count("*").alias("ones"))
    pos = before.join(less, "b", "left").select((first + (n - 1) - F.col("before") + F.coalesce("ones", F.lit(0))).alias("pos"))
    return pos.agg(F.coalesce(F.max("pos"), F.lit(-1)).cast("long").alias("pos"))


def access(bits: BitSet, i: int) -> DataFrame:
    """bit, 0 or 1."""
    if not 0 <= i < bits.length:
        raise IndexError(i)
    return bits.df.filter(F.col("pos") == i).agg(F.least(F.count("*"), F.lit(1)).cast("long").alias("bit"))


def aligned_rank(bits: BitSet, zeros: bool = False) -> DataFrame:
    """(end, cnt): ranks at the ends of runs of ones."""
    r = runs(bits).withColumn("n", F.col("end") - F.col("start"))
    total = running_total(r, "start", "n", bits.length, "_lo", "cnt")
    return total.select("end", (F.col("end") - F.col("cnt") if zeros else F.col("cnt")).cast("long").alias("cnt"))


def runs(bits: BitSet) -> DataFrame:
    """(start, end) of the maximal runs of ones: a one without a one before it begins a run, one without a one after
    it ends it; the k-th begin belongs to the k-th end."""
    before = bits.df.select((F.col("pos") + 1).alias("pos"))
    after = bits.df.select((F.col("pos") - 1).alias("pos"))
    one = F.lit(1).cast("long")
    begins = running_total(bits.df.join(before, "pos", "left_anti").withColumn("one", one), "pos", "one", bits.length, "k", "_h").select("k", F.col("pos").alias("start"))
    ends = running_total(bits.df.join(after, "pos", "left_anti").withColumn("one", one), "pos", "one", bits.length, "k", "_h").select("k", (F.col("pos") + 1).alias("end"))
    return begins.join(ends, "k").select("start", "end")


def multiset_rank(ms: Multiset, i: int) -> DataFrame:
    """cnt of elements that are at most i."""
    return ms.df.filter(F.col("value") <= i).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("cnt"))


def multiset_access(ms: Multiset, i: int, largest: int = 2**32 - 1) -> DataFrame:
    """value of the i-th least element, from 0; no row beyond the end."""
    if i < 0:
        raise IndexError(i)
    return running_total(ms.df, "value", "cnt", largest).filter((F.col("lo") <= i) & (F.col("hi") > i)).select("value")


def upper_bound(ms: Multiset, x: int) -> DataFrame:
    """cnt: the first sorted place after all elements that are at most x."""
    return multiset_rank(ms, x)


def lower_bound(ms: Multiset, x: int) -> DataFrame:
    """cnt: the first sorted place whose element is at least x."""
    return multiset_rank(ms, x - 1)
