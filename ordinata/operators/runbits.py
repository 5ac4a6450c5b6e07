"""Rank, select and access on bit sets that are held as runs of ones. Runs are never expanded.

Conventions are those of ``bitsets``: ranks count places up to and with i, select counts from 1 and gives -1 where
there is none, access outside the set raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.plans.prefix import running_total
from ordinata.sources.sequence import RunBits


def rank1(bits: RunBits, i: int) -> DataFrame:
    part = F.least(F.col("end"), F.lit(i + 1).cast("long")) - F.col("start")
    return bits.df.filter(F.col("start") <= i).agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("cnt"))


def rank0(bits: RunBits, i: int) -> DataFrame:
    places = max(0, min(i + 1, bits.length))
    return rank1(bits, i).select((F.lit(places) - F.col("cnt")).cast("long").alias("cnt"))


def access(bits: RunBits, i: int) -> DataFrame:
    """bit, 0 or 1."""
    if not 0 <= i < bits.length:
        raise IndexError(i)
    return bits.df.filter((F.col("start") <= i) & (F.col("end") > i)).agg(F.least(F.count("*"), F.lit(1)).cast("long").alias("bit"))


def _ranked(bits: RunBits) -> DataFrame:
    """lo, hi: ones before each run, and with it."""
    return running_total(bits.df.withColumn("n", F.col("end") - F.col("start")), "start", "n", bits.length)


def select1(bits: RunBits, n: int) -> DataFrame:
    hit = _ranked(bits).filter((F.col("lo") < n) & (F.col("hi") >= n))
    return hit.agg(F.coalesce(F.max(F.col("start") + n - 1 - F.col("lo")), F.lit(-1)).cast("long").alias("pos"))


def select0(bits: RunBits, n: int) -> DataFrame:
    """The n-th zero lies as many places further as there are ones in the runs that fewer than n zeros precede."""
    ones = _ranked(bits).filter(F.col("start") - F.col("lo") < n).agg(F.coalesce(F.max("hi"), F.lit(0)).alias("ones"))
    pos = F.col("ones") + n - 1
    return ones.select(F.when((F.lit(n) >= 1) & (pos < bits.length), pos).otherwise(-1).cast("long").alias("pos"))
