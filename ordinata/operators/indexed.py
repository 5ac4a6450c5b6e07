"""Counts, ranks and quantiles of many ranges by an index of block counts.

Level k of the index counts each symbol in each block of BASE**k positions. A range of any length is made of at
most 2 * (BASE - 1) blocks of each level, so a request meets some dozens of blocks, and only the positions at its
two ends, however long it is. An index is built once from a plain sequence and can be written to a folder; requests
then read no more of the sequence than the levels' blocks that they name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinata.sources.sequence import Sequence

BASE = 16


@dataclass(frozen=True)
class Index:
    """(level, block, sym, cnt), LONG but for level; level 0 is the sequence itself."""

    df: DataFrame
    length: int
    levels: int


def build(seq: Sequence, path: str | None = None) -> Index:
    """path: where to keep it; else it is planned anew in each query."""
    if not seq.unit:
        raise ValueError("the index is for plain sequences")
    level = seq.df.select(F.lit(0).alias("level"), F.col("start").alias("block"), "sym", F.lit(1).cast("long").alias("cnt"))
    out, size, k = level, BASE, 0
    while size < seq.length:
        k += 1
        # without a folder each level is counted from the sequence, with one from the level below
        place, width = ("start", size) if path is None else ("block", BASE)
        below = seq.df.withColumn("cnt", F.lit(1).cast("long")) if path is None else level
        level = below.groupBy(F.call_function("div", F.col(place), F.lit(width).cast("long")).alias("block"), "sym").agg(F.sum("cnt").alias("cnt")).select(F.lit(k).alias("level"), "block", "sym", "cnt")
        if path is not None:
            at = f"{path}/level-{k}"
            level.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(at)
            level = level.sparkSession.read.schema(level.schema).parquet(at)
        out = out.unionByName(level)
        size *= BASE
    return Index(out, seq.length, k + 1)


def _blocks(index: Index, ranges: DataFrame) -> DataFrame:
    """Adds (level, block): the blocks that each range (first, last) is made of."""
    named = lambda own, k: F.transform(own, lambda x: F.struct(F.lit(k).alias("level"), x.cast("long").alias("block")))
    at = lambda k, name, up: F.call_function("div", F.col(name) + (BASE**k - 1 if up else 0), F.lit(BASE**k).cast("long"))
    places = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    each = []
    for k in range(index.levels):
        a, b = at(k, "first", True), at(k, "last", False)
        if k + 1 < index.levels:
            c, d = at(k + 1, "first", True), at(k + 1, "last", False)
            own = F.when(d > c, F.concat(places(a, c * BASE), places(d * BASE, b))).otherwise(places(a, b))
        else:
            own = places(a, b)
        each.append(named(own, k))
    return ranges.filter("first < last").withColumn("_x", F.explode(F.flatten(F.array(*each)))).select("*", "_x.level", "_x.block").drop("_x")


def counts(index: Index, ranges: DataFrame) -> DataFrame:
    """(rid, sym, cnt) for each range of a DataFrame (rid, first, last)."""
    met = _blocks(index, ranges.select("rid", "first", "last")).join(index.df, ["level", "block"])
    return met.groupBy("rid", "sym").agg(F.sum("cnt").alias("cnt"))


def ranks(index: Index, asked: DataFrame) -> DataFrame:
    """(rid, sym, cnt) for each row of a DataFrame (rid, first, last, sym), zeros too; rid is unique."""
    met = _blocks(index, asked.select("rid", "first", "last", "sym")).join(index.df, ["level", "block", "sym"])
    found = met.groupBy("rid").agg(F.sum("cnt").alias("cnt"))
    return asked.select("rid", "sym").join(found, "rid", "left").select("rid", "sym", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def quantiles(index: Index, asked: DataFrame) -> DataFrame:
    """(rid, sym, cnt): the off-th least symbol of each range of a DataFrame (rid, first, last, off)."""
    hi = F.sum("cnt").over(W.partitionBy("rid").orderBy("sym").rowsBetween(W.unboundedPreceding, 0))
    both = counts(index, asked).join(asked.select("rid", "off"), "rid").withColumn("hi", hi)
    return both.filter((F.col("hi") > F.col("off")) & (F.col("hi") - F.col("cnt") <= F.col("off"))).select("rid", "sym", "cnt")
