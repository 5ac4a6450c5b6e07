"""The data model: sequences, bit sets and multisets as DataFrames with a little metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinata.plans.prefix import running_total, shift_for

LARGEST = 2**32 - 1


@dataclass(frozen=True)
class Sequence:
    """Runs (start, end, sym), LONG: positions start..end-1 hold sym. unit: each run is one position, so
    counting rows counts positions."""

    df: DataFrame
    length: int
    max_symbol: int
    unit: bool = True

    @property
    def levels(self) -> int:
        return max(1, self.max_symbol.bit_length())

    def cached(self) -> Sequence:
        return Sequence(self.df.cache(), self.length, self.max_symbol, self.unit)

    def destroy(self) -> None:
        self.df.unpersist()

    @staticmethod
    def from_df(df: DataFrame, pos: str | Column, sym: str | Column, *, length: int | None = None, max_symbol: int | None = None, check: bool = True) -> Sequence:
        """Positions must be 0..length-1, each once, and symbols from 0 to max_symbol. One aggregate checks that: it marks
        positions in bitmaps, so repeated ones can't hide, and only counts are summed. With check=False, length and
        max_symbol are taken as they are, which is right for a table that was checked before."""
        rows = df.select((F.col(pos) if isinstance(pos, str) else pos).cast("long").alias("start"), (F.col(sym) if isinstance(sym, str) else sym).cast("long").alias("sym"))
        if check or length is None or max_symbol is None:
            marks = F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("start")))
            each = rows.groupBy(F.bitmap_bucket_number("start").alias("b")).agg(marks.alias("bits"), F.count("*").alias("n"), F.count("start").alias("p"), F.count("sym").alias("s"), F.min("start").alias("first"), F.max("start").alias("last"), F.min("sym").alias("least"), F.max("sym").alias("most"))
            s = each.agg(*(F.sum(c).alias(c) for c in ("bits", "n", "p", "s")), F.min("first").alias("first"), F.max("last").alias("last"), F.min("least").alias("least"), F.max("most").alias("most")).first()
            n = s.n or 0
            if n and (s.p < n or s.s < n):
                raise ValueError("null position or symbol")
            if n and (s.first != 0 or s["last"] != n - 1 or s.bits != n) or length not in (None, n):
                raise ValueError("positions must be 0..length-1, each once")
            most = -1 if s.most is None else s.most
            if n and s.least < 0 or most > (LARGEST if max_symbol is None else max_symbol):
                raise ValueError("symbol out of range")
            length, max_symbol = n, max(0, most) if max_symbol is None else max_symbol
        if max_symbol > LARGEST:
            raise ValueError("max_symbol must fit in 32 bits")
        return Sequence(rows.select("start", (F.col("start") + 1).alias("end"), "sym"), length, max_symbol)

    @staticmethod
    def from_runs(df: DataFrame, order: str, sym: str, count: str, *, max_symbol: int | None = None) -> Sequence:
        """Each row is sym repeated count times, in the order of a unique key >= 0. Never exploded."""
        rows = df.select(F.col(order).cast("long").alias("_k"), F.col(sym).cast("long").alias("sym"), F.col(count).cast("long").alias("n"))
        s = rows.agg(F.count("*").alias("rows"), F.count(F.when(F.col("_k").isNull() | F.col("sym").isNull() | F.col("n").isNull() | (F.col("_k") < 0) | (F.col("sym") < 0) | (F.col("n") < 0), 1)).alias("bad"), F.max("_k").alias("k"), F.sum("n").alias("length"), F.max("sym").alias("most")).first()
        if s.bad:
            raise ValueError("null or negative key, symbol or count")
        most = s.most or 0
        if max_symbol is not None and most > max_symbol or most > LARGEST:
            raise ValueError("symbol out of range")
        runs = running_total(rows.filter("n > 0"), "_k", "n", s.k or 0, "start", "end").select("start", "end", "sym")
        return Sequence(runs, s.length or 0, most if max_symbol is None else max_symbol, unit=False)

    @staticmethod
    def from_values(spark: SparkSession, values: list[int], max_symbol: int | None = None, counts: list[int] | None = None) -> Sequence:
        if counts is not None:
            if len(counts) != len(values):
                raise ValueError("one count for each value")
            return Sequence.from_runs(spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(values, counts))], "k long, v long, c long"), "k", "v", "c", max_symbol=max_symbol)
        return Sequence.from_df(spark.createDataFrame(list(enumerate(values)), "p long, v long"), "p", "v", max_symbol=max_symbol)


def with_positions(df: DataFrame, order: str, pos: str = "pos") -> DataFrame:
    """Dense positions 0.. by a unique, non-negative integer key, without a single-task window."""
    most = df.agg(F.max(F.col(order).cast("long"))).first()[0] or 0
    keyed = df.withColumn("_one", F.lit(1).cast("long")).withColumn("_key", F.col(order).cast("long"))
    return running_total(keyed, "_key", "_one", most, pos, "_hi").drop("_one", "_key", "_hi")


@dataclass(frozen=True)
class BitSet:
    """Distinct positions (pos LONG) of the ones among length bits."""

    df: DataFrame
    length: int

    def cached(self) -> BitSet:
        return BitSet(self.df.cache(), self.length)

    def destroy(self) -> None:
        self.df.unpersist()

    @staticmethod
    def from_df(df: DataFrame, pos: str | Column, length: int) -> BitSet:
        rows = df.select((F.col(pos) if isinstance(pos, str) else pos).cast("long").alias("pos"))
        s = rows.agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count(F.when(F.col("pos").isNull(), 1)).alias("nulls")).first()
        if s.nulls or s.a is not None and (s.a < 0 or s.b >= length):
            raise ValueError("positions must lie in 0..length-1")
        return BitSet(rows.distinct(), length)

    @staticmethod
    def from_values(spark: SparkSession, ones: list[int], length: int) -> BitSet:
        return BitSet.from_df(spark.createDataFrame([(x,) for x in ones], "pos long"), "pos", length)

    def complement(self) -> BitSet:
        every = self.df.sparkSession.range(self.length).select(F.col("id").alias("pos"))
        return BitSet(every.join(self.df, "pos", "left_anti"), self.length)


@dataclass(frozen=True)
class RunBits:
    """Runs (start, end) of ones among length bits, apart from each other; positions start..end-1 are ones."""

    df: DataFrame
    length: int

    def cached(self) -> RunBits:
        return RunBits(self.df.cache(), self.length)

    def destroy(self) -> None:
        self.df.unpersist()

    @staticmethod
    def from_df(df: DataFrame, start: str, end: str, length: int) -> RunBits:
        """Empty runs go; runs must not overlap. Each is compared with the one before it in its bucket of positions, and
        the first of a bucket with all buckets before."""
        runs = df.select(F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
        keyed = runs.filter("start is null or end is null or start < end").withColumn("b", F.shiftright("start", shift_for(max(1, length))))
        ends = keyed.groupBy("b").agg(F.max("end").alias("e")).select("b", F.max("e").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
        here = F.max("end").over(W.partitionBy("b").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
        bad = (F.col("start") < 0) | (F.col("end") > length) | (F.col("start") < F.greatest(here, F.col("before")))
        seen = keyed.join(F.broadcast(ends), "b", "left").select(F.coalesce(bad, F.col("start").isNull() | F.col("end").isNull()).alias("bad"))
        if not seen.filter("bad").isEmpty():
            raise ValueError("runs must lie in 0..length and apart")
        return RunBits(runs.filter("start < end"), length)


@dataclass(frozen=True)
class Multiset:
    """Histogram (value, cnt) of non-negative integers."""

    df: DataFrame

    def cached(self) -> Multiset:
        return Multiset(self.df.cache())

    def destroy(self) -> None:
        self.df.unpersist()

    @staticmethod
    def from_df(df: DataFrame, value: str | Column) -> Multiset:
        """Of a column or an expression. Nulls, negative and broken numbers raise; the check reads the histogram."""
        raw = F.col(value) if isinstance(value, str) else value
        per = df.groupBy(raw.alias("raw")).agg(F.count("*").alias("cnt"))
        whole = F.expr("try_cast(raw as bigint)")
        if not per.filter(F.col("raw").isNull() | whole.isNull() | (F.col("raw") < 0) | (whole != F.col("raw"))).isEmpty():
            raise ValueError("values must be whole numbers from 0")
        return Multiset(per.select(whole.alias("value"), "cnt"))

    @staticmethod
    def from_values(spark: SparkSession, values: list[int]) -> Multiset:
        return Multiset.from_df(spark.createDataFrame([(v,) for v in values], "value long"), "value")
