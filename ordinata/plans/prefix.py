"""Running totals that no single task has to compute over all rows.

A window without partitions pulls every row into one task. Here rows fall into at most BUCKETS buckets by the
leading bits of their key; bucket totals are added up over that small table, and the rows of each bucket by a
window of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096


def shift_for(largest: int) -> int:
    return max(0, int(largest).bit_length() - (BUCKETS.bit_length() - 1))


def running_total(df: DataFrame, key: str, value: str, largest: int, low: str = "lo", high: str = "hi") -> DataFrame:
    """Adds the total of value before (low) and with (high) each row in order of key, a unique LONG from 0 to
    largest."""
    bucketed = df.withColumn("_b", F.shiftright(F.col(key), shift_for(largest)))
    totals = bucketed.groupBy("_b").agg(F.sum(value).alias("_t"))
    before = totals.select("_b", (F.sum("_t").over(W.orderBy("_b")) - F.col("_t")).alias("_before"))
    w = W.partitionBy("_b").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    # at most BUCKETS + 1 rows
    out = bucketed.join(F.broadcast(before), "_b").withColumn(high, (F.col("_before") + F.sum(value).over(w)).cast("long"))
    return out.withColumn(low, (F.col(high) - F.col(value)).cast("long")).drop("_b", "_before")
