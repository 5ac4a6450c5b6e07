"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as the contracts give it: \x20 and \x09-\x0D.
WS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that Spark sends to Python at once.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lowers (never raises) the session's bound of bytes in an Arrow batch: texts are long, and Spark's default of
    64 MB is held by the JVM and by Python at once. A batch may pass it by one row."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([a-z]?)b?", str(conf.get(name, "64m")).lower()).groups()
    if int(number) << 10 * " kmgtp".find(unit or " ") > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a worker for later stages, whose own needs come on top."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches, after which the worker gives its memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return bounded_batches(df).mapInArrow(whole, schema)


class Split:
    """A table as (row, text), so that texts pass through Python once: row is a struct of all other columns, named by
    place (c0, c1, ...), so that no name can clash."""

    def __init__(self, docs: DataFrame, text_col: str, keep: list[str] | None = None):
        names = docs.columns
        self.at, self.kind = names.index(text_col), docs.schema.fields[names.index(text_col)].dataType
        self.names = names if keep is None else keep
        self.places = [names.index(c) for c in keep] if keep is not None else list(range(len(names)))
        flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
        rest = [F.col(f"c{i}") for i in self.places if i != self.at]
        self.rows = flat.select(F.struct(*(rest or [F.lit(0).alias("none")])).alias("row"), F.col(f"c{self.at}").cast("string").alias("text"))

    def column(self, name: str) -> Column:
        i = self.places[self.names.index(name)]
        return F.col("text") if i == self.at else F.col(f"row.c{i}")

    def columns(self) -> list[Column]:
        """The columns that the table had, by their names."""
        return [(F.col("text").cast(self.kind) if i == self.at else F.col(f"row.c{i}")).alias(c) for i, c in zip(self.places, self.names)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Only a session on one
    machine may leave that unset, and gets a temporary folder."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='ordinata-')}"
        sc.setCheckpointDir(at)
    return at


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


#: Rows of a partition of a table whose size is known to be small.
PART_ROWS = 25_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: that cuts the lineage and survives lost
    executors, and the shuffle files that made it go at once. rows: a bound of their number, where one is known,
    for as many partitions as that takes."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/ordinata-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        (df if rows is None else df.coalesce(rows // PART_ROWS + 1)).write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._ordinata_at = at
    return out


def discard(*dfs: DataFrame) -> None:
    """Empty tables of ``cut`` that nothing reads any more."""
    for df in dfs:
        df.sparkSession.range(0).write.mode("overwrite").parquet(df._ordinata_at)


#: Rows of ids and numbers up to which a side of known size is broadcast: a few MB.
BROADCAST_ROWS = 50_000


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Both sides may grow with the input, so they are sorted and merged, which splits large keys. Only where
    right is known to have few rows (rows: a bound, of ids and numbers alone) it is broadcast."""
    return left.join(right.hint("broadcast" if rows is not None and rows <= BROADCAST_ROWS else "merge"), on, how)
