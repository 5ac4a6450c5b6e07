"""The corpus pipeline: five operators of ``ordinata.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and gives the documents that are left, with the columns of documents; the last
one gives their tokens. ``run`` writes each stage's rows as Parquet to the shared folder and reads them again,
so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinata.llm import bpe, leaks, lines, neardups, quality
from ordinata.llm.common import shared_dir, table
from ordinata.llm.queries import automaton


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; n_chars is counted anew."""
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))  # so that no column can clash with the counts of lines
    text = f"c{names.index('text')}"
    kept = lines.dedup_lines(rows, text_col=text).withColumn(f"c{names.index('n_chars')}", F.length(text).cast("long")) if "n_chars" in names else lines.dedup_lines(rows, text_col=text)
    return kept.select(*rows.columns).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardups.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return leaks.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents (n_tokens and ids give way, if there are any), n_tokens, ids, and as text what the ids
    decode to."""
    return bpe.encode_texts(docs, automaton(), keep=tuple(docs.columns), decoded_col="text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: SQL can express neither the certified thresholds nor the near-duplicates nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
        if 0 < k < len(STAGES) - 1:  # the rows of the stage before are done with: an empty table takes their place
            spark.range(0).write.mode("overwrite").parquet(f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
