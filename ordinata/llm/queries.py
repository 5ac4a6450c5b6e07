"""Queries ``opN_<name>`` over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe, chat, leaks, lines, mil, neardups, passages, quality, secrets, urls
from .common import table

#: Host labels whose pages make the list of op8.
LISTED_LABELS = ["adult-x", "free-bets", "spam-farm"]


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    found = found.select(F.col("row.c0").alias("doc_id"), F.explode("leaks").alias("x"))
    return found.select("doc_id", F.col("x.item").cast("long").alias("item_id"), "x.start", "x.end", "x.edits")


@lru_cache(maxsize=2)
def automaton(path: str | None = None) -> bpe.Automaton:
    """The compiled vocabulary: it depends on the file alone."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.load(path)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    coded = bpe.encode_texts(table(spark, sf_dir, "documents"), automaton(path), decoded_col="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *map(of, kinds), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(F.split(urls.host_of(F.col("url")), r"\.")[0].isin(LISTED_LABELS)).select("url")
    return urls.filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = mil.learn(docs, labels.filter(~held))
    out = mil.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= mil.CUTOFF).cast("int").alias("predicted"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = turns.unionByName(probe)
    order = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    nodes = turns.withColumn("node", order)
    nodes = nodes.select(F.col("conv_id").alias("tree_id"), F.col("node").alias("node_id"), F.when(F.col("node") > 1, F.col("node") - 1).alias("parent_id"), "role", "text")
    out = chat.format_chats(nodes)
    back = out.select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply trees with branches: each conversation's messages as a tree in which the n-th replies to message n // 2, each
    scored by its length. The two best paths of each, with their turns and what the loss mask covers."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    nodes = turns.withColumn("node_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    nodes = nodes.withColumn("parent_id", F.when(F.col("node_id") > 1, F.floor(F.col("node_id") / 2))).withColumn("score", F.coalesce(F.length("text"), F.lit(0)).cast("double"))
    out = chat.format_chats(nodes, tree_col="conv_id", score_col="score", top=2)
    back = out.select("tree", "rank", "leaf", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.col("rank").cast("long").alias("place"), "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.sha2("loss", 256).alias("loss_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_url_filter": op8_url_filter,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_chat_format": op10_chat_format,
    "chat_branches": chat_branches,
}
