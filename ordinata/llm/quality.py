"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose risk value lies above a cutoff. Labelled documents are the holdout. Half of
them, by a hash of the id, choose in each stratum a path of steps (rule, cutoff): those of a fixed grid that
reject bad documents, each good one counted against ``GOOD_COSTS`` bad ones, in order of the share of good
documents rejected, then of bad ones. The other half certify: after j steps, a document is rejected if any of
the first j steps rejects it, and the exact binomial test says whether the rate of good ones among these is at
most alpha. Steps are tested one after another, as long as all tests before held (fixed sequence testing: no level
is lost on the number of steps), at the level delta / strata (Bonferroni over strata). So with probability 1 - delta
no stratum loses more than a share alpha of its good documents to all rules together. A stratum with too few
labels to certify anything has no method rejections, and neither has one that the labels lack.

Defined results. A null or empty text has no words and fails the base rules. A null stratum is a stratum
of its own. Labels that are null, or that contradict each other for a document, are left out; repeated
labels and repeated documents count once in the holdout, and all repeated rows get their verdict. Rows
with a null id are judged, but can't be labelled. Without labels only the base rules reject.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Split, cut, join, map_arrow

SYMBOLS = b"#*$%&|<>"
ALPHA, DELTA = 0.05, 0.05
GOOD_COSTS = 10
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]
#: Risk values of the rules.
RULES = ["symbols", "upper", "dup_lines", "repeats", "bangs"]
GRID = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8]
WS_DELETE = b" \t\n\x0b\x0c\r"
UPPER_DELETE = bytes(range(65, 91))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    # a word is covered if the window that starts at it, or one or two words before it, repeats
    steps = [0] * (len(words) + 1)
    for k, w in enumerate(windows):
        if seen[w] > 1:
            steps[k] += 1
            steps[k + 3] -= 1
    return sum(x > 0 for x in accumulate(steps[:-1]))


def counts_of(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at \x20 and \x09-\x0D, as bytes have no other white space
    blank = len(data) - len(data.translate(None, WS_DELETE))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (
        len(words), len(text) - blank, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), len(data) - len(data.translate(None, UPPER_DELETE)), data.count(b"!"),
    )


def _counted(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """rows has (row, text): adds the counts; the text goes unless it is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = np.array([counts_of(t) for t in part.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
                yield pa.record_batch([*part.columns[: 1 + keep_text], *(pa.array(got[:, k].copy()) for k in range(len(COUNTS)))], [*["row", "text"][: 1 + keep_text], *COUNTS])

    return map_arrow(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, " + "text string, " * keep_text + ", ".join(f"{c} long" for c in COUNTS))


def risk(rule: str) -> Column:
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    return {"symbols": F.col("n_symbols") / words, "upper": F.col("n_upper") / chars, "dup_lines": F.col("n_dup_lines") / lines, "repeats": F.col("n_repeat_words") / words, "bangs": F.col("n_bangs") / words}[rule]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k): all terms, summed in logarithms from the largest down. Terms that no longer change the sum
    are bounded by a geometric series, which is added: what is left out never makes the result too small."""
    if k >= n:
        return 1.0
    top = min(k, int((n + 1) * p))  # of terms 0..k the largest
    base = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    total, term, i = 1.0, 1.0, top
    while i > 0:
        ratio = i * (1 - p) / ((n - i + 1) * p)
        term *= ratio
        total += term
        i -= 1
        if term < 1e-18:
            total += term * i  # terms fall below the top
            break
    term, i = 1.0, top
    while i < k:
        term *= (n - i) * p / ((i + 1) * (1 - p))
        total += term
        i += 1
        if term < 1e-18:
            total += term * (k - i)
            break
    return min(1.0, math.exp(base + math.log(total)))


#: A stratum's steps in order: [(rule, cutoff)], those that are certified.
Path = list[tuple[str, float]]


def steps(row: dict) -> Path:
    """The path that the choosing half's counts give: g_r_k and b_r_k good and bad documents that cutoff k of rule r rejects."""
    some = []
    for i, rule in enumerate(RULES):
        for k, at in enumerate(GRID):
            good, bad = row[f"g_{rule}_{k}"], row[f"b_{rule}_{k}"]
            if bad > GOOD_COSTS * good:
                some.append((good, -bad, i, -k, rule, at))
    return [x[-2:] for x in sorted(some)]


def certified(path: Path, rejected: dict[int, int], n_good: int, level: float, alpha: float = ALPHA) -> Path:
    """The steps before the first one whose test fails. rejected: good documents of the certifying half by the first step
    that rejects them; n_good: all of them."""
    good = 0
    for j in range(len(path)):
        good += rejected.get(j, 0)
        if binomial_cdf(good, n_good, alpha) > level:
            return path[:j]
    return path


def chooses(id_: Column) -> Column:
    """Is the document in the half that chooses?"""
    return F.substring(F.md5(F.concat(id_.cast("string"), F.lit("/half"))), 1, 1) < "8"


def first_step(path: Column) -> Column:
    """The place of the first step of path, an array of (rule's number from 1, cutoff), that rejects the document; -1 if
    none does."""
    risks = F.array(*(risk(r) for r in RULES))
    return F.array_position(F.transform(path, lambda x: F.element_at(risks, x["rule"]) > x["at"]), True).cast("int") - 1


def thresholds(features: DataFrame, labels: DataFrame, *, stratum: Column, label_id: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> dict[str, Path]:
    """Stratum to its certified steps. features: id and COUNTS. What reaches the driver is one row of counts for each
    stratum that has enough good labels to certify a step, and one for each such stratum and step."""
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("id", "y")
    held = join(features.select("id", stratum.alias("stratum"), *COUNTS), known, "id")
    # rows of an id are one document: of texts that differ, the row of the largest counts
    held = held.groupBy("id").agg(F.max(F.struct("stratum", "y", *COUNTS)).alias("x")).select("id", "x.*").withColumn("chooses", chooses(F.col("id")))
    held = cut(held)
    risks = held.select("stratum", "y", "chooses", *(risk(r).alias(r) for r in RULES))
    # as text, since a hundred expressions take long to build one call after the other
    sums = [f"count_if(y = {y} and chooses and {r} > {at!r}D) as {name}_{r}_{k}" for name, y in (("g", 1), ("b", 0)) for r in RULES for k, at in enumerate(GRID)]
    per = cut(risks.groupBy("stratum").agg(*map(F.expr, ["count_if(y = 1 and not chooses) as n_good", *sums])))
    level = delta / max(1, per.count())
    least = math.floor(math.log(level) / math.log1p(-alpha))  # below it not even a step without a false rejection passes
    rows = [r.asDict() for r in per.filter(F.col("n_good") >= least).collect()]
    paths = {r["stratum"]: path for r in rows if (path := steps(r))}
    if not paths:
        return {}
    table = held.sparkSession.createDataFrame([(s, [(RULES.index(r) + 1, at) for r, at in path]) for s, path in paths.items()], "stratum string, path array<struct<rule:int,at:double>>")
    first = join(held.filter("y = 1 and not chooses"), table, "stratum", rows=len(paths)).select("stratum", first_step(F.col("path")).alias("step"))
    lost: dict[str, dict[int, int]] = {s: {} for s in paths}
    for r in first.filter("step >= 0").groupBy("stratum", "step").agg(F.count("*").alias("n")).collect():
        lost[r["stratum"]][r["step"]] = r["n"]
    n_good = {r["stratum"]: r["n_good"] for r in rows}
    return {s: sure for s, path in paths.items() if (sure := certified(path, lost[s], n_good[s], level, alpha))}


def _judged(counted: DataFrame, limits: dict[str, Path], stratum: Column) -> DataFrame:
    """Adds base_failed, rejected_by (rules) and kept."""
    spark = counted.sparkSession
    cuts = [(s, [min((at for r, at in path if r == rule), default=None) for rule in RULES]) for s, path in sorted(limits.items())]
    table = spark.createDataFrame([(s, *x) for s, x in cuts], "s string, " + ", ".join(f"max_{r} double" for r in RULES))
    # one row for each certified stratum, which has some 80 labels at least; broadcast only where they are few
    out = join(counted.withColumn("s", stratum), table, "s", "left", rows=len(cuts))
    by = F.array_compact(F.array(*(F.when(risk(r) > F.col(f"max_{r}"), F.lit(r)) for r in RULES)))
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", by)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def stratum_of(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("\0null"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """id, COUNTS, base_failed, rejected_by, kept for each row. Texts are read once; the counts are kept in
    the shared folder."""
    rows = docs.select(F.struct(docs[id_col].alias("id"), stratum_of(docs[stratum_col]).alias("stratum")).alias("row"), docs[text_col].cast("string").alias("text"))
    counted = cut(_counted(rows).select("row.id", "row.stratum", *COUNTS))
    limits = thresholds(counted, labels, stratum=F.col("stratum"), alpha=alpha, delta=delta)
    return _judged(counted, limits, F.col("stratum")).select(F.col("id").alias(id_col), *COUNTS, "base_failed", "rejected_by", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs. Texts are read and counted once, and never shuffled; they
    wait in the shared folder, with their counts, until the thresholds are known."""
    split = Split(docs, text_col)
    counted = cut(_counted(split.rows, keep_text=True))
    stratum = stratum_of(split.column(stratum_col))
    limits = thresholds(counted.select(split.column(id_col).alias("id"), stratum.alias("stratum"), *COUNTS), labels, stratum=F.col("stratum"), alpha=alpha, delta=delta)
    return _judged(counted, limits, stratum).filter("kept").select(*split.columns())
