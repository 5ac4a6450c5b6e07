"""Secret scan by a trigram inverted index. DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query (``trigrams``): clauses, each a set of trigrams. The
index holds a posting (trigram, document) for each trigram that some query names. Postings are intersected clause
by clause: the documents that are in all of a clause's lists are the rule's candidates, and only candidates are
joined with their texts and verified by the expression itself. Rules without mandatory trigrams scan every text.
Texts that can't be candidates never leave their place: a filter of fixed size over the candidates' ids turns most
of them away before the join. Spans are code points, end exclusive, leftmost and non-overlapping for each rule: the
matches and the gaps between them give the offsets.

Defined results. A null text is empty and has no secret. Repeated rows and repeated ids are judged row
by row (postings are by id, and a wrong candidate is just verified in vain). Rows with a null id are
always scanned. An empty table gives no rows. Only the two named columns are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """pattern must mean the same to Java and to Python's parser. group: the part whose length counts;
    a match whose group is shorter than least is dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The contract's own kinds, in its order.
BASE = [
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Further kinds that the method adds.
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]
#: Words of 64 bits of the filter of candidates' ids: 2 MB as rows, for any input.
FILTER_WORDS = 1 << 17
SPAN = "array<struct<start:long,rank:int,end:long,kind:string>>"


def postings(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """(trigram, id): one posting for each trigram and text that holds it."""
    low = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"))
    has = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("id", F.explode(has).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame | None:
    """(id, kinds array): documents in the intersected postings of a clause of each of these kinds."""
    clauses = [(r.kind, clause) for r in rules for clause in trigram_query(r.pattern) or []]
    if not clauses:
        return None
    held = postings(docs, sorted({t for _, c in clauses for t in c}), id_col, text_col)
    # the rules' own constants: which clauses ask for a trigram, and of how many they are
    rows = [F.struct(F.lit(t).alias("trigram"), F.lit(k).alias("clause"), F.lit(len(c)).alias("size"), F.lit(kind).alias("kind")) for k, (kind, c) in enumerate(clauses) for t in sorted(c)]
    asked = docs.sparkSession.range(1).select(F.inline(F.array(*rows)))
    lists = held.join(F.broadcast(asked), "trigram")
    met = lists.groupBy("id", "clause", "size", "kind").agg(F.count_distinct("trigram").alias("n")).filter("n = size")
    return met.groupBy("id").agg(F.collect_set("kind").alias("kinds"))  # at most one entry for each rule


def _slot(id_: Column) -> tuple[Column, Column]:
    """(word, bit) of the filter."""
    h = F.xxhash64(id_)
    return F.pmod(h, F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 32).bitwiseAND(63).cast("int"))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """All spans of a rule, by start. Long texts cost a pass for the gaps and one for the matches. Matches are taken in
    blocks of about the root of their number, so that no list is copied for each match."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("long"))
    rows = F.zip_with(F.zip_with(found, parts, lambda f, p: F.struct(F.length(f).cast("long").alias("n"), F.length(p).alias("of"))), gaps,
                      lambda f, g: F.struct(g.alias("gap"), f["n"].alias("n"), f["of"].alias("of")))
    rows = F.filter(rows, lambda x: x["n"].isNotNull())
    zero, kind = F.lit(0).cast("long"), F.lit(rule.kind)

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["n"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), kind.alias("kind"))
        return F.struct(end.alias("at"), F.when(x["of"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def whole(rows: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(rows))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int")), lambda k: F.slice(rows, k * size + 1, size))
        width = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x["gap"] + x["n"]))
        starts = F.aggregate(width, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        none = F.array().cast(SPAN)
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    # the rows are named once, as the blocks ask for them again and again
    return F.element_at(F.transform(F.array(rows), whole), 1)


def _scanned(rows: DataFrame, rules: list[Rule], kinds: Column | None) -> DataFrame:
    """(id, spans): the rules without trigrams, and those of kinds, null for all."""
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast(SPAN)
    each = []
    for rank, rule in enumerate(rules):
        scanned = trigram_query(rule.pattern) is None
        if not scanned and kinds is None:
            continue
        # a cheap test first, as most texts have no match of most rules
        spans = F.when(text.rlike(rule.pattern), spans_of(text, rule, rank)).otherwise(none)
        each.append(spans if scanned else F.when(kinds.isNull() | F.array_contains(kinds, rule.kind), spans).otherwise(none))
    return rows.select("id", (F.array_sort(F.concat(*each)) if each else none).alias("spans"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = BASE + MORE) -> DataFrame:
    """id, spans array of (start, rank, end, kind) in order of start, then of the rules."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    listed = candidates(rows, rules, "id", "text")
    if listed is None:
        return _scanned(rows, rules, None).withColumnRenamed("id", id_col)
    listed = cut(listed)
    word, bit = _slot(F.col("id"))
    bits = listed.select(word.alias("_word"), bit.alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    # at most FILTER_WORDS rows
    known = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    tested = rows.withColumn("_word", F.coalesce(word, F.lit(-1))).join(F.broadcast(bits), "_word", "left").withColumn("maybe", known).select("id", "text", "maybe")
    others = _scanned(tested.filter(F.col("id").isNotNull() & ~F.col("maybe")), rules, None)
    some = join(tested.filter("maybe and id is not null"), listed, "id", "left").select("id", "text", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    lone = rows.filter("id is null").select("id", "text", F.lit(None).cast("array<string>").alias("kinds"))
    both = _scanned(some.unionByName(lone), rules, F.col("kinds"))
    return others.unionByName(both).withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
