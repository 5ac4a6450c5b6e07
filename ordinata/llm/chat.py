"""Chat formatting over reply trees. DataFrame functions only.

``reply_paths`` enumerates root-to-leaf paths by iterated self-joins: pointer doubling first gives each
message its root, depth and path score in log2(depth) joins, and keeps each round's jump table; leaves
are then ranked by score, and joining the chosen leaves with one jump table after another adds their
ancestors, each exactly once. ``format_chats`` writes each path as one string with a loss mask.

Template: an assistant turn is ``<s>ROLE<sep>TEXT</s>``, any other turn ``[INST]ROLE<sep>TEXT[/INST]``.
Inside roles and texts a backslash is doubled, and a control string gets a backslash after its first
character, so no control string is left in them; ``unescape`` takes both back.

Defined results. Null role or text: empty. A parent that is null or missing: the message is a root.
Messages on a cycle have no root and are left out. Null tree ids form one tree of their own. Equal
scores: the smaller leaf id ranks first. Of messages with the same node id in a tree the first by parent (none before
any), then role and text, counts, so repeated rows change nothing; messages without a node id are left out. An empty
table gives no rows. Only the named columns are used, so further columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Control strings of the template.
BEGIN, END, INST, INST_END, SEP = "<s>", "</s>", "[INST]", "[/INST]", "<sep>"
CONTROLS = [BEGIN, END, INST, INST_END, SEP]


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _up(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join left (l.tree, l.ptr) with right (r.tree, r.node)."""
    return left.alias("l").join(right.alias("r"), F.col("l.tree").eqNullSafe(F.col("r.tree")) & (F.col("l.ptr") == F.col("r.node")), how)


def reply_paths(messages: DataFrame, *, tree_col: str = "tree_id", id_col: str = "node_id", parent_col: str = "parent_id", score_col: str | None = None, top: int | None = None) -> DataFrame:
    """(tree, leaf, rank, path_score, node, pos): the messages of each path chosen, pos from 1 at the root.
    rank orders a tree's leaves by the mean score of their path; top keeps that many of each tree."""
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    nodes = messages.filter(F.col(id_col).isNotNull()).select(F.col(tree_col).alias("tree"), F.col(id_col).cast("long").alias("node"), F.col(parent_col).cast("long").alias("ptr"), score.alias("score"))
    return _paths(nodes.groupBy("tree", "node").agg(F.min(F.struct("ptr", "score")).alias("x")).select("tree", "node", "x.*"), top)


def _paths(nodes: DataFrame, top: int | None) -> DataFrame:
    """nodes: (tree, node, ptr, score), each node once."""
    # a parent that isn't there makes a root
    known = nodes.select("tree", "node")
    state = cut(_up(nodes, known, "left").select("l.tree", "l.node", F.col("r.node").alias("ptr"), F.lit(1).cast("long").alias("depth"), "l.score"))
    leaves = state.alias("l").join(state.alias("c"), F.col("l.tree").eqNullSafe(F.col("c.tree")) & (F.col("l.node") == F.col("c.ptr")), "left_anti").select("tree", "node")
    jumps, roots, open_ = [], [state.filter("ptr is null")], state.filter("ptr is not null")
    rounds = state.count().bit_length()  # no path has more messages than there are; what is open then is on a cycle
    while len(jumps) < rounds and not open_.isEmpty():
        # only messages that haven't met their root go on; they look up any message
        jumps.append(open_.select("tree", "node", "ptr"))
        known = open_
        for done in roots:
            known = known.unionByName(done)
        state = cut(_up(open_, known, "inner").select(
            "l.tree", "l.node", F.col("r.ptr").alias("ptr"), (F.col("l.depth") + F.col("r.depth")).alias("depth"), (F.col("l.score") + F.col("r.score")).alias("score"),
        ))
        roots.append(state.filter("ptr is null"))
        open_ = state.filter("ptr is not null")
    state = roots[0]
    for done in roots[1:]:
        state = state.unionByName(done)
    ends = state.alias("s").join(leaves.alias("l"), F.col("s.tree").eqNullSafe(F.col("l.tree")) & (F.col("s.node") == F.col("l.node")), "left_semi")
    ends = ends.select("tree", F.col("node").alias("leaf"), (F.col("score") / F.col("depth")).alias("path_score"), "depth")
    ends = ends.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if top is not None:
        ends = ends.filter(F.col("rank") <= top)
    paths = ends.select("tree", "leaf", "rank", "path_score", F.col("leaf").alias("node"), F.col("depth").alias("pos"))
    # longest jumps first: short paths then stay one row until their own lengths come up
    for k, jump in reversed(list(enumerate(jumps))):
        both = paths.alias("l").join(jump.alias("r"), F.col("l.tree").eqNullSafe(F.col("r.tree")) & (F.col("l.node") == F.col("r.node")), "left")
        here = F.struct(F.col("l.node").alias("node"), F.col("l.pos").alias("pos"))
        there = F.struct(F.col("r.ptr").alias("node"), (F.col("l.pos") - F.lit(2**k)).alias("pos"))
        at = F.explode(F.when(F.col("r.ptr").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at")
        paths = both.select("l.tree", "l.leaf", "l.rank", "l.path_score", at).select("tree", "leaf", "rank", "path_score", "at.node", "at.pos")
    return paths


def format_chats(messages: DataFrame, *, tree_col: str = "tree_id", id_col: str = "node_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str | None = None, top: int | None = None, assistant: str = "assistant") -> DataFrame:
    """tree, leaf, rank, path_score, formatted string, loss_spans array of (start, len) in code points of
    ``formatted``: the assistants' escaped texts, in order."""
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    named = messages.filter(F.col(id_col).isNotNull()).select(
        F.col(tree_col).alias("tree"), F.col(id_col).cast("long").alias("node"),
        F.struct(F.col(parent_col).cast("long").alias("ptr"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), score.alias("score")).alias("x"))
    once = cut(named.groupBy("tree", "node").agg(F.min("x").alias("x")).select("tree", "node", "x.*"))
    paths = _paths(once.select("tree", "node", "ptr", "score"), top)
    ours = F.coalesce(F.col("role") == assistant, F.lit(False))
    head = F.concat(F.when(ours, BEGIN).otherwise(INST), escape(F.col("role")), F.lit(SEP))
    pieces = once.select(
        F.col("tree").alias("m_tree"), F.col("node").alias("m_node"), ours.alias("ours"),
        F.concat(head, escape(F.col("text")), F.when(ours, END).otherwise(INST_END)).alias("piece"),
        F.length(head).cast("long").alias("lead"), F.length(escape(F.col("text"))).cast("long").alias("len"),
    ).withColumn("whole", F.length("piece").cast("long"))
    rows = paths.join(pieces, F.col("tree").eqNullSafe(F.col("m_tree")) & (F.col("node") == F.col("m_node")))
    w = W.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("whole").over(w), F.lit(0)) + F.col("lead"))
    turns = rows.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(F.struct("pos", "piece", "ours", "start", "len"))).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["ours"]), lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len")))
    return turns.select("tree", "leaf", "rank", "path_score", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), mask.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as array of (role, text)."""
    parts = F.filter(F.split(formatted, r"</s>|\[/INST\]"), lambda x: x != "")
    bare = F.transform(parts, lambda x: F.regexp_replace(x, r"^(<s>|\[INST\])", ""))
    return F.transform(bare, lambda x: F.struct(
        unescape(F.substring_index(x, SEP, 1)).alias("role"), unescape(F.substring_index(x, SEP, -1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["len"].cast("int")))), "")
