"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles, banded, and
verified by weighted Jaccard similarity.

Texts with equal words (but for case and blanks) are one node. A node's signature holds BANDS * ROWS
samples (shingle, t) of improved consistent weighted sampling; two nodes agree in a sample with a
probability equal to their weighted Jaccard similarity. Nodes that agree in a whole band are in a bucket.

Within a bucket not all pairs are formed. In each round, a bucket with few nodes left is finished exactly:
they are compared with all of the bucket outside their own components. In any other bucket the most
central of the nodes left (the one with most bucket mates over all of its bands) is compared with all of the
bucket outside its own component; links are then contracted to components, and the nodes left for the next
round are those in no former pivot's component. So a group of copies, however large, costs one
comparison for each copy and centre. Buckets that were large in two rounds or more may then still hold pairs of
different components that were never compared: these are all compared, block by block, so that no pair of a
bucket is left out but those within one component.

Defined results. Texts that are null or have no word are classes of their own. Rows with a null id are compared
like all others. Repeated rows fall into one class. The class id is the least id in the class, null if there is
none. An id may stand for several texts. An empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, discard, join, map_arrow
from .components import components
from .shingles import WORDS, Weights, common_shingles, text_key, text_words, weighted_jaccard

BANDS, ROWS = 10, 3
SIMILARITY = 0.8
#: Nodes outside the pivots' components up to which a bucket is finished exactly, by round.
FEW = [4, 12, 24, 40]
#: Nodes of a block, about, where a bucket's pairs are compared block by block.
BLOCK = 128
LEVELS = 1 << 12


def gamma_quantiles(n: int = LEVELS) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at (k + 1/2) / n, by bisection."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        under = 1 - np.exp(-mid) * (1 + mid) < p
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


class Sampler:
    """Improved consistent weighted sampling; all randomness is a function of shingle and sample number."""

    def __init__(self, samples: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, samples, dtype=np.uint64)
        r = gamma_quantiles()
        self.r, self.log_c = r.astype(np.float32), np.log(r).astype(np.float32)

    def __call__(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Samples as 64-bit hashes of (shingle, t)."""
        best = np.full(len(self.a), np.inf, np.float32)
        out = np.zeros(len(self.a), np.uint64)
        for lo in range(0, len(keys), 8192):
            x, w = keys[lo : lo + 8192], weights[lo : lo + 8192]
            z = x[None, :] ^ self.b[:, None]
            z *= self.a[:, None]
            z ^= z >> np.uint64(32)
            r = self.r[z >> np.uint64(52)]
            log_c = self.log_c[(z >> np.uint64(40)) & np.uint64(LEVELS - 1)]
            beta = ((z >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32)
            beta *= np.float32(2**-24)
            odd = w != 1.0
            if odd.any():
                t = np.zeros(r.shape, np.float32)
                t[:, odd] = np.floor(np.log(w[odd]).astype(np.float32) / r[:, odd] + beta[:, odd])
                log_a = log_c - r * (t - beta + 1)
            else:
                t = None  # log w is 0, so t is
                log_a = log_c - r * (1 - beta)
            at = log_a.argmin(axis=1)
            rows = np.arange(len(at))
            least = log_a[rows, at]
            better = least < best
            mark = x[at] if t is None else x[at] + t[rows, at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            best[better], out[better] = least[better], mark[better]
        return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        h = (h ^ samples.reshape(bands, rows)[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def signatures(docs: DataFrame, weights: Weights, *, id_col: str, text_col: str, size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, node, bands): node is null for texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, w = Sampler(bands * rows), shared.value
        known: dict[bytes, np.ndarray] = {}  # copies are sampled once
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                nodes, keys = [], []
                for h in text_words(b.column(1).to_pylist()):
                    node = text_key(h) if len(h) else None
                    if node is not None and node not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[node] = band_keys(sample(*w.of(h, size)), bands, rows)
                    nodes.append(node)
                    keys.append(known.get(node))
                yield pa.record_batch([b.column(0), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "node", "bands"])

    rows_ = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(rows_, run, f"id {rows_.schema['id'].dataType.simpleString()}, node binary, bands array<long>")


def verified(pairs: DataFrame, content: DataFrame, weights: Weights, similarity: float, size: int = WORDS) -> DataFrame:
    """pairs (a, b) whose texts are at least this similar, with the similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    left = content.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = content.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = join(join(pairs, left, "a"), right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, kept = shared.value, OrderedDict()

        def bag(node: bytes, text: str):
            if node not in kept:
                kept[node] = w.of(next(text_words([text])), size)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[node]

        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                part = whole.slice(lo, 256)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                s = np.array([weighted_jaccard(bag(x, tx), bag(y, ty)) for x, y, tx, ty in zip(a, b, part.column(2).to_pylist(), part.column(3).to_pylist())])
                ok = pa.array(s >= similarity)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(s)], ["a", "b", "similarity"]).filter(ok)

    return map_arrow(both, run, "a binary, b binary, similarity double")


def _between(members: DataFrame, hard: DataFrame, roots: DataFrame | None, n: int, n_roots: int, content: DataFrame, weights: Weights, similarity: float, size: int) -> DataFrame:
    """Links (a, b, similarity) of all pairs in the hard buckets that are of different components. A component of
    more than a block has blocks of its own, which aren't compared with each other."""
    rows = join(members.select("bucket", "node"), hard, "bucket", rows=n)
    rows = cut(rows.withColumn("root", F.col("node")) if roots is None else _rooted(rows, roots, n_roots), n)
    per = rows.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    own = F.col("c") > BLOCK
    sums = per.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum(F.when(own, 0).otherwise(F.col("c"))).alias("rest")).filter("parts > 1")
    per = join(per, sums, "bucket").select("bucket", "root", F.when(own, F.col("root")).otherwise(F.lit(b"")).alias("x"), F.ceil(F.when(own, F.col("c")).otherwise(F.col("rest")) / BLOCK).alias("blocks"))
    dealt = cut(join(rows, per, ["bucket", "root"]).select("bucket", "node", "root", "x", F.pmod(F.xxhash64("node", "bucket"), "blocks").alias("i")), n)
    blocks = dealt.select("bucket", "x", "i").distinct()
    two = join(blocks, blocks.select("bucket", F.col("x").alias("y"), F.col("i").alias("j")), "bucket").filter("struct(x, i) <= struct(y, j) and (x != y or x = X'')")
    two = cut(two)
    texts = join(dealt, content, "node")
    task = ["bucket", "x", "i", "y", "j"]
    left = join(texts, two, ["bucket", "x", "i"]).select(*task, F.lit(0).alias("side"), "node", "root", "text")
    right = join(texts.withColumnsRenamed({"x": "y", "i": "j"}), two.filter("x != y or i != j"), ["bucket", "y", "j"]).select(*task, F.lit(1).alias("side"), "node", "root", "text")
    shared = members.sparkSession.sparkContext.broadcast(weights)

    def run(t: pa.Table) -> pa.Table:
        side, node, root = t.column("side").to_numpy(), t.column("node").to_pylist(), t.column("root").to_pylist()
        bags = [shared.value.of(h, size) for h in text_words(t.column("text").to_pylist())]
        total = np.array([w.sum() for _, w in bags])
        alone = not side.any()  # a block with itself
        others = np.flatnonzero(side == (0 if alone else 1))
        keys, ws = (np.concatenate([bags[j][k] for j in others]) for k in (0, 1))
        whose = np.repeat(np.arange(len(others)), [len(bags[j][0]) for j in others])
        out = []
        for i in np.flatnonzero(side == 0):
            k, w = bags[i]
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            hit = k[at] == keys
            both = np.bincount(whose[hit], np.minimum(w[at[hit]], ws[hit]), len(others))
            for j in others[both >= (similarity - 1e-9) * (total[i] + total[others] - both)]:
                if root[i] != root[j] and not (alone and node[i] > node[j]):
                    s = weighted_jaccard(bags[i], bags[j])
                    if s >= similarity:
                        out.append((min(node[i], node[j]), max(node[i], node[j]), s))
        a, b, s = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    found = left.unionByName(right).groupBy(*task).applyInArrow(run, "a binary, b binary, similarity double")
    return cut(found.dropDuplicates(["a", "b"]))  # nodes may share several buckets


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, text, key), the key of the text's words; null without words."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            b = whole.slice(lo, 512)
            keys = [text_key(h) if len(h) else None for h in text_words(b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.binary())], ["row", "text", "key"])


def _keyed(rows: DataFrame, row: Column, text: Column) -> DataFrame:
    picked = rows.select(row.alias("row"), text.alias("text"))
    return map_arrow(picked, _with_key, f"row {picked.schema['row'].dataType.simpleString()}, text string, key binary")


def _contents(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) for nodes (node, least); a node without an id is found by its words."""
    rows = docs.select("id", F.col("text").cast("string").alias("text"))
    by_id = join(rows, nodes.filter("least is not null").select(F.col("least").alias("id"), "node"), "id")
    by_id = _keyed(by_id, F.col("node"), F.col("text")).filter("row = key").select("key", "text")
    other = _keyed(rows.filter("id is null"), F.lit(0), F.col("text")).select("key", "text")
    other = join(other, nodes.filter("least is null").select(F.col("node").alias("key")), "key")
    return by_id.unionByName(other).groupBy(F.col("key").alias("node")).agg(F.min("text").alias("text"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: id, class_id, n_links (verified links of the row's text to others),
    n_copies (rows of equal words)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return _grouped(rows, **how).select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies")


def _grouped(docs: DataFrame, *, similarity: float = SIMILARITY, size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs: (id, text). For each row id, node (null without words), first (the node that stands for the class),
    class_id, n_links, n_copies."""
    bounded_batches(docs)
    weights = Weights(*common_shingles(docs, "text", size))
    signed = cut(signatures(docs, weights, id_col="id", text_col="text", size=size, bands=bands, rows=rows))
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min("bands").alias("bands"), F.count("*").alias("n_copies"))
    nodes = cut(nodes)
    # buckets of two nodes or more, and each node's number of mates
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(join(members, sizes, "bucket"))
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    members = join(members, score, "node").select("bucket", "node", "score")
    n = members.count()
    members = cut(members, n)
    content = cut(_contents(docs, join(nodes, members.select("node").distinct(), "node", "left_semi").select("least", "node")))
    links, tried, roots, n_roots, n_tried, hard = None, None, None, 0, 0, None
    left = members.withColumn("root", F.col("node"))  # those that pivots are taken from
    for turn, few in enumerate(FEW):
        here = members.withColumn("root", F.col("node")) if roots is None else _rooted(members, roots, n_roots)
        heads = left.groupBy("bucket").agg(F.count("*").alias("m"), F.max(F.struct("score", "node", "root")).alias("p"))
        heads = cut(heads.select("bucket", "m", F.col("p.node").alias("pivot"), F.col("p.root").alias("pivot_root")), n)
        large = heads.filter(F.col("m") > few)
        if turn == 1:  # one pivot leaves no pair of other components' nodes behind, two may
            hard = large.select("bucket")
        last = join(left.select("bucket", "node", "root"), heads.filter(F.col("m") <= few), "bucket", rows=n).select("bucket", F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
        against = large.select("bucket", "pivot", "pivot_root").unionByName(last)
        pairs = join(here, against, "bucket", rows=n).filter("root != pivot_root").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        if tried is not None:
            pairs = join(pairs, tried, ["a", "b"], "left_anti", n_tried)
        pairs = cut(pairs)
        n_tried += pairs.count()
        found = cut(verified(pairs, content, weights, similarity, size))
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        n_roots = 0 if roots is None else roots.count()
        if turn == len(FEW) - 1:
            break
        big = join(left.select("bucket", "node", "score"), large.select("bucket", "pivot"), "bucket", rows=n)
        if roots is not None:
            big = _rooted(big, roots, n_roots)
            big = join(big, roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root")), "pivot", "left", n_roots).withColumn("pivot_root", F.coalesce("pivot_root", "pivot"))
        else:
            big = big.withColumn("root", F.col("node")).withColumn("pivot_root", F.col("pivot"))
        left = cut(big.filter("root != pivot_root").select("bucket", "node", "score", "root"), n)
        if left.isEmpty():
            break
    if hard is not None:
        more = _between(members, hard, roots, n, n_roots, content, weights, similarity, size)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
    discard(content)
    return _classes(signed, nodes, links, roots)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each class, of the least id, with the columns of docs; of repeated rows one stays. Rows without
    words stay, but for repeated ones of an id."""
    names = docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    i, t = (f"c{names.index(c)}" for c in (id_col, text_col))
    classes = _grouped(flat.select(F.col(i).alias("id"), F.col(t).cast("string").alias("text")), **how)
    key = F.coalesce("node", F.lit(b"")).alias("_node")
    texts = classes.filter("id is not null").groupBy("id").agg(F.count_distinct(key).alias("n"))
    kept = classes.filter(F.col("id").eqNullSafe(F.col("class_id")) & F.col("node").eqNullSafe(F.col("first"))).select("id", key).distinct()
    kept = cut(join(kept, texts, "id").select(F.col("id").alias(i), "_node", "n"))
    with_id, text = flat.filter(F.col(i).isNotNull()), F.col(t).cast("string")
    one = join(with_id, kept.filter("n = 1").drop("n"), i)
    # an id of several texts: its rows are told apart by their words
    several = join(with_id, texts.filter("n > 1").select(F.col("id").alias(i)), i, "left_semi")
    odd = _keyed(several, F.struct(*flat.columns), text).select("row.*", F.coalesce("key", F.lit(b"")).alias("_node"))
    odd = join(odd, kept.filter("n > 1").drop("n"), [i, "_node"])
    w = W.partitionBy(i, "_node").orderBy(F.xxhash64(t), F.xxhash64(*flat.columns))
    once = one.unionByName(odd).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*flat.columns)
    lone = classes.filter("id is null and class_id is null and node is not null and node = first").select("node").distinct()
    none = _keyed(flat.filter(F.col(i).isNull()), F.struct(*flat.columns), text)
    w = W.partitionBy("key").orderBy(F.xxhash64("row"))
    first = join(none.filter("key is not null"), lone.select(F.col("node").alias("key")), "key").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("row.*")
    return once.unionByName(first).unionByName(none.filter("key is null").select("row.*")).toDF(*names)


def _rooted(rows: DataFrame, roots: DataFrame, n: int | None = None) -> DataFrame:
    return join(rows, roots, "node", "left", n).withColumn("root", F.coalesce("root", "node"))


def _classes(signed: DataFrame, nodes: DataFrame, links: DataFrame, roots: DataFrame | None) -> DataFrame:
    rooted = nodes.withColumn("root", F.col("node")) if roots is None else _rooted(nodes, roots)
    # the class's first node: of the least id, ids before none
    best = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("class_id"), F.col("node").alias("first")))
    ids = rooted.groupBy("root").agg(best.alias("x")).select("root", "x.class_id", "x.first")
    per = join(rooted, ids, "root").select("node", "class_id", "first", "n_copies")
    if roots is None:
        per = per.withColumn("n_links", F.lit(0).cast("long"))
    else:
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
        per = join(per, ends, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    per = cut(per)  # so that the join with its rows can split a node of very many copies
    lone = signed.filter("node is null").select("id", "node", F.col("node").alias("first"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return join(signed.filter("node is not null").select("id", "node"), per, "node").select("id", "node", "first", "class_id", "n_links", "n_copies").unionByName(lone)
