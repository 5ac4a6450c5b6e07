"""URL filter, chat formatting and the pipeline: edge cases and brute-force versions."""

import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ordinata.llm import chat, components, leaks, lines, neardups, quality, shingles, urls

ROOT = Path(__file__).resolve().parents[2]


# URLs


def test_urls(spark):
    pages = [
        (1, "http://A.Example.com/en/7x?q"), (2, "https://b.com/en/8"), (3, "https://com/en/"), (4, "x://example.net/de/8#f"), (5, "x://y.net/de/"), (6, "nothing"), (7, None), (8, ""),
        (9, "http://www.Bad.org/p/?utm_x=1&b=2&a=1#top"), (10, "https://bad.org/p?a=1&b=2"), (10, "https://bad.org/p?a=1&b=2"), (None, "https://bad.org/p?a=1"), (11, "://"), (12, "http://notcom/en/"), (13, "http://h?x"), (14, "http://é.ORG/es/É"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("id", F.lit("x")).withColumn("w0", F.lit(1)).withColumn("block", F.lit(2))
    listed = spark.createDataFrame([("http://bad.org/p/?b=2&a=1",), ("http://bad.org/p/?b=2&a=1",), (None,), ("no scheme",)], "url string")
    for most in (urls.MAX_BROADCAST_BLOCKS, 0):
        out = urls.filter_urls(df, listed, max_broadcast_blocks=most).collect()
        got = defaultdict(list)
        for r in out:
            got[r.page_id].append((r.host, r.path, r.rule, r.verdict, r.listed))
        assert got[1] == [("a.example.com", "/en/7x", "example.com/en/7", "allow", False)]
        assert got[2] == [("b.com", "/en/8", "com/en/", "block", False)] and got[3][0][2] == "com/en/"
        assert got[4][0][2:4] == ("example.net/de/8", "allow") and got[5][0][2:4] == ("net/de/", "block")
        assert got[6] == got[7] == got[8] == got[11] == [("", "", None, "allow", False)]
        assert [x[3:] for x in got[9] + got[10]] == [("block", True)] * 3 and got[None][0][3:] == ("allow", False)
        assert got[12][0][2] is None and got[13][0][:2] == ("h", "") and got[14][0] == ("é.org", "/es/É", "org/es/", "block", False)
        assert not any(r.listed and not r.maybe_listed for r in out) and len(out) == len(pages)
    assert urls.filter_urls(df, listed.limit(0)).filter("listed").count() == 0
    assert urls.filter_urls(df.limit(0), listed).count() == 0


def test_filter_passes_few_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("http://l.x/"), "id").alias("url"))
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://l.x/"), F.col("id") + 4000).alias("url"))
    out = urls.filter_urls(pages, listed)
    assert out.filter("listed").count() == 1000 and out.filter("maybe_listed and not listed").count() < 200


# Chats


def test_reply_trees(spark):
    # 1 - 2 - 3, 2 - 4 - 5, a second root 9, an orphan 20 and a cycle 30 - 31
    rows = [(1, None, 0.0), (2, 1, 1.0), (3, 2, 5.0), (4, 2, 1.0), (5, 4, 9.0), (9, None, 0.5), (20, 19, 2.0), (30, 31, 9.0), (31, 30, 9.0)]
    both = [(t, n, p, s) for t in (7, None) for n, p, s in rows]
    df = spark.createDataFrame(both, "tree_id long, node_id long, parent_id long, score double")
    got = defaultdict(list)
    for r in chat.reply_paths(df, score_col="score").orderBy("pos").collect():
        got[(r.tree, r["rank"], r.leaf)].append(r.node)
    want = {(1, 5): [1, 2, 4, 5], (2, 3): [1, 2, 3], (2, 20): [20], (4, 9): [9]}
    for tree in (7, None):
        mine = {leaf: (rank, path) for (t, rank, leaf), path in got.items() if t == tree}
        assert {leaf: path for leaf, (_, path) in mine.items()} == {leaf: path for (_, leaf), path in want.items()}
        assert sorted(mine, key=lambda x: mine[x][0]) == [5, 3, 20, 9]  # means 2.75, 2, 2 (the smaller leaf first), 0.5
    assert {r.leaf for r in chat.reply_paths(df, score_col="score", top=1).collect()} == {5}
    assert chat.reply_paths(df.limit(0)).count() == 0
    again = df.unionByName(df.limit(4)).unionByName(df.limit(1).selectExpr("tree_id", "null as node_id", "parent_id", "score"))
    assert sorted(chat.reply_paths(again, score_col="score").collect(), key=str) == sorted(chat.reply_paths(df, score_col="score").collect(), key=str)
    # rows that repeat a node id: the first by parent, role and text counts
    odd = spark.createDataFrame([(1, 1, None, "user", "b"), (1, 1, None, "user", "a"), (1, 2, 1, "assistant", "x"), (1, 2, 1, "assistant", "x"), (1, 2, 9, "assistant", "y")], "tree_id long, node_id long, parent_id long, role string, text string")
    (r,) = chat.format_chats(odd).collect()
    assert r.formatted == "[INST]user<sep>a[/INST]<s>assistant<sep>x</s>"


def test_formats_come_back(spark):
    r = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<sep>", "\\", "<", "[", "s>", "\n", "a", "é🙂", "\\<s>", "<\\s>"]
    turns = [(t, n, n - 1 if n else None, r.choice(["user", "assistant", "system", "<sep>", None]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 9)))])) for t in range(40) for n in range(r.randint(1, 20))]
    df = spark.createDataFrame(turns, "tree_id long, node_id long, parent_id long, role string, text string").withColumn("pos", F.lit(3)).withColumn("leaf", F.lit(4))
    out = chat.format_chats(df).select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(out) == 40
    for x in out:
        want = [(role or "", text or "") for t, _, _, role, text in turns if t == x.tree]
        assert [(m.role, m.text) for m in x.t] == want
        assert x.loss == "".join(text for role, text in want if role == "assistant")


# Components and the pipeline


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    root: dict = {}
    for a, b in edges:
        a0, b0 = root.setdefault(a, a), root.setdefault(b, b)
        for k in [k for k, v in root.items() if v == max(a0, b0)]:
            root[k] = min(a0, b0)
    lone = set(root) - set(got)
    assert all(root[k] == k for k in lone)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(got) == groups({k: v for k, v in root.items() if k not in lone})
    assert all(v == min(k for k in got if got[k] == v) for v in set(got.values()))
    assert components.components(spark.createDataFrame([], "a long, b long")) is None


def test_pipeline_against_brute_force(spark, data):
    sf = f"{data}/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    judged = {r.doc_id: r.kept for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    docs = [d for d in docs if judged[d["doc_id"]]]
    keys = [[lines.line_key(x) for x in d["text"].encode().split(b"\n")] for d in docs]
    often = Counter(k for ks in keys for k in set(ks) if k)
    for d, ks in zip(docs, keys):
        d["text"] = "\n".join(x for x, k in zip(d["text"].split("\n"), ks) if often[k] < 10 or not k)
    distinct = {shingles.text_key(h): h for h in shingles.text_words([d["text"] for d in docs])}
    n, common = len(docs), Counter(s for h in distinct.values() for s in set(shingles.shingle_hashes(h).tolist()))
    w = shingles.Weights(n, {k: c for k, c in common.items() if c > shingles.COMMON_SHARE * n})
    bags = [w.of(h) for h in shingles.text_words([d["text"] for d in docs])]
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if len(np.intersect1d(bags[i][0], bags[j][0])) and shingles.weighted_jaccard(bags[i], bags[j]) >= neardups.SIMILARITY:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    docs = [d for i, d in enumerate(docs) if root[i] == i]
    index = leaks.Index([(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], leaks.Q, leaks.EDIT_SHARE)
    docs = [d for d, found in zip(docs, index.search([d["text"] for d in docs])) if not found]
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {d["doc_id"]: d["text"] for d in docs}


def test_stages_keep_columns(spark, data):
    sf = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    odd = docs.limit(3).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[2:])).select(docs.columns))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() >= 1, name


def test_entry_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "ordinata"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith("py") else None
    (tmp_path / "ordinata").mkdir()
    for p in (ROOT / "ordinata").iterdir():
        if p.name != "llm":
            (tmp_path / "ordinata" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'counts' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONDONTWRITEBYTECODE": "1"})
