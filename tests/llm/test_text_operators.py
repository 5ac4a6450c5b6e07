"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator on texts,
and brute-force versions of what SQL can't express."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinata.llm import bpe, leaks, lines, mil, neardups, passages, quality, secrets, shingles
from ordinata.llm.queries import QUERIES, automaton
from ordinata.llm.trigrams import trigram_query

SCHEMA = "doc_id long, text string, lang string, id string, row int, node long, c0 string, n_lines int, part int, a long"
rng = random.Random(7)
PROSE = [" ".join(rng.choice(["river", "stone", "over", "quiet", "light", "from", "seven", "would", "grow", "paper"]) + rng.choice(["", "s", "ed"]) for _ in range(120)) for _ in range(6)]


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "c", 3, 4, 5) for i, t in zip(ids, texts)], SCHEMA)


EDGE = [None, "", " \n\t ", "one", PROSE[0], PROSE[0], "x" * 300_000, "word " * 60_000, "\x85\xa0\x1c é ", "🙂 a🙂b"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Quality rules


def test_quality_counts():
    def brute(t):
        t, w = t or "", words(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        ls = t.split("\n")
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(bool(words(x)) and x in ls[:i] for i, x in enumerate(ls)), len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)})

    some = [x for x in EDGE if x is None or len(x) < 10_000] + ["a b c a b c a", "a a a a", "x\n\nx\n y\n y", "## $ |<>&%*", " a b \n a b \n"]
    for t in some:
        assert quality.counts_of(t)[:5] == brute(t), t


def test_quality_bounds():
    from math import comb

    for k, n, p in ((0, 50, 0.1), (3, 40, 0.2), (17, 300, 0.05), (300, 300, 0.5)):
        assert quality.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_quality_rules(spark):
    good = [PROSE[k % 6] + f" w{k}" for k in range(3000)]
    long = ["word " * 60_000 + " ".join(f"u{i}" for i in range(60_000)), "x" * 10**6]
    bad = [" ".join(w + "***" for w in PROSE[k % 6].split()) for k in range(300)]
    rows = [(k, t, "en" if k % 3 else None) for k, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame(rows + [(None, good[0], "en"), (9000, None, "en"), (9001, "", "xx"), (9002, long[0], "en"), (9003, long[1], "en")], "doc_id long, text string, lang string").withColumn("s", F.lit(1)).withColumn("stratum", F.lit(2))
    labels = spark.createDataFrame([(k, int(k < 3000)) for k in range(3300)] + [(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(out[k].kept for k in range(3000)) and not any(out[k].kept for k in range(3000, 3300))
    assert not out[9002].base_failed and out[9002].n_repeat_words == 60_000 and out[9003].base_failed and out[9003].word_chars == 10**6
    assert out[None].kept and out[9000].base_failed and out[9001].base_failed and not out[9000].kept
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 3002
    none = quality.judge(docs, labels.limit(0))
    assert none.filter("kept").count() == 3302  # only the base rules are left
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_certify_holds_alpha():
    row = {f"{s}_{r}_{k}": 0 for s in "gb" for r in quality.RULES for k in range(len(quality.GRID))}
    first, second = quality.RULES[:2]
    row |= {f"b_{first}_3": 50, f"b_{first}_2": 60, f"g_{first}_1": 30, f"b_{first}_1": 900, f"b_{second}_4": 55, f"g_{second}_0": 5, f"b_{second}_0": 50}
    path = quality.steps(row)
    assert path == [(first, quality.GRID[2]), (second, quality.GRID[4]), (first, quality.GRID[3]), (first, quality.GRID[1])]  # 50 bad don't outweigh 5 good
    assert quality.certified(path, {0: 10, 1: 10, 3: 200}, 1000, 0.01) == path[:3]
    assert quality.certified(path, {0: 10, 1: 10}, 1000, 0.01) == path
    assert quality.certified(path, {0: 49}, 1000, 0.01) == []  # no later step is tested
    assert quality.certified(path, {}, 85, 0.05 / 4) == [] and quality.certified(path, {}, 86, 0.05 / 4) == path  # enough to be sure


def test_bounds_of_large_samples():
    """Never below the exact value, with many terms beyond the first five thousand."""
    from fractions import Fraction
    from math import comb

    for k, n, p in ((40, 2000, Fraction(1, 20)), (7000, 100_000, Fraction(7, 100)), (30_000, 100_000, Fraction(1, 3))):
        if n < 10_000:
            exact = float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
            assert quality.binomial_cdf(k, n, float(p)) == pytest.approx(exact, rel=1e-9)
        else:  # the normal law, far from its ends
            z = (k + 0.5 - n * float(p)) / (n * float(p * (1 - p))) ** 0.5
            from math import erf

            assert quality.binomial_cdf(k, n, float(p)) == pytest.approx((1 + erf(z / 2**0.5)) / 2, rel=0.02, abs=1e-9)


# Passages


def test_windows():
    def tree(v, t):
        out = []

        def go(lo, hi):
            if hi - lo + 1 >= t:
                c = min(range(lo, hi + 1), key=lambda i: (v[i], i))
                out.append((lo, c, hi))
                go(lo, c - 1)
                go(c + 1, hi)

        start = 0
        for i in range(len(v) + 1):
            if i == len(v) or v[i] == 0:
                go(start, i - 1)
                start = i + 1
        return sorted(out)

    for _ in range(300):
        v = np.array([rng.choice([0, rng.randint(1, 6), rng.randint(1, 99), rng.randint(1, 999)]) for _ in range(rng.randint(0, 50))], np.uint32)
        t = rng.randint(1, 8)
        assert sorted(zip(*(x.tolist() for x in passages.windows(v, t)))) == tree(v.tolist(), t)


def fresh(n, tag):
    return " ".join(f"{tag}{i}{rng.randint(0, 10**6)}" for i in range(n))


def test_repeated_passages(spark):
    shared, near = fresh(70, "p"), fresh(90, "q").split()
    near2 = near[:45] + ["changed"] + near[46:]
    texts = [f"{fresh(200, 'a')} {shared} {fresh(30, 'b')}", f"{shared.upper()}\n{fresh(500, 'c')}", f"{fresh(60, 'd')} {' '.join(near)}", f"{' '.join(near2)} {fresh(80, 'e')}", fresh(300, "f"), fresh(40, "g"), fresh(40, "g")]
    texts += [texts[4], texts[4], None, "", " ".join(shared.split()[:45])]
    out = passages.repeated_passages(docs_of(spark, texts).unionByName(docs_of(spark, [shared], [None])))
    got = defaultdict(set)
    for r in out.collect():
        got[r.class_id] |= {r.doc_id, r.other_id}
        if (r.doc_id, r.other_id) == (1, 0):
            assert (r.start, r.end, r.other_start, r.other_end, r.similarity) == (0, 70, 200, 270, 1.0)
    assert dict(got) == {0: {0, 1}, 2: {2, 3}, 4: {4, 7, 8}}
    assert passages.repeated_passages(docs_of(spark, EDGE[:5])).count() == 0
    assert passages.repeated_passages(docs_of(spark, []).limit(0)).count() == 0


def test_many_copies_make_few_pairs(spark):
    shared = fresh(80, "s")
    n = 400
    out = passages.repeated_passages(docs_of(spark, [f"{fresh(20, 'x')} {shared} {fresh(20, 'y')}" for _ in range(n)]).repartition(7))
    rows = out.collect()
    assert {r.class_id for r in rows} == {0} and {r.doc_id for r in rows} == set(range(1, n)) and len(rows) <= 4 * n  # of 79,800; near the passage's ends, windows of some copies only form chains of their own


def test_passage_whose_part_comes_before():
    passage = fresh(70, "p").split()
    a = passage[:45] + fresh(400, "a").split() + passage + fresh(50, "b").split() + passage[20:50]
    b = fresh(90, "c").split() + passage + fresh(90, "d").split()
    of = lambda t: shingles.shingle_hashes(next(shingles.text_words([" ".join(t)])))
    how = dict(min_words=50, size=5, similarity=0.8)
    assert passages.shared_passages(of(a), of(b), **how) == [(445, 515, 90, 160, 1.0)]
    assert passages.shared_passages(of(b), of(a), **how) == [(90, 160, 445, 515, 1.0)]
    assert passages.shared_passages(of(["x"] * 5000), of(["x"] * 5000 + b), **how)
    assert passages.shared_passages(of(passage[:45] * 3), of(fresh(90, "e").split() + passage[:45]), **how) == []


def _phrases(rnd):
    """12 pairs of documents with a passage of 75 words each; each of its phrases of 15 and 25 words is also in 40 other documents."""
    new = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts, pairs = [], []
    for _ in range(12):
        passage = new(75)
        pairs.append((len(texts), len(texts) + 1))
        texts += [new(60) + passage + new(60), new(30) + passage + new(90)]
        for lo, hi in ((0, 15), (15, 40), (40, 55), (50, 75)):
            texts += [new(50) + passage[lo:hi] + new(50) for _ in range(40)]
    return texts, pairs


def test_phrases_of_many_part_no_pair(spark):
    texts, pairs = _phrases(random.Random(5))
    for parts in (1, 4):
        out = passages.repeated_passages(docs_of(spark, [" ".join(t) for t in texts]).repartition(parts)).collect()
        assert {(r.other_id, r.doc_id) for r in out} == set(pairs)


def test_large_groups_lose_no_pair(spark):
    """Passages of 50 words in two documents each, whose halves and quarters many others hold in longer parts of 40 words."""
    r = random.Random(21)
    new = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    texts, pairs = [], []
    for k in range(10):
        passage = new(50)
        other = passage[:25] + ["changed"] * (k % 2) + passage[25 + k % 2 :]
        around = [[new(30) + passage[lo : lo + 40] + new(30) for lo in (0, 10, 5)] for _ in range(12)]
        block = [t for three in around for t in three]
        pairs.append((len(texts) + 9, len(texts) + 27))
        block[9:9], block[27:27] = [new(20) + passage + new(60)], [new(70) + other + new(10)]
        texts += block
    for parts in (1, 5):
        out = passages.repeated_passages(docs_of(spark, [" ".join(t) for t in texts]).repartition(parts)).collect()
        assert {(x.other_id, x.doc_id) for x in out} == set(pairs)


def test_compare():
    """All pairs of a group against one by one, with classes, clashes of sides and repeated shingles."""
    r = random.Random(4)
    how = dict(min_words=12, size=3, similarity=0.8)
    for _ in range(30):
        base = [np.array([r.randrange(1, 60 if r.random() < 0.3 else 2**32) for _ in range(16)], np.uint32) for _ in range(4)]
        places = []
        for _ in range(14):
            p = r.choice(base).copy()
            for _ in range(r.randint(0, 3)):
                p[r.randrange(16)] = r.randrange(1, 2**32)
            places.append(np.concatenate([p, np.zeros(1, np.uint32)]))
        need = np.array([min(len(set(p[i : i + 10].tolist())) for i in range(7)) for p in places])
        doc, cls, side = np.arange(14) // 2, np.array([r.randrange(7) for _ in range(14)]), np.zeros(14, int)
        joined = np.array([r.random() < 0.3 for _ in range(14)])
        got = passages.compare(side, doc, cls, joined, need, places, **how)
        like = {(i, j) for i in range(14) for j in range(i) if doc[i] != doc[j] and passages.shared_passages(places[j][:16].astype(np.uint64), places[i][:16].astype(np.uint64), **how)}
        known = {(i, j) for i in range(14) for j in range(i) if joined[i] and joined[j] and cls[i] == cls[j]}
        assert set(got) <= {tuple(sorted((int(doc[i]), int(doc[j])))) for i, j in like}

        def parts(edges):
            up = list(range(7))
            for i, j in edges:
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
            return up

        of = lambda pairs: [(int(doc[i]), int(doc[j])) for i, j in pairs]
        assert parts(got + of(known)) == parts(of(like) + of(known))


def test_passages_across_bands():
    """An insertion moves the second half of a passage to the next band of diagonals, and its shingles occur before."""
    p = np.arange(1, 61)
    before = np.arange(1000, 1000 + 60 * 31).reshape(60, 31)
    before[:, 0] = np.random.default_rng(1).permutation(p)
    a = np.concatenate([before.ravel(), p]).astype(np.uint64)
    b = np.concatenate([np.arange(100, 134), p[:30], np.arange(200, 204), p[30:]]).astype(np.uint64)
    assert [q[:4] for q in passages.shared_passages(a, b, min_words=46, size=1, similarity=0.8)] == [(1860, 1920, 34, 98)]


def test_compare_turns_away(monkeypatch):
    """Windows of which only one has enough of what both share aren't compared."""
    calls, real = [], passages.shared_passages
    monkeypatch.setattr(passages, "shared_passages", lambda *a, **k: calls.append(1) or real(*a, **k))
    few, end = np.arange(1, 8), np.zeros(1)
    rows = [np.concatenate([few, few, end]), np.concatenate([few, np.arange(20, 29), end])]
    zero = np.zeros(2, int)
    assert not passages.compare(zero, np.arange(2), zero, zero > 0, np.array([7, 10]), [x.astype(np.uint32) for x in rows], min_words=12, size=3, similarity=0.8)
    assert not calls


def test_passages_against_all_pairs(spark):
    """Passages of 55 to 120 words, some edited, among phrases that many documents hold: recall of the links, and no false ones."""
    r = random.Random(11)
    new = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]
    phrases = [new(r.randint(10, 30)) for _ in range(4)]
    common = [new(r.randint(55, 120)) for _ in range(30)]
    texts = []
    for k in range(260):
        t = new(r.randint(0, 80))
        for _ in range(r.randint(0, 2)):
            p = list(r.choice(common))
            if r.random() < 0.5:
                p[r.randrange(len(p))] = "changed"
            t += p + new(r.randint(0, 40))
        if r.random() < 0.6:
            t[r.randint(0, len(t)) : 0] = r.choice(phrases)
        texts.append(" ".join(t))
    how = dict(min_words=passages.MIN_WORDS, size=shingles.WORDS, similarity=passages.SIMILARITY)
    of = [shingles.shingle_hashes(h) for h in shingles.text_words(texts)]
    want = {(i, j) for j in range(len(of)) for i in range(j) if len(of[i]) and len(of[j]) and passages.shared_passages(of[i], of[j], **how)}
    out = passages.repeated_passages(docs_of(spark, texts).repartition(3)).collect()
    found = {(x.other_id, x.doc_id) for x in out}
    classes = {d: x.class_id for x in out for d in (x.doc_id, x.other_id)}
    assert found <= want and len(want) > 500
    assert sum(classes.get(i, -1) == classes.get(j, -2) for i, j in want) >= 0.99 * len(want)


def test_recall_of_functions():
    """Passages of 50 words with one changed (41 of 51 shingles in common) must agree in enough functions."""
    r = np.random.default_rng(7)
    a, b = passages.functions()
    x = r.integers(0, 2**63, (10_000, 46), dtype=np.uint64)
    y = x.copy()
    y[:, 20:25] = r.integers(0, 2**63, (10_000, 5), dtype=np.uint64)
    agree = sum((((x ^ b[k]) * a[k] >> np.uint64(32)).min(axis=1) == ((y ^ b[k]) * a[k] >> np.uint64(32)).min(axis=1)).astype(int) for k in range(len(a)))
    assert (agree < passages.NEEDED).mean() < 0.004


# Near-duplicates


def edited(text, share, r):
    return " ".join(w + "zz" if r.random() < share else w for w in text.split())


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(3)
    base = [fresh(r.randint(60, 300), f"n{k}") for k in range(25)]
    texts = base + [edited(b, s, r) for b in base for s in (0.005, 0.01, 0.03, 0.1)] + base[:5] + [None, "", "one", "one", "two words", fresh(9, "z")]
    docs = docs_of(spark, texts).repartition(3)
    got = {x.doc_id: x.class_id for x in neardups.near_duplicates(docs).collect()}
    w = shingles.Weights(*shingles.common_shingles(docs, "text"))
    bags = [w.of(h) for h in shingles.text_words(texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(bags[i][0]) and shingles.weighted_jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert got == {i: min(k for k, x in enumerate(root) if x == root[i]) for i in range(len(texts))}


def test_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = fresh(200, "h")
    texts = [base] * 100 + [edited(base, 0.01, r) for _ in range(200)] + [fresh(200, "o") for _ in range(600)]
    out = neardups.near_duplicates(docs_of(spark, texts).repartition(5)).collect()
    got = {x.doc_id: x.class_id for x in out}
    edits = [sum(x.endswith("zz") for x in t.split()) for t in texts[:300]]
    assert all(got[i] == 0 for i in range(300) if edits[i] <= 3)  # four edits of 200 words come near 0.8
    assert all(got[i] == i for i in range(300, 900))


def test_hot_buckets_against_all_pairs(spark):
    """A template that many otherwise different texts share, with true pairs among them: every pair of a bucket counts."""
    template, texts = fresh(80, "t"), []
    for k in range(300):
        own = fresh(14, f"h{k}_").split()
        texts.append(f"{template} {' '.join(own)}")
        if k % 2 == 0:  # 85 of 95 shingles in common; 76 are the template's
            own[5] = "changed"
            texts.append(f"{template} {' '.join(own)}")
    texts += [fresh(20, f"o{k}_") for k in range(4 * len(texts))]
    docs = docs_of(spark, texts)
    got = {x.doc_id: x.class_id for x in neardups.near_duplicates(docs).collect()}
    w = shingles.Weights(*shingles.common_shingles(docs, "text"))
    bags = [w.of(h) for h in shingles.text_words(texts)]
    sample = neardups.Sampler(neardups.BANDS * neardups.ROWS)
    buckets = defaultdict(list)
    for i, b in enumerate(bags):
        for key in neardups.band_keys(sample(*b), neardups.BANDS, neardups.ROWS).tolist():
            buckets[key].append(i)
    assert max(map(len, buckets.values())) > 100
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(x, y) for m in buckets.values() for k, x in enumerate(m) for y in m[k + 1 :]}:
        if shingles.weighted_jaccard(bags[a], bags[b]) >= neardups.SIMILARITY:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in range(len(texts))}
    assert sum(got[i] != i for i in got) > 100


def test_keep_one(spark):
    docs = docs_of(spark, [PROSE[0], PROSE[0], PROSE[1], PROSE[1], None, ""], [3, 4, 5, 5, 6, 7]).unionByName(docs_of(spark, [PROSE[0]], [None]))
    kept = neardups.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 5, 6, 7]
    assert neardups.keep_one(docs.limit(0)).count() == 0


def test_common_shingles_are_exact(spark, monkeypatch):
    """Texts of equal words count once, in whichever tasks; summaries are merged as a tree."""
    line = "a licence line that many documents have in common"
    texts = [f"{fresh(30, 'k')} {line}" if k % 4 == 0 else fresh(40, "k") for k in range(400)]
    docs = docs_of(spark, texts + [texts[0].upper()] * 50 + [fresh(30, "c")] * 50).repartition(21)
    for fan_in in (shingles.FAN_IN, 2):
        monkeypatch.setattr(shingles, "FAN_IN", fan_in)
        n, common = shingles.common_shingles(docs, "text")
        assert n == 500 and len(common) == len(line.split()) - 4 and set(common.values()) == {100}


def test_idf_changes_a_verdict(spark):
    """Two texts that share a licence of 60 words and little else are near-duplicates where it is rare, and aren't where it is common."""
    licence = fresh(60, "licence")
    pair = [f"{licence} {fresh(7, 'x')}", f"{licence} {fresh(7, 'y')}"]
    for others, same in ((300, True), (0, False)):
        texts = pair + [fresh(60, "o") for _ in range(300)] + [f"{licence} {fresh(300, 'z')}" for _ in range(300 - others)]
        got = {x.doc_id: x.class_id for x in neardups.near_duplicates(docs_of(spark, texts)).collect()}
        assert (got[0] == got[1]) is same and len(set(got.values())) == len(texts) - same


def test_near_copies_without_ids(spark):
    a, b = fresh(100, "a"), fresh(100, "b")
    texts = [a + " one", a, a + " two", b, b + " more", "", None, "", a + " one", "x" * 300_000, "word " * 60_000, "word " * 60_001]
    docs = docs_of(spark, texts, [None, 5, None, None, None, None, None, 7, 5, 8, 9, 10])
    got = neardups.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in got) == sorted([(0, 5), (5, 5), (0, 5), (0, 0), (0, 0), (0, 0), (0, 0), (7, 7), (5, 5), (8, 8), (9, 9), (10, 9)])
    kept = neardups.keep_one(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 0, 5, 7, 8, 9]
    assert sum(r.text in (b, b + " more") for r in kept) == 1 and sum(not r.text for r in kept) == 3
    two = neardups.keep_one(docs_of(spark, [a, b, a + " one"], [5, 5, 6]))  # an id of two texts
    assert sorted((r.doc_id, r.text) for r in two.collect()) == [(5, a), (5, b)]


def test_sampling_agrees_like_similarity():
    r = np.random.default_rng(1)
    sample = neardups.Sampler(4000)
    keys = r.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = (keys[:50], r.uniform(0.3, 3, 50)), (keys[10:], r.uniform(0.3, 3, 50))
    a, b = ((k[np.argsort(k)], w[np.argsort(k)]) for k, w in (a, b))
    assert (sample(*a) == sample(*b)).mean() == pytest.approx(shingles.weighted_jaccard(a, b), abs=0.03)


# Leaks


def test_leaks_against_full_alignment(spark):
    r = random.Random(5)
    items = [(k, fresh(r.randint(12, 40), "i")) for k in range(6)] + [(6, None), (7, "short"), (None, fresh(20, "n"))]

    def distance(x, y):
        row = [0] * (len(y) + 1)
        for i, c in enumerate(x):
            new = [i + 1]
            for j, d in enumerate(y):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    texts = []
    for k, t in items[:6]:
        for edits in (0, 3, len(t) // 20, len(t) // 8):
            s = list(t)
            for _ in range(edits):
                p = r.randrange(len(s))
                s[p : p + 1] = r.choice([[], ["#"], [s[p], "#"]])
            texts.append(f"{fresh(r.randint(0, 40), 'u')}\n {''.join(s).upper()}\t{fresh(r.randint(0, 9), 'v')}")
    texts += [None, "", items[0][1][:60]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, k) for d, x in enumerate(texts) for k, t in items[:6] if x and distance("".join(map(chr, leaks.normal(t)[0])), "".join(map(chr, leaks.normal(x)[0]))) <= leaks.budget(len(t), leaks.Q, leaks.EDIT_SHARE)[0]}
    docs = docs_of(spark, texts)
    for chars in (leaks.GROUP_CHARS, 300):
        found = leaks.find_leaks(docs, bench, keep=["doc_id"], group_chars=chars).select("row.c0", F.explode("leaks").alias("x")).collect()
        assert {(f.c0, int(f.x.item)) for f in found} == want
    kept = leaks.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert leaks.drop_leaking(docs, bench.limit(0)).count() == len(texts)
    assert leaks.drop_leaking(docs.limit(0), bench).count() == 0


def test_leaks_do_not_depend_on_pieces(monkeypatch):
    """Items with runs of blanks, wherever a long text is cut; repeated q-grams, wherever counting is."""
    r = random.Random(3)
    items = [("a", fresh(30, "i")), ("b", fresh(12, "j")), ("c", "-" * 300), ("d", "=-" * 20)]
    gap = fresh(25, "g").split()
    items.append(("e", " ".join(gap)))
    texts = []
    for lead in (900, 990, 1000, 1010, 1990, 2003):
        texts.append("y" * (lead % 7) + " z" * (lead // 2) + " " + (" " * 5000).join([" ".join(gap[:12]), " ".join(gap[12:])]) + " end " * 300 + items[0][1].upper() + " q" * 700)
    texts += ["-" * 5000 + "x" + "=-" * 900 + items[1][1] + "-" * 299, "\u03a3\u03c2 " * 900 + items[1][1]]
    whole = leaks.Index(items, leaks.Q, leaks.EDIT_SHARE).search(texts)
    assert all({i for i, *_ in x} >= {"a", "e"} for x in whole[:6]) and {i for i, *_ in whole[6]} == {"b", "c", "d"}
    for piece, pairs in ((1000, leaks.PAIRS), (leaks.PIECE, 5000), (1717, 777)):
        monkeypatch.setattr(leaks, "PIECE", piece)
        monkeypatch.setattr(leaks, "PAIRS", pairs)
        again = leaks.Index(items, leaks.Q, leaks.EDIT_SHARE).search(texts)
        assert [{i for i, *_ in x} for x in again] == [{i for i, *_ in x} for x in whole]
        assert [[y for y in x if y[0] in "abe"] for x in again] == [[y for y in x if y[0] in "abe"] for x in whole]


def test_leaks_of_repeated_characters_take_little_memory():
    import tracemalloc

    index = leaks.Index([("rule", "-" * 300), ("other", "=" * 250 + fresh(20, "k"))], leaks.Q, leaks.EDIT_SHARE)
    tracemalloc.start()
    (found,) = index.search(["-" * 200_000 + "\n" + "=" * 9000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {i for i, *_ in found} == {"rule"} and len(found) >= 600 and peak < 400e6


# Tokens


def test_bpe_against_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(6)
    texts = [x for x in EDGE if x is None or len(x) < 200_000] + ["<|endoftext|>a <|endoftext|>", "a" * 5000, "I'll we've 'S", "\n\n  \n x", *("".join(r.choice("thein ra\n1é漢🙂'<|>-_A ") for _ in range(80)) for _ in range(300))]
    coded = bpe.encode_texts(docs_of(spark, texts), automaton())
    got = {x.doc_id: x for x in bpe.decode_ids(coded, automaton(), keep=("doc_id", "ids", "n_tokens")).collect()}
    for k, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded == t.decode(ids, skip_special_tokens=False) == (x or "")
    assert bpe.encode_texts(docs_of(spark, []).limit(0), automaton()).count() == 0


def test_bpe_long_words_and_full_caches(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(bpe, "MAX_CACHED", 3)
    coder, r = bpe.Coder(automaton()), random.Random(9)
    texts = ["a" * 300_000, "=" * 300_001, "ab" * 100_000, "é" * 100_000, " ".join("".join(r.choice("theinra") for _ in range(r.randint(1, 9))) for _ in range(2000))]
    for x in texts * 2:
        assert coder.encode(x) == t.encode(x, add_special_tokens=False).ids
        assert coder.decode(coder.encode(x)) == x and max(len(coder.cache), len(coder.older)) <= 3


def test_bpe_gadgets_against_merging():
    r = random.Random(8)
    for _ in range(60):
        names, merges = ["a", "b", "c"], []
        for _ in range(r.randint(1, 12)):
            x, y = r.choice(names), r.choice(names)
            if x + y not in names:
                merges.append((names.index(x), names.index(y), len(names)))
                names.append(x + y)
        arcs, target = bpe.compile_merges(len(names), [0, 1, 2], merges)
        a = bpe.Automaton(arcs.tobytes(), arcs.shape[1], [k * arcs.shape[1] for k in range(len(names))], target.tolist(), [x.encode() for x in names], {})
        coder = bpe.Coder(a)
        for _ in range(40):
            text = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
            ids = ["abc".index(ch) for ch in text]
            for u, v, w in merges:
                out = []
                for k in ids:
                    if out and out[-1] == u and k == v:
                        out[-1] = w
                        # a merged token can't be the left part again within the same merge
                        out.append(None)
                    else:
                        out.append(k)
                ids = [k for k in out if k is not None]
            assert list(coder.word(text.encode())) == ids, (text, merges)


# Lines


def test_lines(spark):
    texts = [f" Same Line\t\nown {k}\n\nsame line" for k in range(10)] + ["same line"] + [f"nine\n{k}" for k in range(9)] + [None, "", "\n\n", "É\né", "x" * 10**6]
    docs = docs_of(spark, texts)
    for how in ({}, {"group_bytes": 1, "shard_keys": 1}):
        out = {r.doc_id: r for r in lines.dedup_lines(docs, **how).collect()}
        assert [(out[k].text, out[k].n_lines, out[k].n_dropped) for k in range(10)] == [(f"own {k}\n", 4, 2) for k in range(10)]
        assert (out[10].text, out[10].n_dropped) == ("", 1) and all(out[k].text == texts[k] for k in range(11, 20))
        assert [(out[k].text, out[k].n_lines) for k in range(20, 25)] == [("", 1), ("", 1), ("\n\n", 3), ("É\né", 2), ("x" * 10**6, 1)]
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    assert [c for c in lines.dedup_lines(docs).columns if c != "n_dropped"] == [c for c in docs.columns if c != "n_lines"] + ["n_lines"]


def test_perfect_hash():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        h = r.integers(0, 2**63, (n, 2), dtype=np.uint64)
        shard = lines.Shard(lines.pack(h[:, 0], h[:, 1], np.arange(n)))
        assert shard.count_of(h[:, 0], h[:, 1]).tolist() == list(range(n))
        other = r.integers(0, 2**63, (1000, 2), dtype=np.uint64)
        assert not shard.count_of(other[:, 0], other[:, 1]).any()


# Secrets


def test_trigram_queries():
    assert trigram_query(r"[0-9a-f]{24,}") is None and trigram_query("a.b") is None
    assert trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert {frozenset(x) for x in trigram_query("(token|api_?key)=")} == {frozenset({"tok", "oke", "ken", "en="}), frozenset({"api", "pik", "ike", "key", "ey="}), frozenset({"api", "pi_", "i_k", "_ke", "key", "ey="})}
    for rule in secrets.BASE + secrets.MORE:
        assert (trigram_query(rule.pattern) is None) == (rule.kind == "hex")


def test_secrets(spark):
    texts = EDGE + ['é token = "abcdef" PassWord:12345 api_key=\'abcdefg\'', "token=token:abcdefgh", "AKIA" + "A" * 15 + " AKIA" + "A" * 16, "f" * 23 + "g" + "0" * 24, "ghp_" + "a" * 36, "secret=" + "deadbeef" * 4]

    def brute(t):
        out = []
        for rank, rule in enumerate(secrets.BASE + secrets.MORE):
            out += [(m.start(), rank, m.end()) for m in re.finditer(rule.pattern, t or "") if len(m[rule.group]) >= rule.least]
        return [(s, e) for s, _, e in sorted(out)]

    docs = docs_of(spark, texts).unionByName(docs_of(spark, texts[-6:], [None] * 6)).unionByName(docs_of(spark, texts[-1:], [15]))
    for r in secrets.scan_secrets(docs.select("doc_id", "text", "node", "id", F.lit(1).alias("kinds"))).collect():
        if r.doc_id is not None:
            assert [(s.start, s.end) for s in r.spans] == brute(texts[r.doc_id]), texts[r.doc_id][:60]
    assert secrets.scan_secrets(docs.limit(0)).count() == 0
    assert secrets.scan_secrets(docs.filter("doc_id is null")).filter(F.size("spans") > 0).count() == 5


# Classifier


def test_classifier_on_held_out_rows(spark, data):
    out = QUERIES["op9_quality_classifier"](spark, f"{data}/sf0.01")
    both = out.join(spark.read.parquet(f"{data}/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in both) / len(both) > 0.95
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0


def test_classifier_edges(spark):
    docs = docs_of(spark, EDGE + PROSE)
    labels = spark.createDataFrame([(k, 1) for k in range(4, 6)] + [(4, 0), (None, 1), (10, None)], "doc_id long, quality int")
    model = mil.learn(docs, labels)
    got = {r.doc_id: r.score for r in mil.score(docs, model).collect()}
    assert got[0] == got[1] == got[2] == 0.0 and got[5] == 1.0  # one label left, and it is good
    assert mil.score(docs, mil.learn(docs, labels.limit(0))).filter("score = 0.5").count() == len(EDGE + PROSE) - 3
    assert mil.score(docs.limit(0), model).count() == 0


def _bags(r):
    return [mil.encode(" ".join(f"w{r.randrange(50)}" for _ in range(n))) for n in (230, 40, 310, 100, 101, 7)]


def test_attention_against_plain_python():
    from math import exp, tanh

    docs = _bags(random.Random(4))
    m = mil.Model()
    m.prior = None
    p = {k: v.tolist() for k, v in m.p.items()}
    times = lambda x, a: [sum(x[i] * a[i][j] for i in range(len(x))) for j in range(len(a[0]))]
    for got, (words, counts) in zip(m.scores(docs), docs):
        hs, es = [], []
        for k, c in enumerate(counts.tolist()):
            mine = words[100 * k : 100 * k + 100].tolist()
            said = [sum(p["E"][w][j] for w in mine) / len(mine) for j in range(mil.EMBEDDING)]
            h = [tanh(x + b) for x, b in zip(times(said + [max(-8, min(8, x)) for x in c], p["W"]), p["b"])]
            gate = [tanh(v) / (1 + exp(-u)) for v, u in zip(times(h, p["V"]), times(h, p["U"]))]
            hs.append(h)
            es.append(exp(sum(g * w for g, w in zip(gate, p["w"]))))
        z = [sum(e * h[j] for e, h in zip(es, hs)) / sum(es) for j in range(mil.HIDDEN)]
        assert got == pytest.approx(1 / (1 + exp(-sum(a * b for a, b in zip(z, p["c"])) - p["d"][0])))


def test_attention_gradients():
    docs, y = _bags(random.Random(5)), np.array([1, 0, 1, 0, 1, 0])
    m = mil.Model()
    m.prior = None
    x = mil.Bags(docs)
    g = m.gradients(x, y)

    def loss():
        s = m._forward(x)[-1]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    r = np.random.default_rng(6)
    for name, at in m.p.items():
        rows = [tuple(r.integers(0, n) for n in at.shape) for _ in range(6)] if name != "E" else [(int(docs[0][0][k]), k) for k in range(6)]
        for i in rows:
            old, each = at[i], []
            for e in (1e-5, -1e-5):
                at[i] = old + e
                each.append(loss())
            at[i] = old
            assert g[name][i] == pytest.approx((each[0] - each[1]) / 2e-5, rel=1e-4, abs=1e-8), name
    m.fit(docs, y)
    assert ((m.scores(docs) > 0.5) == y).all()


def test_sample_of_whole_documents(spark):
    """A document that would pass the bound of words is left out, others stay."""
    docs = docs_of(spark, [PROSE[0], "long " * 5000, PROSE[1]])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert mil.learn(docs, labels, sample_words=1000).prior == 1.0 and mil.learn(docs, labels).prior is None


# The queries on their tables


def test_op5_digests(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()}
    out = QUERIES["op5_bpe_codec"](spark, f"{data}/sf0.001").collect()
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
