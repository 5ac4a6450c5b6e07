"""Golden values for a ten-element sequence, and random sequences against plain Python lists."""

import random
from collections import Counter

import pytest

from ordinata.functions.bits import fields, subcode_separator
from ordinata.operators import indexed as I
from ordinata.operators import sequences as Q
from ordinata.sources.sequence import Sequence, with_positions

# A sequence and the answers to requests about it that any such engine gives.
SEQ10 = [0, 1, 3, 7, 1, 5, 4, 2, 6, 3]


def pairs(df):
    return {r.sym: r.cnt for r in df.collect()}


def one(df):
    return df.first()[0]


@pytest.fixture(scope="module", params=[7, 107])
def seq(spark, request):
    return Sequence.from_values(spark, SEQ10, request.param).cached()


def test_counting(seq):
    assert [one(Q.rank(seq, 3)), one(Q.rank(seq, 3, 0, 9)), one(Q.rank(seq, 3, 3, 9)), one(Q.rank(seq, 5, 3, 9))] == [2, 1, 0, 1]
    assert [one(Q.rank(seq, s, ignore_bits=b)) for s, b in ((0, 3), (0, 2), (4, 2))] == [10, 6, 4]
    assert [one(Q.count_less_than(seq, 5, 3, 9)), one(Q.count_less_than(seq, 8)), one(Q.count_less_than(seq, 7))] == [3, 10, 9]
    assert [one(Q.count(seq, 1, 7)), one(Q.count(seq, 7, 7))] == [8, 0]
    assert pairs(Q.rank_batch(seq, [1, 2, 3])) == {1: 2, 2: 1, 3: 2}
    assert pairs(Q.rank_batch(seq, [1, 2, 3], 5, 10)) == {1: 0, 2: 1, 3: 1}
    assert pairs(Q.rank_batch(seq, [0], ignore_bits=3)) == {0: 10}
    assert pairs(Q.rank_batch(seq, [0], ignore_bits=2)) == {0: 6}
    assert pairs(Q.rank_batch(seq, [1, 1, 1, 2, 3])) == {1: 2, 2: 1, 3: 2}
    assert one(Q.rank(seq, 2**32 - 1)) == 0


def test_counts(seq):
    assert pairs(Q.counts(seq, 5, 10, 1, 3)) == {2: 1, 3: 1}
    assert pairs(Q.counts(seq, 5, 10, 0, 3, ignore_bits=1)) == {2: 2}
    with pytest.raises(ValueError):
        Q.counts(seq, 5, 10, 1, 3, ignore_bits=1, aligned=True)
    for upper in (7, 8, 100):
        assert pairs(Q.counts(seq, upper=upper)) == {0: 1, 1: 2, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, 7: 1}
    assert [r.sym for r in Q.counts(seq, sort=True).collect()] == list(range(8))
    with pytest.raises(ValueError):
        Q.counts(seq, lower=5, upper=4)


def test_subcodes(spark):
    seq = Sequence.from_values(spark, list(range(8)), 7)
    assert pairs(Q.counts(seq, 1, 8, 0b010, 0b111, separator=0b111)) == {2: 1, 3: 1, 6: 1, 7: 1}
    assert [subcode_separator(x) for x in ([2, 1, 2], [3, 1, 3], [3, 1, 4])] == [0b10110, 0b1001100, 0b10001100]
    with pytest.raises(ValueError):
        subcode_separator([2, 0, 2])
    assert fields(0b10110, 5) == [(0, 2), (2, 1), (3, 2)] and fields(0b10, 4) == [(0, 2), (2, 2)]


def test_order(seq):
    assert [tuple(Q.quantile(seq, k).first()) for k in (0, 1, 9)] == [(0, 1), (1, 2), (7, 1)]
    assert tuple(Q.quantile(seq, 0, 1, 10).first()) == (1, 2)
    assert {(r.sym, r.cnt, r.num_offsets) for r in Q.quantile_batch(seq, [0, 1, 2, 9]).collect()} == {(0, 1, 1), (1, 2, 2), (7, 1, 1)}
    assert pairs(Q.quantiles(seq, 0, 2)) == {0: 1, 1: 2} and pairs(Q.quantiles(seq, 0, 0)) == {}
    with pytest.raises(IndexError):
        Q.quantile(seq, 10)


def test_access(seq):
    assert [one(Q.access(seq, i)) for i in range(10)] == SEQ10
    for i in (-1, 10):
        with pytest.raises(IndexError):
            Q.access(seq, i)
    got = sorted((r.ord, r.idx, r.sym) for r in Q.access_batch(seq, [9, 0, 9]).collect())
    assert got == [(0, 9, 3), (1, 0, 0), (2, 9, 3)]


def test_select(spark):
    seq = Sequence.from_values(spark, SEQ10, 10).cached()
    asked = [(0, -1), (0, 0), (0, 1), (1, 1), (1, 0), (3, 1), (3, 2), (3, 3), (0, 2), (10, 1)]
    assert [one(Q.select(seq, s, n)) for s, n in asked] == [-1, -1, 0, 1, -1, 2, 9, -1, -1, -1]
    assert [one(Q.select(seq, 3, 1, 3, 10)), one(Q.select(seq, 0, 1, 1, 10))] == [9, -1]
    assert pairs(Q.simple_majority(seq)) == {} and pairs(Q.simple_majority(seq, 0, 1)) == {0: 1}


def test_majority(spark):
    seq = Sequence.from_values(spark, [1, 1, 2, 1, 2, 2, 2], 10).cached()
    assert pairs(Q.simple_majority(seq)) == {2: 4} and pairs(Q.simple_majority(seq, 0, 4)) == {1: 3}
    assert [pairs(Q.majority(seq, k, 0, 4)) for k in (2, 1, 5)] == [{1: 3}, {}, {1: 3, 2: 1}]
    assert pairs(Q.majority(seq, 4, 0, 3)) == {1: 2, 2: 1} and pairs(Q.majority(seq, 2)) == {2: 4}
    assert pairs(Q.simple_majority(seq, 2, 7)) == {2: 4}
    with pytest.raises(ValueError):
        Q.majority(seq, 0)


def test_empty_and_single_symbol(spark):
    none = Sequence.from_df(spark.createDataFrame([], "p long, v long"), "p", "v")
    assert none.length == 0 and Q.counts(none).count() == 0 and one(Q.rank(none, 0)) == 0 and one(Q.select(none, 0, 1)) == -1
    zeros = Sequence.from_values(spark, [0, 0, 0])
    assert pairs(Q.counts(zeros)) == {0: 3} and tuple(Q.quantile(zeros, 2).first()) == (0, 3)


@pytest.mark.parametrize("rows", [[(0, None)], [(None, 1)], [(0, 1), (0, 2)], [(0, 1), (2, 2)], [(0, -1)], [(0, 2**32)], [(0, 1), (0, 1), (3, 1), (3, 1)], [(0, 1), (2**62, 1)], [(2**62, 1), (2**62, 2)], [(-1, 1), (0, 1)]])
def test_bad_sequences(spark, rows):
    with pytest.raises(ValueError):
        Sequence.from_df(spark.createDataFrame(rows, "p long, v long"), "p", "v")


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    rng = random.Random(seed)
    top = [1, 9, 255, 2**32 - 1][seed]
    values = [rng.choice([rng.randint(0, top), rng.randint(0, min(top, 5)), top]) for _ in range(rng.randint(1, 60))]
    counts = [rng.choice([0, 1, 1, 2, 7]) for _ in values] if seed % 2 else None
    data = [v for v, c in zip(values, counts or [1] * len(values)) for _ in range(c)] or values[:1]
    seq = Sequence.from_values(spark, values, top, counts).cached()
    if sum(counts or [1]) == 0:
        return
    assert seq.length == len(data)
    n = len(data)
    a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
    w = data[a:b]
    h = Counter(w)
    s = rng.choice(data)
    assert pairs(Q.counts(seq, a, b)) == dict(h)
    assert one(Q.rank(seq, s, a, b)) == h[s]
    assert one(Q.count_less_than(seq, s, a, b)) == sum(x < s for x in w)
    asked = [rng.randint(0, top) for _ in range(70)] + [s]
    assert pairs(Q.rank_batch(seq, asked, a, b)) == {x: h[x] for x in asked}
    for bits in (1, 3):
        at = [i for i in range(a, b) if data[i] >> bits == s >> bits]
        for k in (1, 2, len(at), len(at) + 1):
            assert one(Q.select(seq, s, k, a, b, bits)) == (at[k - 1] if 1 <= k <= len(at) else -1)
        grouped = Counter(x >> bits << bits for x in w if s >> bits <= x >> bits)
        assert pairs(Q.counts(seq, a, b, s, top, ignore_bits=bits)) == dict(grouped)
    if w:
        k = rng.randrange(len(w))
        v = sorted(w)[k]
        assert tuple(Q.quantile(seq, k, a, b).first()) == (v, h[v])
    for k in (1, 2, 3, 5):
        assert pairs(Q.majority(seq, k, a, b)) == {x: c for x, c in h.items() if c > len(w) // k}
    got = pairs(Q.most_frequent(seq, 2, a, b))
    assert len(got) >= min(2, len(h)) and all(h[x] == c for x, c in got.items())
    assert list(pairs(Q.top_k(seq, 3, a, b)).items()) == sorted(h.items(), key=lambda x: (-x[1], x[0]))[:3]
    ranges = [(a, b), (0, b), (a, a)]
    total = {x: [Counter(data[p:q])[x] for p, q in ranges] for x in set(data)}
    for f, ok in ((Q.union, any), (Q.intersect, all)):
        assert {r.sym: [r.c0, r.c1, r.c2] for r in f(seq, ranges).collect()} == {x: c for x, c in total.items() if ok(c)}
    assert {r.sym for r in Q.difference(seq, [(a, b), (0, a)]).collect()} == set(w) - set(data[:a])
    for i in {0, n - 1, rng.randrange(n)}:
        assert one(Q.access(seq, i)) == data[i]
    assert {(r.ord, r.sym) for r in Q.access_batch(seq, [n - 1, 0]).collect()} == {(0, data[-1]), (1, data[0])}
    many = spark.createDataFrame([(0, a, b, 0), (1, 0, n, n // 2), (2, a, a, 0)], "rid long, first long, last long, off long")
    got = {(r.rid, r.sym): r.cnt for r in Q.counts_batch(seq, many, 3).collect()}
    assert got == {(k, x): c for k, (p, q) in enumerate([(a, b), (0, n), (a, a)]) for x, c in Counter(data[p:q]).items()}
    got = {r.rid: r.sym for r in Q.quantile_ranges(seq, many, 3).collect()}
    assert got == {k: sorted(data[p:q])[o] for k, (p, q, o) in enumerate([(a, b, 0), (0, n, n // 2), (a, a, 0)]) if o < q - p}


def test_long_sequences():
    """Sums of positions beyond 2**63 must not come up: only counts of bitmaps are added."""
    import inspect

    assert "F.sum(\"start\")" not in inspect.getsource(Sequence.from_df)


def test_literal_requests_reach_the_scan(spark, tmp_path):
    spark.range(50_000).selectExpr("id as p", "id % 97 as v").write.parquet(f"{tmp_path}/s")
    seq = Sequence.from_df(spark.read.parquet(f"{tmp_path}/s"), "p", "v")
    for df, column in ((Q.access_batch(seq, [5, 7, 5]), "p"), (Q.rank_batch(seq, [3, 4]), "v")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"In({column}," in plan and "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning" not in Q.access_batch(seq, [5, 7, 5])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 16, 17, 700])
def test_index(spark, tmp_path, n):
    rng = random.Random(n)
    data = [rng.choice([3, 3, 9, rng.randrange(40)]) for _ in range(n)]
    seq = Sequence.from_df(spark.createDataFrame(list(enumerate(data)), "p long, v long"), "p", "v")
    asked = [(k, *sorted((rng.randint(0, n), rng.randint(0, n))), rng.randrange(5), 3) for k in range(12)] + [(99, 0, n, 0, 9), (100, 0, 0, 0, 3)]
    table = spark.createDataFrame(asked, "rid long, first long, last long, off long, sym long")
    for index in (I.build(seq), I.build(seq, f"{tmp_path}/index")):
        assert {(r.rid, r.sym): r.cnt for r in I.counts(index, table).collect()} == {(k, x): c for k, a, b, _, _ in asked for x, c in Counter(data[a:b]).items()}
        assert {r.rid: r.cnt for r in I.ranks(index, table).collect()} == {k: data[a:b].count(x) for k, a, b, _, x in asked}
        assert {r.rid: (r.sym, r.cnt) for r in I.quantiles(index, table).collect()} == {k: (v := sorted(data[a:b])[o], data[a:b].count(v)) for k, a, b, o, _ in asked if o < b - a}


def test_positions(spark):
    keys = random.Random(1).sample(range(10**9), 50)
    got = {r.k: r.pos for r in with_positions(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
