import random

import pytest
from pyspark.sql import functions as F

from ordinata.functions import bits as B
from ordinata.operators import bitsets as S
from ordinata.operators import runbits as R
from ordinata.sources.sequence import BitSet, Multiset, RunBits


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("length, ones", [(0, []), (100, []), (100, range(100)), (760, [32]), (5000, [0, 1, 2, 63, 64, 999, 4998, 4999]), (300, random.Random(3).sample(range(300), 77))])
def test_bit_sets(spark, length, ones):
    have = set(ones)
    b = BitSet.from_values(spark, [*ones, *list(ones)[:1]], length)
    for i in (-1000, -1, 0, length // 2, length - 1, length + 1, length + 1000):
        want = sum(x <= i for x in have)
        assert one(S.rank1(b, i)) == want
        assert one(S.rank0(b, i)) == max(0, min(i + 1, length)) - want
    up, down = sorted(have), sorted(set(range(length)) - have)
    for n in (-1, 0, 1, 2, len(up), len(up) + 1, len(down), len(down) + 1):
        assert one(S.select1(b, n)) == (up[n - 1] if 1 <= n <= len(up) else -1)
        assert one(S.select0(b, n)) == (down[n - 1] if 1 <= n <= len(down) else -1)
    for i in {0, length // 3, length - 1} if length else ():
        assert one(S.access(b, i)) == (i in have)
    with pytest.raises(IndexError):
        S.access(b, length)
    runs = sorted(map(tuple, S.runs(b).collect()))
    assert [x for s, e in runs for x in range(s, e)] == up and all(a[1] < c[0] for a, c in zip(runs, runs[1:]))
    as_runs = RunBits.from_df(S.runs(b).union(S.runs(b).selectExpr("start", "start")), "start", "end", length).cached()
    for i in (-1000, -1, 0, length // 2, length - 1, length + 1000):
        want = sum(x <= i for x in have)
        assert one(R.rank1(as_runs, i)) == want and one(R.rank0(as_runs, i)) == max(0, min(i + 1, length)) - want
    for n in (-1, 0, 1, 2, len(up), len(up) + 1, len(down), len(down) + 1):
        assert one(R.select1(as_runs, n)) == (up[n - 1] if 1 <= n <= len(up) else -1)
        assert one(R.select0(as_runs, n)) == (down[n - 1] if 1 <= n <= len(down) else -1)
    for i in {0, length // 3, length - 1} if length else ():
        assert one(R.access(as_runs, i)) == (i in have)
    with pytest.raises(IndexError):
        R.access(as_runs, length)
    as_runs.destroy()


@pytest.mark.parametrize("bad", [[(0, 5), (4, 6)], [(0, 11)], [(-1, 3)], [(0, 9), (2, 3)], [(None, 2)]])
def test_bad_runs(spark, bad):
    with pytest.raises(ValueError):
        RunBits.from_df(spark.createDataFrame(bad, "s long, e long"), "s", "e", 10)


def test_bad_bits(spark):
    for bad in (-1, 10):
        with pytest.raises(ValueError):
            BitSet.from_values(spark, [bad], 10)


def test_multiset(spark):
    values = sorted(random.Random(5).choices(range(40), k=60))
    m = Multiset.from_values(spark, values)
    assert [one(S.multiset_rank(m, i)) for i in (-1, 0, 17, 39, 99)] == [sum(v <= i for v in values) for i in (-1, 0, 17, 39, 99)]
    assert [one(S.multiset_access(m, i)) for i in (0, 1, 30, 59)] == [values[i] for i in (0, 1, 30, 59)]
    assert S.multiset_access(m, 60).count() == 0


@pytest.mark.parametrize("bad", [2.7, -1.0, None, 1e30])
def test_bad_multisets(spark, bad):
    with pytest.raises(ValueError):
        Multiset.from_df(spark.createDataFrame([(1.0,), (bad,)], "v double"), "v")


def test_ceil_divide(spark):
    xs = [0, 1, 6, 7, 8, -1, -7, -8, 2**53 + 1, 2**62 + 1, -(2**62) - 1]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    assert [tuple(r) for r in df.select(B.ceil_divide(F.col("x"), 1), B.ceil_divide(F.col("x"), 7)).collect()] == [(x, -(-x // 7)) for x in xs]


def test_bit_functions(spark):
    xs = [0, 1, 2, 6, 255, 2**31, 2**32 - 1, 12345678]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    x = F.col("x")
    got = df.select("x", B.popcount(x), B.trailing_zeros(x), B.reverse_bits(x), B.reverse_bits(x, 8), B.ones_array(x), B.clamp(x, 2, 300)).collect()
    for v, ones, zeros, back, back8, places, clamped in map(tuple, got):
        s = f"{v:032b}"
        assert (ones, zeros, back, back8) == (s.count("1"), 32 - len(s.rstrip("0")) if v else 32, int(s[::-1], 2), int(f"{v & 255:08b}"[::-1], 2))
        assert places == [i for i in range(32) if v >> i & 1] and clamped == max(2, min(300, v))
    assert df.select(B.encode_subcodes(0b10110, [F.lit(2), F.lit(1), F.lit(3)])).first()[0] == 0b11110
    with pytest.raises(ValueError):
        B.encode_subcodes(0b10110, [F.lit(2)])
