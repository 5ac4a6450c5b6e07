"""Queries over the driver's tables, one for each operator, each with SQL that any engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinata.functions import bits as B
from ordinata.operators import bitsets as S
from ordinata.operators import indexed as I
from ordinata.operators import runbits as R
from ordinata.operators import sequences as Q
from ordinata.sources.sequence import BitSet, Multiset, RunBits, Sequence, with_positions

SEPARATOR = B.subcode_separator([3, 5])
SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Sequence:
    return Sequence.from_df(_read(spark, sf_dir, "events"), "event_id", "user_id")


def types(spark: SparkSession, sf_dir: str) -> Sequence:
    """A small alphabet: the length of the event type."""
    return Sequence.from_df(_read(spark, sf_dir, "events"), "event_id", F.length("event_type"))


def orders(spark: SparkSession, sf_dir: str) -> Sequence:
    return Sequence.from_df(_read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def order_runs(spark: SparkSession, sf_dir: str) -> Sequence:
    """Each order's customer, repeated for each of its lines."""
    n = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    both = _read(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"))
    return Sequence.from_runs(both, "o_orderkey", "o_custkey", "n")


def errors(spark: SparkSession, sf_dir: str) -> BitSet:
    rows = _read(spark, sf_dir, "events")
    return BitSet.from_df(rows.filter("event_type = 'error'"), "event_id", rows.count())


def quantities(spark: SparkSession, sf_dir: str) -> Multiset:
    return Multiset.from_df(_read(spark, sf_dir, "lineitem"), "l_quantity")


def hundreds(spark: SparkSession, sf_dir: str) -> Multiset:
    """A derived column: prices in whole hundreds."""
    return Multiset.from_df(_read(spark, sf_dir, "lineitem"), F.floor(F.col("l_extendedprice") / 100))


def _add(name: str, source: Callable, run: Callable, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(source(spark, sf_dir))
    SQL[name] = sql


def _window(base: str) -> str:
    return f"""WITH s AS ({base}), w AS (SELECT * FROM s), h AS (SELECT sym, count(*) AS cnt FROM w GROUP BY sym),
    r AS (SELECT sym, cnt, CAST(sum(cnt) OVER (ORDER BY sym) - cnt AS BIGINT) AS lo, CAST(sum(cnt) OVER (ORDER BY sym) AS BIGINT) AS hi FROM h) """


EVENTS = "SELECT event_id AS pos, user_id AS sym FROM events"
TYPES = "SELECT event_id AS pos, CAST(length(event_type) AS BIGINT) AS sym FROM events"
ORDERS = "SELECT o_orderkey AS pos, o_custkey AS sym FROM orders"
RUNS = """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, o_custkey AS sym, n FROM orders JOIN n ON o_orderkey = l_orderkey),
    s AS (SELECT sym, CAST(sum(n) OVER (ORDER BY k) - n AS BIGINT) AS st, CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS en FROM o),
    c AS (SELECT sym, en - st AS x FROM s),
    h AS (SELECT sym, CAST(sum(x) AS BIGINT) AS cnt FROM c GROUP BY sym), r AS (SELECT sym, cnt, CAST(sum(cnt) OVER (ORDER BY sym) - cnt AS BIGINT) AS lo, CAST(sum(cnt) OVER (ORDER BY sym) AS BIGINT) AS hi FROM h) """
E = _window(EVENTS)
_N = "(SELECT count(*) FROM s)"
VALUES = "(VALUES {}) AS v({})"


def _values(rows, names: str) -> str:
    return VALUES.format(", ".join("(" + ", ".join(map(str, r if isinstance(r, tuple) else (r,))) + ")" for r in rows), names)


def _box(sym: str, lower: int, upper: int) -> str:
    return " AND ".join(f"(({sym} >> {at}) & {(1 << n) - 1}) BETWEEN {lower >> at & (1 << n) - 1} AND {upper >> at & (1 << n) - 1}" for at, n in B.fields(SEPARATOR, 8))


def _shares(s: Sequence) -> list[tuple[int, int]]:
    """Three ranges that together cover the sequence, whatever its length."""
    n = s.length
    return [(0, n // 2), (n // 4, 3 * n // 4), (n // 2, n)]


def _ranges_sql(having: str, keep: str = "sym BETWEEN 5 AND 120", base: str = EVENTS) -> str:
    each = ", ".join(f"CAST(sum(CASE WHEN pos >= {a} AND pos < {b} THEN 1 ELSE 0 END) AS BIGINT) AS c{j}" for j, (a, b) in enumerate([("0", "n // 2"), ("n // 4", "3 * n // 4"), ("n // 2", "n")]))
    return f"WITH s AS ({base}), l AS (SELECT count(*) AS n FROM s), g AS (SELECT sym, {each} FROM s, l WHERE {keep} GROUP BY sym) SELECT sym, c0 + c1 + c2 AS cnt, c0, c1, c2 FROM g WHERE {having}"


# Access
_add("access", events, lambda s: Q.access(s, 57), f"WITH s AS ({EVENTS}) SELECT sym FROM s WHERE pos = 57")
_add("access_batch", events, lambda s: Q.access_batch(s, [5, 900, 5, 17]), f"WITH s AS ({EVENTS}) SELECT CAST(ord AS BIGINT) AS ord, CAST(idx AS BIGINT) AS idx, sym FROM {_values(enumerate([5, 900, 5, 17]), 'ord, idx')} JOIN s ON s.pos = idx")
# Counting
_add("rank", events, lambda s: Q.rank(s, 7), E + "SELECT count(*) AS cnt FROM w WHERE sym = 7")
_add("rank_ignore_bits", events, lambda s: Q.rank(s, 42, ignore_bits=3), E + "SELECT count(*) AS cnt FROM w WHERE (sym >> 3) = (42 >> 3)")
_add("rank_batch", events, lambda s: Q.rank_batch(s, [3, 3, 7, 9, 100000]), E + f"SELECT q.sym, count(w.pos) AS cnt FROM (SELECT DISTINCT CAST(sym AS BIGINT) AS sym FROM {_values([3, 3, 7, 9, 100000], 'sym')}) q LEFT JOIN w ON w.sym = q.sym GROUP BY q.sym")
_add("rank_batch_ignore_bits", events, lambda s: Q.rank_batch(s, [3, 5, 9, 42], ignore_bits=3), E + f"SELECT q.sym, count(w.pos) AS cnt FROM (SELECT DISTINCT (CAST(sym AS BIGINT) >> 3) << 3 AS sym FROM {_values([3, 5, 9, 42], 'sym')}) q LEFT JOIN w ON ((w.sym >> 3) << 3) = q.sym GROUP BY q.sym")
_add("count_less_than", events, lambda s: Q.count_less_than(s, 40), E + "SELECT count(*) AS cnt FROM w WHERE sym < 40")
_add("count", events, lambda s: Q.count(s, 10, 40), E + "SELECT count(*) AS cnt FROM w WHERE sym >= 10 AND sym < 40")
# Grouped counts
_add("counts", events, lambda s: Q.counts(s, lower=10, upper=40), E + "SELECT sym, cnt FROM h WHERE sym BETWEEN 10 AND 40")
_add("counts_sorted", events, lambda s: Q.counts(s, sort=True), E + "SELECT sym, cnt FROM h")
_add("counts_ignore_bits", events, lambda s: Q.counts(s, lower=10, upper=40, ignore_bits=3), E + "SELECT (sym >> 3) << 3 AS sym, count(*) AS cnt FROM w WHERE (sym >> 3) BETWEEN (10 >> 3) AND (40 >> 3) GROUP BY 1")
_add("counts_aligned", events, lambda s: Q.counts(s, lower=8, upper=47, ignore_bits=3, aligned=True), E + "SELECT (sym >> 3) << 3 AS sym, count(*) AS cnt FROM w WHERE sym BETWEEN 8 AND 47 GROUP BY 1")
_add("counts_subcode", lambda a, b: Sequence.from_df(_read(a, b, "events"), "event_id", F.col("user_id") % 256, max_symbol=255), lambda s: Q.counts(s, lower=0b00001010, upper=0b01001100, separator=SEPARATOR), _window("SELECT event_id AS pos, user_id % 256 AS sym FROM events") + f"SELECT sym, cnt FROM h WHERE {_box('sym', 0b00001010, 0b01001100)}")
_add("counts_subcode_ignore_bits", lambda a, b: Sequence.from_df(_read(a, b, "events"), "event_id", F.col("user_id") % 256, max_symbol=255), lambda s: Q.counts(s, lower=0b00001010, upper=0b01001100, separator=SEPARATOR, ignore_bits=2), _window("SELECT event_id AS pos, user_id % 256 AS sym FROM events") + "SELECT (sym >> 2) << 2 AS sym, count(*) AS cnt FROM w WHERE ((sym >> 2) & 1) BETWEEN 0 AND 1 AND ((sym >> 3) & 31) BETWEEN 1 AND 9 GROUP BY 1")
_add("level_zeros", types, Q.level_zeros, f"WITH s AS ({TYPES}), m AS (SELECT greatest(1, CAST(floor(log2(max(sym))) AS BIGINT) + 1) AS n FROM s), b AS (SELECT CAST(i AS BIGINT) AS level, n - 1 - i AS bitno FROM m, range(0, 33) AS x(i) WHERE i < n) SELECT level, count(*) FILTER (((sym >> bitno) & 1) = 0) AS zeros FROM s, b GROUP BY level")
_add("empty_result", events, Q.empty_result, "SELECT CAST(0 AS BIGINT) AS sym, CAST(0 AS BIGINT) AS cnt WHERE false")
# Order statistics
_add("quantile", events, lambda s: Q.quantile(s, s.length // 2), E + f"SELECT sym, cnt FROM r WHERE lo <= {_N} // 2 AND {_N} // 2 < hi")
_add("quantile_batch", events, lambda s: Q.quantile_batch(s, list(range(0, s.length, max(1, s.length // 50)))), E + f"SELECT r.sym, r.cnt, count(*) AS num_offsets FROM (SELECT unnest(range(0, {_N}, greatest(1, {_N} // 50))) AS off) JOIN r ON r.lo <= off AND off < r.hi GROUP BY r.sym, r.cnt")
_add("quantile_batch_table", events, lambda s: Q.quantile_batch(s, s.df.sparkSession.range(0, s.length, 7).select(F.col("id").alias("off"))), E + f"SELECT r.sym, r.cnt, count(*) AS num_offsets FROM (SELECT unnest(range(0, {_N}, 7)) AS off) JOIN r ON r.lo <= off AND off < r.hi GROUP BY r.sym, r.cnt")
_add("quantiles", events, lambda s: Q.quantiles(s, s.length // 4, s.length // 2), E + f"SELECT sym, cnt FROM r WHERE hi > {_N} // 4 AND lo < {_N} // 2")
_add("majority", types, lambda s: Q.majority(s, 5), _window(TYPES) + f"SELECT sym, cnt FROM h WHERE cnt > {_N} // 5")
_add("simple_majority", lambda a, b: Sequence.from_df(_read(a, b, "events"), "event_id", (F.col("event_type") == "error").cast("long")), lambda s: Q.simple_majority(s), _window("SELECT event_id AS pos, CASE WHEN event_type = 'error' THEN 1::BIGINT ELSE 0::BIGINT END AS sym FROM events") + f"SELECT sym, cnt FROM h WHERE cnt > {_N} // 2")
_add("top_k", events, lambda s: Q.top_k(s, 5), E + "SELECT sym, cnt FROM h ORDER BY cnt DESC, sym LIMIT 5")
_add("most_frequent", events, lambda s: Q.most_frequent(s, 2), E + f", m AS (SELECT max(user_id) + 1 AS a FROM events), t AS (SELECT i, {_N} // (2 << i) AS x FROM range(0, 7) AS y(i), m WHERE i = 0 OR (2 << i) <= a), e AS (SELECT coalesce((SELECT x FROM t WHERE (SELECT count(*) FROM h WHERE cnt > x) >= 2 ORDER BY i LIMIT 1), 0) AS x) SELECT sym, cnt FROM h, e WHERE cnt > e.x".replace("(2 << i)", "CAST(2 * pow(2, i) AS BIGINT)"))
_add("select", events, lambda s: Q.select(s, 7, 3), E + "SELECT coalesce(max(pos), -1) AS pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM w WHERE sym = 7) WHERE n = 3")
_add("select_ignore_bits", events, lambda s: Q.select(s, 42, 5, ignore_bits=3), E + "SELECT coalesce(max(pos), -1) AS pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM w WHERE (sym >> 3) = 5) WHERE n = 5")
_add("next_value", events, lambda s: Q.next_value(s, 11), E + "SELECT min(sym) AS sym FROM w WHERE sym >= 11 HAVING min(sym) IS NOT NULL")
_add("min_max", events, lambda s: Q.min_max(s), E + "SELECT min(sym) AS min_sym, max(sym) AS max_sym FROM w")
# Sets
_add("union", events, lambda s: Q.union(s, _shares(s), lower=5, upper=120), _ranges_sql("c0 > 0 OR c1 > 0 OR c2 > 0"))
_add("intersect", events, lambda s: Q.intersect(s, _shares(s), lower=5, upper=120), _ranges_sql("c0 > 0 AND c1 > 0 AND c2 > 0"))
_add("difference", events, lambda s: Q.difference(s, _shares(s), lower=5, upper=120), _ranges_sql("c0 > 0 AND c1 = 0 AND c2 = 0"))
_add("set_op", events, lambda s: Q.set_op(s, _shares(s), lambda c: c[0] + c[2] > c[1], 5, 120), _ranges_sql("c0 + c2 > c1"))
_add("union_subcode", lambda a, b: Sequence.from_df(_read(a, b, "events"), "event_id", F.col("user_id") % 256, max_symbol=255), lambda s: Q.union(s, _shares(s), lower=0b00001010, upper=0b01001100, separator=SEPARATOR), _ranges_sql("c0 > 0 OR c1 > 0 OR c2 > 0", _box("sym", 0b00001010, 0b01001100), "SELECT event_id AS pos, user_id % 256 AS sym FROM events"))
# Runs
_add("runs_access", order_runs, lambda s: Q.access(s, 500), RUNS + "SELECT sym FROM s WHERE st <= 500 AND en > 500")
_add("runs_access_batch", order_runs, lambda s: Q.access_batch(s, [0, 500, 500, 901]), RUNS + f"SELECT CAST(ord AS BIGINT) AS ord, CAST(idx AS BIGINT) AS idx, sym FROM {_values(enumerate([0, 500, 500, 901]), 'ord, idx')} JOIN s ON st <= idx AND en > idx")
_add("runs_counts", order_runs, lambda s: Q.counts(s), RUNS + "SELECT sym, cnt FROM h")
_add("runs_rank", order_runs, lambda s: Q.rank(s, 640, ignore_bits=6), RUNS + "SELECT CAST(coalesce(sum(x), 0) AS BIGINT) AS cnt FROM c WHERE (sym >> 6) = 10")
_add("runs_quantile", order_runs, lambda s: Q.quantile(s, s.length // 2), RUNS + "SELECT sym, cnt FROM r WHERE lo <= (SELECT sum(cnt) FROM h) // 2 AND (SELECT sum(cnt) FROM h) // 2 < hi")
_add("runs_select", order_runs, lambda s: Q.select(s, 640, 9, ignore_bits=8), RUNS + ", m AS (SELECT st AS a, en - st AS x FROM s WHERE (sym >> 8) = 2), q AS (SELECT a, x, CAST(sum(x) OVER (ORDER BY a) AS BIGINT) AS hi FROM m) SELECT CAST(coalesce(max(a + 8 - (hi - x)), -1) AS BIGINT) AS pos FROM q WHERE hi >= 9 AND hi - x < 9")
_add("runs_union", order_runs, lambda s: Q.union(s, _shares(s)[::2]), RUNS + ", l AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM o) SELECT sym, c0 + c1 AS cnt, c0, c1 FROM (SELECT sym, CAST(sum(greatest(0, least(en, n // 2) - st)) AS BIGINT) AS c0, CAST(sum(greatest(0, en - greatest(st, n // 2))) AS BIGINT) AS c1 FROM s, l GROUP BY sym) WHERE c0 > 0 OR c1 > 0")
# Many ranges
def _cover(s: Sequence) -> DataFrame:
    """A range for each 100 positions, of 100 to 340."""
    i = F.col("id")
    return s.df.sparkSession.range((s.length + 99) // 100).select(i.alias("rid"), (i * 100).alias("first"), F.least(F.lit(s.length).cast("long"), i * 100 + 100 + (i % 7) * 40).alias("last"), F.lit(5).cast("long").alias("off"))


def _long(s: Sequence) -> DataFrame:
    """Fifty ranges of up to the whole sequence."""
    i, n = F.col("id"), F.lit(s.length).cast("long")
    return s.df.sparkSession.range(50).select(i.alias("rid"), F.floor(n * i / 100).alias("first"), (n - F.floor(n * i / 150)).alias("last"), F.floor(n / 4).alias("off"))


_COVER = f"SELECT CAST(i AS BIGINT) AS rid, CAST(i * 100 AS BIGINT) AS first, CAST(least({_N}, i * 100 + 100 + (i % 7) * 40) AS BIGINT) AS last, CAST(5 AS BIGINT) AS off FROM (SELECT unnest(range(0, ({_N} + 99) // 100)) AS i)"
_LONG = f"SELECT CAST(i AS BIGINT) AS rid, CAST({_N} * i // 100 AS BIGINT) AS first, CAST({_N} - {_N} * i // 150 AS BIGINT) AS last, CAST({_N} // 4 AS BIGINT) AS off FROM (SELECT unnest(range(0, 50)) AS i)"


def _counts_sql(base: str, ranges: str) -> str:
    return f"WITH s AS ({base}), q AS ({ranges}) SELECT rid, sym, count(*) AS cnt FROM s JOIN q ON pos >= first AND pos < last GROUP BY rid, sym"


def _quantiles_sql(base: str, ranges: str) -> str:
    return f"WITH s AS ({base}), q AS ({ranges}), h AS (SELECT rid, sym, off, count(*) AS cnt FROM s JOIN q ON pos >= first AND pos < last GROUP BY rid, sym, off), r AS (SELECT *, sum(cnt) OVER (PARTITION BY rid ORDER BY sym) AS hi FROM h) SELECT rid, sym, cnt FROM r WHERE hi > off AND hi - cnt <= off"


_add("counts_batch", events, lambda s: Q.counts_batch(s, _cover(s)), _counts_sql(EVENTS, _COVER))
_add("quantile_ranges", orders, lambda s: Q.quantile_ranges(s, _cover(s)), _quantiles_sql(ORDERS, _COVER))
_add("index_counts", events, lambda s: I.counts(I.build(s), _long(s)), _counts_sql(EVENTS, _LONG))
_add("index_quantiles", events, lambda s: I.quantiles(I.build(s), _long(s)), _quantiles_sql(EVENTS, _LONG))
_add("index_ranks", events, lambda s: I.ranks(I.build(s), _long(s).select("rid", "first", "last", (F.col("rid") % 9).alias("sym"))), f"WITH s AS ({EVENTS}), q AS ({_LONG}) SELECT rid, rid % 9 AS sym, (SELECT count(*) FROM s WHERE pos >= first AND pos < last AND s.sym = rid % 9) AS cnt FROM q")
_add("with_positions", lambda a, b: _read(a, b, "documents"), lambda d: with_positions(d, "doc_id").select("doc_id", "pos"), "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents")
# Bit sets
_BITS = "WITH s AS (SELECT event_id AS pos, event_type = 'error' AS one FROM events) "
_add("bits_rank1", errors, lambda b: S.rank1(b, 500), _BITS + "SELECT count(*) AS cnt FROM s WHERE one AND pos <= 500")
_add("bits_rank0", errors, lambda b: S.rank0(b, 500), _BITS + "SELECT count(*) AS cnt FROM s WHERE NOT one AND pos <= 500")
_add("bits_select1", errors, lambda b: S.select1(b, 20), _BITS + "SELECT coalesce(max(pos), -1) AS pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM s WHERE one) WHERE n = 20")
_add("bits_select0", errors, lambda b: S.select0(b, 20), _BITS + "SELECT coalesce(max(pos), -1) AS pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM s WHERE NOT one) WHERE n = 20")
_add("bits_access", errors, lambda b: S.access(b, 77), _BITS + "SELECT CAST(one AS BIGINT) AS bit FROM s WHERE pos = 77")
_RUNS = _BITS + ", g AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS k FROM s WHERE one), u AS (SELECT min(pos) AS st, max(pos) + 1 AS en FROM g GROUP BY k) "
_add("bits_runs", errors, S.runs, _RUNS + 'SELECT st AS start, en AS "end" FROM u')
_add("bits_aligned_rank", errors, S.aligned_rank, _RUNS + 'SELECT en AS "end", CAST(sum(en - st) OVER (ORDER BY st) AS BIGINT) AS cnt FROM u')
_add("bits_aligned_zeros", errors, lambda b: S.aligned_rank(b, zeros=True), _RUNS + 'SELECT en AS "end", CAST(en - sum(en - st) OVER (ORDER BY st) AS BIGINT) AS cnt FROM u')
_add("bits_complement", errors, lambda b: b.complement().df, _BITS + "SELECT pos FROM s WHERE NOT one")
# Bit sets as runs: the error events, joined to runs
def error_runs(spark: SparkSession, sf_dir: str) -> RunBits:
    bits = errors(spark, sf_dir)
    return RunBits.from_df(S.runs(bits), "start", "end", bits.length)


_add("run_bits_rank1", error_runs, lambda b: R.rank1(b, b.length // 2), _BITS + "SELECT CAST(count(*) AS BIGINT) AS cnt FROM s WHERE one AND pos <= (SELECT count(*) FROM s) // 2")
_add("run_bits_rank0", error_runs, lambda b: R.rank0(b, b.length // 2), _BITS + "SELECT count(*) AS cnt FROM s WHERE NOT one AND pos <= (SELECT count(*) FROM s) // 2")
_add("run_bits_select1", error_runs, lambda b: R.select1(b, 100), _BITS + "SELECT coalesce(max(pos), -1) AS pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM s WHERE one) WHERE n = 100")
_add("run_bits_select0", error_runs, lambda b: R.select0(b, b.length // 2), _BITS + "SELECT coalesce(max(pos), -1) AS pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM s WHERE NOT one) WHERE n = (SELECT count(*) FROM s) // 2")
_add("run_bits_access", error_runs, lambda b: R.access(b, b.length // 3), _BITS + "SELECT CAST(one AS BIGINT) AS bit FROM s WHERE pos = (SELECT count(*) FROM s) // 3")
# Multisets
_MS = "WITH m AS (SELECT CAST(l_quantity AS BIGINT) AS value, count(*) AS cnt FROM lineitem GROUP BY 1) "
_add("multiset", quantities, lambda m: m.df, _MS + "SELECT value, cnt FROM m")
_add("multiset_rank", quantities, lambda m: S.multiset_rank(m, 17), _MS + "SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS cnt FROM m WHERE value <= 17")
_add("multiset_access", quantities, lambda m: S.multiset_access(m, 4000), _MS + ", r AS (SELECT value, sum(cnt) OVER (ORDER BY value) AS hi, cnt FROM m) SELECT value FROM r WHERE hi > 4000 AND hi - cnt <= 4000")
_add("upper_bound", quantities, lambda m: S.upper_bound(m, 17), _MS + "SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS cnt FROM m WHERE value <= 17")
_add("lower_bound", quantities, lambda m: S.lower_bound(m, 17), _MS + "SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS cnt FROM m WHERE value < 17")
_DERIVED = "WITH m AS (SELECT CAST(floor(l_extendedprice / 100) AS BIGINT) AS value FROM lineitem) "
_add("upper_bound_derived", hundreds, lambda m: S.upper_bound(m, 170), _DERIVED + "SELECT count(*) AS cnt FROM m WHERE value <= 170")
_add("lower_bound_derived", hundreds, lambda m: S.lower_bound(m, 170), _DERIVED + "SELECT count(*) AS cnt FROM m WHERE value < 170")
# Scalar functions
_add(
    "bit_functions", lambda a, b: _read(a, b, "part"),
    lambda p: p.select("p_partkey", B.popcount(F.col("p_size")).alias("ones"), B.trailing_zeros(F.col("p_size")).alias("zeros"), B.reverse_bits(F.col("p_size"), 8).alias("reversed"), B.clamp(F.col("p_size"), 10, 20).alias("clamped"), B.ceil_divide(F.col("p_size"), 7).alias("sevenths"), B.unsigned(-F.col("p_size")).alias("wrapped"), B.intervals_overlap(F.col("p_size"), F.col("p_size") + 3, F.lit(10), F.lit(12)).alias("meets"), B.encode_subcodes(SEPARATOR, [F.col("p_size") % 8, F.col("p_size") % 32]).alias("code")),
    "SELECT p_partkey, CAST(bit_count(p_size) AS BIGINT) AS ones, CASE WHEN p_size = 0 THEN 32 ELSE CAST(bit_count(CAST((p_size & -p_size) - 1 AS BIGINT)) AS BIGINT) END AS zeros, "
    "CAST(list_sum(list_transform(range(0, 8), lambda i: ((CAST(p_size AS BIGINT) >> i) & 1) << (7 - i))) AS BIGINT) AS reversed, CAST(greatest(10, least(20, p_size)) AS BIGINT) AS clamped, CAST(ceil(p_size / 7.0) AS BIGINT) AS sevenths, "
    "4294967296 - p_size AS wrapped, p_size <= 12 AND p_size + 3 >= 10 AS meets, CAST((p_size % 8) | ((CAST(p_size AS BIGINT) % 32) << 3) AS BIGINT) AS code FROM part",
)
_add("reverse_bits_32", lambda a, b: _read(a, b, "part"), lambda p: p.select("p_partkey", B.reverse_bits(F.col("p_partkey") * 7919).alias("reversed"), F.array_join(B.ones_array(F.col("p_size")).cast("array<string>"), ",").alias("ones"), F.lit(B.subcode_separator([3, 5])).cast("long").alias("separator")), "SELECT p_partkey, CAST(list_sum(list_transform(range(0, 32), lambda i: (((p_partkey * 7919) >> i) & 1) << (31 - i))) AS BIGINT) AS reversed, array_to_string(list_filter(range(0, 32), lambda i: ((CAST(p_size AS BIGINT) >> i) & 1) = 1), ',') AS ones, CAST(4 + 128 AS BIGINT) AS separator FROM part")
_add("enumerate_ones", lambda a, b: _read(a, b, "part"), lambda p: p.select("p_partkey", B.enumerate_ones(F.col("p_size")).alias("bit")), "SELECT p_partkey, CAST(i AS INTEGER) AS bit FROM part, range(0, 32) AS x(i) WHERE ((CAST(p_size AS BIGINT) >> i) & 1) = 1")
