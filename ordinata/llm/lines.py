"""Line dedup by a sharded minimal perfect hash.

Lines are counted by a 128-bit hash of their key, once for each document. The hashes that reach the
limit are split into shards by value; each shard becomes a minimal perfect hash (levels of bit arrays
with ranks) that indexes two compact arrays, a 64-bit fingerprint and a count. Documents then probe the
arrays: a line goes if its slot holds its fingerprint. Hashes below the limit needn't be in the index,
as the fingerprint turns them away. Shards are sent to the executors in groups of bounded size, one pass
over the documents for each group (almost always a single one), so nothing that is broadcast grows.

Defined results. A null or empty text is one empty line and stays (it comes back as ''). A key of fewer
than min_chars code points is never dropped. A line counts once for each row that has it, so repeated
rows count each. A document may lose all lines: its text is then ''. An empty table gives no rows. All
columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, Split, cut, map_arrow

MIN_DOCS = 10
MIN_CHARS = 1
#: Hashes of a shard, on average.
SHARD_KEYS = 200_000
#: Bytes of shards that are broadcast at once.
GROUP_BYTES = 48_000_000
#: Bits of a level for each key that is still without a slot.
GAMMA = 2.0
#: Texts that a pass holds at once.
ROWS = 512


def line_key(line: bytes) -> bytes:
    return line.strip(WS).lower()  # bytes.lower() is for A-Z alone


def _hashes(text: str | None, min_chars: int) -> list[bytes | None]:
    """The hash of each line's key; None for keys that are too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line_key(line)
        if len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8", "surrogatepass")) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash over pairs of 64-bit hashes: at each level, a key whose bit no other key of the
    level takes is done; the rest go on. A key's slot is the rank of its bit."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.levels: list[np.ndarray] = []
        while len(h1) and len(self.levels) < 64:
            size = max(64, int(GAMMA * len(h1)))
            at = (_mix(h1, h2, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        if len(h1):
            raise ValueError("keys must be distinct")
        self._rank()

    def _rank(self) -> None:
        self.ranks, at = [], 0
        for bits in self.levels:
            r = np.cumsum(bits, dtype=np.int64) - 1 + at
            self.ranks.append(r.astype(np.int32))
            at += int(bits.sum())

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slots; -1 for keys that no level has."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(h1[left], h2[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def pack(h1: np.ndarray, h2: np.ndarray, count: np.ndarray) -> bytes:
    """A shard: level sizes, their bits, fingerprints and counts."""
    mph = PerfectHash(h1, h2)
    slot = mph(h1, h2)
    prints, counts = np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.uint32)
    prints[slot], counts[slot] = h2, np.minimum(count, 2**32 - 1)
    sizes = np.array([len(h1), *(len(x) for x in mph.levels)], np.int64)
    return b"".join([np.array([len(sizes)], np.int64).tobytes(), sizes.tobytes(), prints.tobytes(), counts.tobytes(), *(np.packbits(x).tobytes() for x in mph.levels)])


class Shard:
    def __init__(self, data: bytes):
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        at = 8 + 8 * n
        self.prints = np.frombuffer(data, np.uint64, sizes[0], at)
        at += 8 * int(sizes[0])
        self.counts = np.frombuffer(data, np.uint32, sizes[0], at)
        at += 4 * int(sizes[0])
        self.mph = PerfectHash.__new__(PerfectHash)
        self.mph.levels = []
        for size in map(int, sizes[1:]):
            nb = (size + 7) // 8
            self.mph.levels.append(np.unpackbits(np.frombuffer(data, np.uint8, nb, at), count=size).astype(bool))
            at += nb
        self.mph._rank()

    def count_of(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Counts; 0 for keys that aren't in the shard."""
        if not len(self.prints):
            return np.zeros(len(h1), np.int64)
        slot = self.mph(h1, h2)
        ok = (slot >= 0) & (self.prints[slot] == h2)
        return np.where(ok, self.counts[slot], 0).astype(np.int64)


def count_lines(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, n): documents that have a line with this hash of its key; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out():
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            n = np.fromiter(found.values(), np.int64, len(found))
            for lo in range(0, len(n), 50_000):
                yield pa.record_batch([pa.array(both[lo : lo + 50_000, 0]), pa.array(both[lo : lo + 50_000, 1]), pa.array(n[lo : lo + 50_000])], ["h1", "h2", "n"])

        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                for t in b.slice(lo, ROWS).column(0).to_pylist():
                    found.update({h for h in _hashes(t, min_chars) if h is not None})
                if len(found) > 300_000:
                    yield from out()
                    found.clear()
        yield from out()

    pairs = map_arrow(docs.select(docs[text_col].cast("string").alias("t")), run, "h1 long, h2 long, n long")
    return pairs.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, data): one row for each shard that has keys."""

    def run(t: pa.Table) -> pa.Table:
        h1, h2 = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))
        data = pack(h1, h2, t.column("n").combine_chunks().to_numpy(zero_copy_only=False))
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "keys": pa.array([len(h1)], pa.int64()), "data": pa.array([data], pa.binary())})

    keyed = counts.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("long"))
    return keyed.groupBy("shard").applyInArrow(run, "shard long, keys long, data binary")


def _probe(docs: DataFrame, group: dict[int, bytes], shards: int, limit: int, min_chars: int, last: bool) -> DataFrame:
    """One pass: (row, text, mask) with the lines marked that this group's shards drop; the last pass
    gives (row, text, n_lines, n_dropped) instead."""
    shared = docs.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {k: Shard(v) for k, v in shared.value.items()}
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                texts, masks = b.column(1).to_pylist(), b.column(2).to_pylist()
                each = [_hashes(t, min_chars) for t in texts]
                flat = [h for hs in each for h in hs]
                known = np.fromiter((h is not None for h in flat), bool, len(flat))
                both = np.frombuffer(b"".join(h for h in flat if h is not None), np.uint64).reshape(-1, 2)
                h1, h2 = both[:, 0].copy(), both[:, 1].copy()
                of = h1.view(np.int64) % np.int64(shards)
                drop = np.zeros(len(h1), bool)
                for k in np.unique(of):
                    if int(k) in index:
                        mine = np.flatnonzero(of == k)
                        drop[mine] = index[int(k)].count_of(h1[mine], h2[mine]) >= limit
                marks = np.zeros(len(flat), bool)
                marks[known] = drop
                at, out = 0, []
                for hs, m in zip(each, masks):
                    mine = marks[at : at + len(hs)]
                    out.append(mine if m is None else mine | np.frombuffer(m, bool))
                    at += len(hs)
                if not last:
                    yield pa.record_batch([b.column(0), b.column(1), pa.array([m.tobytes() for m in out], pa.binary())], ["row", "text", "mask"])
                    continue
                kept = ["\n".join(x for x, gone in zip((t or "").split("\n"), m) if not gone) if m.any() else t or "" for t, m in zip(texts, out)]
                yield pa.record_batch([b.column(0), pa.array(kept, pa.string()), pa.array([len(m) for m in out], pa.int64()), pa.array([int(m.sum()) for m in out], pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    kind = docs.schema["row"].dataType.simpleString()
    return map_arrow(docs, run, f"row {kind}, text string, " + ("n_lines long, n_dropped long" if last else "mask binary"))


def dedup_lines(docs: DataFrame, *, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, group_bytes: int = GROUP_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The input's columns with the text's lines that min_docs documents or more share taken out, and
    n_lines (before) and n_dropped, which replace columns of these names."""
    frequent = cut(count_lines(docs, text_col, min_chars).filter(F.col("n") >= min_docs))
    shards = max(1, math.ceil(frequent.count() / shard_keys))
    index = cut(build_index(frequent, shards))
    sizes = sorted((r["shard"], r["bytes"]) for r in index.select("shard", F.length("data").alias("bytes")).collect())  # one small row a shard
    groups: list[list[int]] = [[]]
    total = 0
    for shard, size in sizes:
        if groups[-1] and total + size > group_bytes:
            groups.append([])
            total = 0
        groups[-1].append(shard)
        total += size
    split = Split(docs, text_col)
    rows = split.rows.withColumn("mask", F.lit(None).cast("binary"))
    for k, group in enumerate(groups):
        data = {r["shard"]: bytes(r["data"]) for r in index.filter(F.col("shard").isin(group)).collect()} if group else {}  # at most group_bytes
        rows = _probe(rows, data, shards, min_docs, min_chars, last=k == len(groups) - 1)
        if k % 4 == 3 and k < len(groups) - 1:
            rows = cut(rows)
    old = [c for c, name in zip(split.columns(), split.names) if name not in ("n_lines", "n_dropped")]
    return rows.select(*old, "n_lines", "n_dropped")
