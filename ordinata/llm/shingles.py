"""Hashed word shingles, and shingles that many documents share.

A word is a run of characters other than \\x20 and \\x09-\\x0D of the lower-cased text. A text of fewer
words than a shingle has all of its words as its one shingle; a text without words has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

WORDS = 5
#: A shingle that at most this share of all documents have has full weight; weights fall from there on.
COMMON_SHARE = 0.01
#: Weight of a shingle that all documents have, all but a little.
LEAST_WEIGHT = 0.5
#: Keys of texts that a task remembers, so that copies count once.
TEXTS = 200_000
#: Summaries that are merged at once.
FAN_IN = 16
#: Counters of a summary of frequent shingles, at least.
COUNTERS = 16384
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 2**64) for k in range(64)], np.uint64)


#: Bytes of texts that are hashed at once.
CHUNK = 250_000
_base = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(11))
_letter = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * CHUNK, np.uint64(b))])) for b in (_base, pow(_base, -1, 2**64)))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, last byte, hash) of each word: differences of prefix sums of letter * base**place, moved to place 0."""
    c = np.frombuffer(data, np.uint8)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _powers()
    blank = _blank[c]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
    sums = np.cumsum(_letter[c] * power[: len(c)])
    h = sums[last] - np.where(first > 0, sums[np.maximum(first, 1) - 1], np.uint64(0))
    return first, last, mix(h * inverse[first] + (last - first).astype(np.uint64))


def text_words(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order."""
    group: list[bytes] = []
    held = 0

    def out():
        ends = np.cumsum([len(x) + 1 for x in group])
        first, _, h = _hashed(b"\n".join(group))
        return np.split(h, np.searchsorted(first, ends[:-1])) if len(group) > 1 else [h]

    for t in texts:
        data = (t or "").lower().encode("utf-8", "surrogatepass")
        if len(data) > CHUNK or held + len(data) > CHUNK:
            if group:
                yield from out()
                group, held = [], 0
        if len(data) > CHUNK:
            yield word_places(data)[2]
        else:
            group.append(data)
            held += len(data) + 1
    if group:
        yield from out()


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, hash) of each word of a text of any length."""
    parts = [(first + lo, last + lo + 1, h) for lo, piece in _pieces(data) for first, last, h in [_hashed(piece)]]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of at most CHUNK bytes, with their places, cut at blanks; a longer word is cut as it comes."""
    lo = 0
    while lo < len(data):
        hi = lo + CHUNK
        if hi < len(data):
            at = max(data.rfind(x, lo + 1, hi) for x in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            hi = at if at > lo else hi
        yield lo, data[lo:hi]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def shingle_hashes(h: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hash of each run of size words, in order; of all words if they are fewer."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    out = h[: n - size + 1] * MULTIPLIERS[0]
    for k in range(1, size):
        out = out + h[k : n - size + 1 + k] * MULTIPLIERS[k]
    return mix(out)


def text_key(h: np.ndarray) -> bytes:
    """128-bit hash of the words' hashes: equal for texts that differ in blanks and case alone."""
    return xxhash.xxh3_128_digest(h.tobytes())


def _top(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries: keep k counters at most, less the largest count that has to go."""
    if len(keys) <= k:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1])
    keep = counts > cut
    return keys[keep], counts[keep] - cut, cut


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, at = np.unique(keys, return_inverse=True)
    return out, np.bincount(at, counts, len(out)).astype(np.int64)


SUMMARY = "part long, docs long, total long, lost long, keys binary, counts binary"


def _row(part: int, docs: int, total: int, lost: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part]), pa.array([docs]), pa.array([total]), pa.array([lost]), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["part", "docs", "total", "lost", "keys", "counts"])


def _merged(rows: list[dict]) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    docs, total, lost = (sum(r[c] for r in rows) for c in ("docs", "total", "lost"))
    keys, counts = _added(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in rows)]), np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in rows)]))
    keys, counts, cut = _top(keys, counts, counters(docs, total))
    return docs, total, lost + cut, keys, counts


def counters(docs: int, total: int) -> int:
    """So many that what a summary loses stays below half of the share asked for."""
    return max(COUNTERS, math.ceil(2 * total / max(1, docs) / COMMON_SHARE))


def common_shingles(docs: DataFrame, text_col: str, size: int = WORDS, share: float = COMMON_SHARE) -> tuple[int, dict[int, int]]:
    """(documents, in how many distinct texts each shingle is, of those in more than this share of all
    documents). Texts of equal words count once, so that copies of a document don't make its shingles common.
    Each task keeps a mergeable Misra-Gries summary, which can't miss such a shingle; summaries are merged as
    a tree. A second pass counts the candidates left exactly, by text. There are at most as many as
    ``counters``, so what reaches the driver has a bound."""
    texts = docs.select(docs[text_col].cast("string").alias("t"), F.spark_partition_id().cast("long").alias("p"))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = lost = part = held = 0
        keys, counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        seen: set[bytes] = set()

        def add() -> None:
            nonlocal keys, counts, waiting, held, lost
            x = np.sort(np.concatenate([np.zeros(0, np.uint64), *waiting]))
            at = np.flatnonzero(np.concatenate([[True] * (len(x) > 0), x[1:] != x[:-1]]))
            k = 4 * counters(n, total)
            new, many, cut = _top(x[at], np.diff(np.concatenate([at, [len(x)]])), k)
            keys, counts, more = _top(*_added(np.concatenate([keys, new]), np.concatenate([counts, many])), k)
            lost, waiting, held = lost + cut + more, [], 0

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.column(1)[lo].as_py()
                for h in text_words(b.column(0).slice(lo, 512).to_pylist()):
                    n += 1
                    if (key := text_key(h)) in seen:
                        continue
                    if len(seen) >= TEXTS:
                        seen.clear()
                    seen.add(key)
                    s = np.unique(shingle_hashes(h, size))
                    total += len(s)
                    waiting.append(s)
                    held += len(s)
                    if held > 500_000:
                        add()
        add()
        keys, counts, cut = _top(keys, counts, counters(n, total))
        if n:
            yield _row(part, n, total, lost + cut, keys, counts)

    def merge(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_row(t.column("part")[0].as_py(), *_merged(t.to_pylist()))])

    parts = cut(map_arrow(texts, summary, SUMMARY))
    tasks = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while tasks > FAN_IN:
        tasks = math.ceil(tasks / FAN_IN)
        parts = cut(parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(merge, SUMMARY))
    n, total, lost, keys, counts = _merged([r.asDict() for r in parts.collect()])  # FAN_IN rows at most
    maybe = np.sort(keys[counts + lost > share * n])
    if not n or not len(maybe):
        return n, {}
    sent = docs.sparkSession.sparkContext.broadcast(maybe.tobytes())

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, its candidates as places in maybe)."""
        want = np.frombuffer(sent.value, np.uint64)
        near = np.zeros(1 << 20, bool)
        near[want >> np.uint64(44)] = True
        seen: set[bytes] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                nodes, found = [], []
                for h in text_words(b.column(0).slice(lo, 512).to_pylist()):
                    s = shingle_hashes(h, size)
                    s = s[near[s >> np.uint64(44)]]
                    at = np.minimum(np.searchsorted(want, s), len(want) - 1)
                    at = np.unique(at[want[at] == s])
                    if not len(at) or (key := text_key(h)) in seen:
                        continue
                    if len(seen) >= TEXTS:
                        seen.clear()
                    seen.add(key)
                    nodes.append(key)
                    found.append(at.astype(np.uint32).tobytes())
                yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(found, pa.binary())], ["node", "found"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = np.frombuffer(sent.value, np.uint64)
        count = np.zeros(len(want), np.int64)
        for b in batches:
            if b.num_rows:
                at = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32)
                count += np.bincount(at, minlength=len(want))
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(want[some].view(np.int64)), pa.array(count[some])], ["h", "n"])

    each = map_arrow(texts, which, "node binary, found binary").groupBy("node").agg(F.first("found").alias("found")).select("found")
    exact = map_arrow(each, tally, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > share * n).collect()
    return n, {r["h"] % 2**64: r["n"] for r in exact}


class Weights:
    """TF-IDF with a smoothed IDF: 1 for shingles of at most COMMON_SHARE of all documents, and less down to
    LEAST_WEIGHT, by the logarithm of the share, for others. Without these bounds, edits (unique shingles) of near
    copies in a large group would outweigh all that the copies share."""

    def __init__(self, n: int, common: dict[int, int], share: float = COMMON_SHARE):
        self.keys = np.array(sorted(common), np.uint64)
        idf = [min(1.0, math.log(1 + n / common[k]) / math.log(1 + 1 / share)) for k in sorted(common)]
        self.idf = LEAST_WEIGHT + (1 - LEAST_WEIGHT) * np.array(idf, np.float64)

    def of(self, h: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingles in order, weights) of a text's word hashes."""
        keys, tf = np.unique(shingle_hashes(h, size), return_counts=True)
        w = tf.astype(np.float64)
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            w *= np.where(self.keys[at] == keys, self.idf[at], 1.0)
        return keys, w


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][ia], b[1][ib]).sum()
    all_ = a[1].sum() + b[1].sum() - both
    return float(both / all_) if all_ > 0 else 0.0
