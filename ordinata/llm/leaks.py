"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are lower-cased and each run of white space becomes one space. An item of m characters
may occur with k = edit_share * m edits at most; such an occurrence shares m - q + 1 - k * q character
q-grams with the text (q-gram lemma), all within 2k + 1 neighbouring diagonals (text minus item
position). Shared q-grams are counted in overlapping diagonal bands, twice as wide as that and one such
width apart, so each occurrence lies within one band; bands that reach the bound are verified by a banded
alignment, free at both ends in the text. k is lowered for short items until the bound is 1 at least.

Items go to the executors in groups of bounded size, one pass over the documents for each group.

Defined results. A null or empty text has no leaks. Null items, and items of fewer than q characters, leak
nowhere. Items with equal text are reported each. Overlapping occurrences of an item count once, the best
first. Offsets are code points of the text as given. Repeated rows are judged each. An empty benchmark or
table gives no leaks. Very long texts are searched in pieces of their joined characters, which overlap by more
than any occurrence takes. Where q-grams repeat a lot, places are counted part by part, so that memory is bounded.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Split, cut, map_arrow

Q = 8
EDIT_SHARE = 0.08
#: Characters of items that are sent to the executors at once.
GROUP_CHARS = 4_000_000
#: Characters that a worker searches at once, and pairs of equal q-grams' places that it counts at once.
PIECE, PAIRS = 1_000_000, 2_000_000
LEAK = "array<struct<item:string,start:long,end:long,edits:long>>"
LEAK_TYPE = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
BASE = 0x9E3779B97F4A7C15
BLANK = np.zeros(64, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def lowered(text: str) -> str:
    """Lower case, character by character: neither case nor length depends on what stands beside a character."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.replace("\u03c2", "\u03c3")  # the two small sigmas


def normal_pieces(text: str, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points with blanks joined, their offsets in the text) of each size characters."""
    before = True  # so that blanks in front go
    for lo in range(0, len(text), size):
        c = np.frombuffer(lowered(text[lo : lo + size]).encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = BLANK[np.minimum(c, 63)]
        keep = np.flatnonzero(~(blank & np.concatenate([[before], blank[:-1]])))
        before = bool(blank[-1])
        yield np.where(blank, np.uint32(32), c)[keep], keep + lo


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The whole text's, without blanks at its end."""
    parts = list(normal_pieces(text, PIECE)) or [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
    out, keep = (np.concatenate(x) for x in zip(*parts))
    end = len(out) - (len(out) > 0 and out[-1] == 32)
    return out[:end], keep[:end]


def qgrams(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams; uint64 arithmetic wraps."""
    if q == 1:
        return c.astype(np.uint64) + np.uint64(1)
    half = q // 2
    a = qgrams(c, half)
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h = a[:-half] * np.uint64(pow(BASE, half, 2**64)) + a[half:]
    if q % 2:
        h = h[:-1] * np.uint64(BASE) + c[2 * half :].astype(np.uint64) + np.uint64(1)
    return h


def budget(m: int, q: int, share: float) -> tuple[int, int]:
    """(edits k, shared q-grams needed) of an item of m characters."""
    k = max(0, min(int(share * m), (m - q) // q))
    return k, m - q + 1 - k * q


def align(item: np.ndarray, text: np.ndarray, first: int, last: int) -> tuple[int, int]:
    """(edits, end in text): the best alignment of the whole item whose start, and every step, keeps text
    minus item position within [first, last]."""
    width, m = last - first + 1, len(item)
    # characters that no item has stand before and after the text: to match one costs as much as to leave out
    before, after = max(0, -first), max(0, last + m - len(text))
    none = np.uint32(0xFFFFFFFF)
    padded = np.concatenate([np.full(before, none), text, np.full(after, none)])
    other = np.lib.stride_tricks.sliding_window_view(padded, width)[first + before : first + before + m] != item[:, None]
    ramp = np.arange(width)
    d = np.zeros(width, np.int64)
    for row in other:
        v = d + row
        np.minimum(v[:-1], d[1:] + 1, out=v[:-1])  # item character left out
        v -= ramp
        d = np.minimum.accumulate(v) + ramp  # text characters added
    k = int(d.argmin())
    return int(d[k]), min(max(0, m + first + k), len(text))


class Index:
    """The q-grams of a group of items."""

    def __init__(self, items: list[tuple[str, str]], q: int, share: float):
        self.q = q
        self.names, self.chars = [], []
        for name, text in items:
            c, _ = normal(text)
            if len(c) >= q:
                self.names.append(name)
                self.chars.append(c)
        self.sizes = np.array([len(c) for c in self.chars], np.int64)
        both = [budget(int(m), q, share) for m in self.sizes]
        self.edits, self.needed = (np.array([x[i] for x in both], np.int64) for i in (0, 1))
        self.step = 2 * self.edits + 1
        grams = [qgrams(c, q) for c in self.chars]
        h = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(h, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.keys, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.concatenate([self.first, [len(h)]]))
        self.shift = np.uint64(64 - max(16, min(26, math.ceil(math.log2(16 * len(self.keys) + 1)))))
        self.seen = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.seen[self._slot(self.keys)] = True
        self.reach = int((self.sizes + 4 * self.step).max()) + 1 if len(self.sizes) else 1

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(BASE)) >> self.shift

    def bands(self, c: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of bands that hold enough shared q-grams; c may hold many texts, set apart
        by characters that no item has."""
        if not len(self.keys):
            return []
        h = qgrams(c, self.q)
        at = np.flatnonzero(self.seen[self._slot(h)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        at, k = at[same], k[same]
        if not len(at):
            return []
        if self.count[k].sum() > PAIRS and len(c) > 8 * self.reach:  # each band lies within one half, or the other
            mid = len(c) // 2
            return self.bands(c[: mid + self.reach]) + [(item, first + mid - self.reach) for item, first in self.bands(c[mid - self.reach :])]
        wide = np.int64(len(c) + 2 * self.reach + 2)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(self.count[k])
        cuts = np.unique(np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]), PAIRS), "left") + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(k)]):
            here, place = k[lo:hi], at[lo:hi]
            n = self.count[here]
            which = np.repeat(self.first[here] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            item = self.item[which]
            diagonal = np.repeat(place, n) - self.pos[which] + self.reach  # never negative
            band = diagonal // self.step[item]
            new, many = np.unique(np.concatenate([item * wide + band, item * wide + np.maximum(band - 1, 0)]), return_counts=True)
            keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, many]), len(keys)).astype(np.int64)
        keep = counts >= self.needed[keys // wide]
        return [(int(x // wide), int(x % wide) * int(self.step[x // wide]) - self.reach) for x in keys[keep]]

    def search(self, texts: list[str]) -> list[list[tuple[str, int, int, int]]]:
        """Leaks (item, start, end, edits) of each text, in code points of the text."""
        found: list[list[tuple[str, int, int, int]]] = [[] for _ in texts]
        whole, size = [], 0
        for k, text in enumerate(texts):
            c, offset = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            for more, where in normal_pieces(text, PIECE):
                if len(c) >= PIECE:  # what is searched now overlaps with what comes
                    whole.append((k, c, offset))
                    self._search(whole, found)
                    whole, size = [], 0
                    c, offset = c[-2 * self.reach :], offset[-2 * self.reach :]
                c, offset = np.concatenate([c, more]), np.concatenate([offset, where])
            whole.append((k, c, offset))
            size += len(c)
            if size >= PIECE:
                self._search(whole, found)
                whole, size = [], 0
        self._search(whole, found)
        return [self._apart(x) for x in found]

    def _search(self, parts: list, found: list) -> None:
        if not parts:
            return
        gap = np.zeros(1, np.uint32)
        ends = np.cumsum([len(c) + 1 for _, c, _ in parts])
        for item, diagonal in self.bands(np.concatenate([x for _, c, _ in parts for x in (c, gap)])):
            x, k, step = self.chars[item], int(self.edits[item]), int(self.step[item])
            # an occurrence may begin in one part and the band lie partly in the one before
            p0, p1 = (int(np.searchsorted(ends, min(max(0, v), int(ends[-1]) - 1), "right")) for v in (diagonal - k, diagonal + 2 * step + k + len(x)))
            for p in range(p0, p1 + 1):
                who, c, offset = parts[p]
                base = int(ends[p]) - len(c) - 1
                first, last = diagonal - base - k, diagonal - base + 2 * step + k
                a = max(0, first - k)
                near = c[a : max(0, last + len(x) + k)]
                if len(near) < len(x) - k:
                    continue
                start, end, edits = self._verify(item, near, first - a, last - a)
                if edits > k:
                    continue
                found[who].append((self.names[item], int(offset[a + start]), int(offset[a + end - 1]) + 1, edits))

    def _verify(self, item: int, near: np.ndarray, first: int, last: int) -> tuple[int, int, int]:
        """(start, end, edits); exact occurrences, the most common by far, need no alignment."""
        x, k = self.chars[item], int(self.edits[item])
        exact = near.tobytes().find(x.tobytes())
        if exact >= 0 and exact % 4 == 0:
            return exact // 4, exact // 4 + len(x), 0
        if np.isin(qgrams(near, self.q), qgrams(x, self.q)).sum() < self.needed[item]:
            return 0, 0, len(x)  # the band's count came from texts side by side
        edits, end = align(x, near, first, last)
        if edits > k:
            return 0, 0, edits
        return end - self._start(x, near[:end][::-1], k)[1], end, edits

    @staticmethod
    def _start(x: np.ndarray, back: np.ndarray, k: int) -> tuple[int, int]:
        """(edits, length) of the best alignment of the reversed item that begins at back[0]."""
        n = min(len(back), len(x) + k)
        row = np.arange(n + 1)
        ramp = np.arange(n + 1)
        for i, c in enumerate(x[::-1].tolist()):
            v = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (back[:n] != c))])
            row = np.minimum.accumulate(v - ramp) + ramp
        length = int(row.argmin())
        return int(row[length]), length

    @staticmethod
    def _apart(leaks: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
        kept: list[tuple[str, int, int, int]] = []
        taken: dict[str, list[tuple[int, int]]] = {}  # of each item, in order and apart
        for x in sorted(set(leaks), key=lambda x: (x[3], x[1], x[2], x[0])):
            mine = taken.setdefault(x[0], [])
            at = bisect_left(mine, (x[1], x[2]))
            if (at == 0 or mine[at - 1][1] <= x[1]) and (at == len(mine) or x[2] <= mine[at][0]):
                mine.insert(at, (x[1], x[2]))
                kept.append(x)
        return sorted(kept, key=lambda x: (x[1], x[0]))


def _pass(rows: DataFrame, items: list[tuple[str, str]], q: int, share: float, keep_text: bool) -> DataFrame:
    """rows: (row, leaks, text). Adds this group's leaks."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, q, share)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                new = index.search([t or "" for t in b.column(2).to_pylist()])
                old = b.column(1).to_pylist()
                leaks = [[*(o or []), *({"item": i, "start": s, "end": e, "edits": d} for i, s, e, d in n)] for o, n in zip(old, new)]
                cols = [b.column(0), pa.array(leaks, LEAK_TYPE), *([b.column(2)] if keep_text else [])]
                yield pa.record_batch(cols, ["row", "leaks", "text"][: len(cols)])

    return map_arrow(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, leaks {LEAK}" + (", text string" if keep_text else ""))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, q: int = Q, edit_share: float = EDIT_SHARE, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(row, leaks): row is a struct c0.. of the columns of keep (all but the text, if not given) in their order."""
    names = docs.columns
    keep = [c for c in names if c != text_col] if keep is None else keep
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    row = F.struct(*(F.col(f"c{names.index(c)}").alias(f"c{j}") for j, c in enumerate(keep))) if keep else F.struct(F.lit(0).alias("none"))
    return _all_leaks(flat.select(row.alias("row"), F.col(f"c{names.index(text_col)}").cast("string").alias("text")), benchmark, item_col, item_text_col, q, edit_share, group_chars, False)


def _all_leaks(rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", q: int = Q, edit_share: float = EDIT_SHARE, group_chars: int = GROUP_CHARS, keep_text: bool = True) -> DataFrame:
    """rows: (row, text). Adds leaks; without the text unless it is to be kept."""
    rows = rows.select("row", F.lit(None).cast(LEAK).alias("leaks"), "text")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("t")).filter("item is not null and t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    groups = max(1, math.ceil(2 * chars / group_chars)) if chars > group_chars else 1
    for g in range(groups):
        some = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(groups)) == g)
        rows = _pass(rows, sorted((r[0], r[1]) for r in some.collect()), q, edit_share, keep_text or g < groups - 1)
        if g % 4 == 3 and g < groups - 1:
            rows = cut(rows)
    return rows


def drop_leaking(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs in whose text no item leaks, with the columns of docs."""
    split = Split(docs, text_col)
    return _all_leaks(split.rows, benchmark, **how).filter(F.size("leaks") == 0).select(*split.columns())
