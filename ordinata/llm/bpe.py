"""Byte-pair encoding by a tokenization automaton.

The automaton reads token arcs and accepts exactly the token strings that applying the merges in order
can leave. It starts as one state that every byte loops on. A merge (u, v) -> uv then adds one gadget:
if v may follow u, the state that u leads to is split off for u alone and loses its v-arc, and every
state with a u-arc gets a uv-arc to where v leads. As all arcs of a token lead to one state, the
automaton is a bit matrix (token x state) of arcs and one target state for each token.

Encoding walks the bytes of a pre-split word over a table-driven trie of tokens and the automaton, the longest
allowed arc first: each prefix of a word has exactly one accepted path, so going back costs at most one walk more
from each byte. Decoding emits arc labels. The automaton depends on the vocabulary alone, so its size has a bound that no
data can move; it is compiled once and sent to the executors compressed.

Defined results. A null text is encoded as the empty text: no ids. Null ids decode to the empty text.
Strings of added tokens inside a text become their ids. Very long words cost time in proportion to
their length. An empty table gives no rows. Only the named columns are used.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Fixed value: how byte-level tokenizers split a text into words. L, N and S stand for the code points that are
#: letters, numbers and white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
#: Fixed value: the code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Words whose ids a worker keeps in each of two generations.
MAX_CACHED = 100_000


@lru_cache(maxsize=2)
def splitter(last: int = sys.maxunicode) -> re.Pattern:
    """SPLIT with its classes spelled out as ranges, for texts without code points above last. The classes of
    the first 65536 code points are much faster to test than those of all."""
    blank = set(WHITE_SPACE)
    ranges: dict[str, list[str]] = {"S": [], "L": [], "N": []}
    for kind, run in groupby(range(last + 1), key=lambda c: "S" if c in blank else {"L": "L", "N": "N"}.get(unicodedata.category(chr(c))[0])):
        if kind:
            codes = list(run)
            ranges[kind].append(f"\\U{codes[0]:08x}-\\U{codes[-1]:08x}")
    return re.compile("".join("".join(ranges[c]) if c in ranges else c for c in SPLIT))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


@dataclass
class Automaton:
    """arcs: packed bits, rows of ``width`` bytes; row: where in arcs each token's row begins (tokens that may
    follow the same states share one); target: state of each token, -1 if no path uses it; labels: bytes of
    each token; added: text of added tokens to id."""

    arcs: bytes
    width: int
    row: list[int]
    target: list[int]
    labels: list[bytes]
    added: dict[str, int]

    def packed(self) -> bytes:
        head = json.dumps({"width": self.width, "row": self.row, "target": self.target, "labels": [x.hex() for x in self.labels], "added": self.added}).encode()
        return zlib.compress(len(head).to_bytes(8, "little") + head + self.arcs, 1)

    @staticmethod
    def unpacked(data: bytes) -> Automaton:
        raw = zlib.decompress(data)
        n = int.from_bytes(raw[:8], "little")
        head = json.loads(raw[8 : 8 + n])
        return Automaton(raw[8 + n :], head["width"], head["row"], head["target"], [bytes.fromhex(x) for x in head["labels"]], head["added"])


def compile_merges(n_tokens: int, alphabet: list[int], merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(arcs, target) for merges (left, right, whole) of token ids, in order of priority."""
    # tokens are held in order of creation, so that a new state is a copy of the rows made so far
    order = list(dict.fromkeys([*alphabet, *(c for _, _, c in merges)]))
    place = {t: k for k, t in enumerate(order)}
    arcs = np.zeros((len(order), 64), np.uint8)
    target = np.full(len(order), -1, np.int64)
    made = len(alphabet)
    target[:made] = 0
    arcs[:made, 0] = 1
    refs = [made + 1]  # tokens that lead to a state; the start counts as one
    for a, b, c in merges:
        a, b, c = place[a], place[b], place[c]
        q, r = int(target[a]), int(target[b])
        if q < 0 or r < 0 or not arcs[b, q >> 3] >> (q & 7) & 1:
            continue  # b can't follow a: no text ever uses this merge
        made = max(made, c + 1)
        own = q
        if refs[q] > 1 or a == b:
            own = len(refs)
            if own >> 3 >= arcs.shape[1]:
                arcs = np.hstack([arcs, np.zeros_like(arcs)])
            arcs[:made, own >> 3] |= ((arcs[:made, q >> 3] >> (q & 7)) & 1) << (own & 7)
            refs[q] -= 1
            refs.append(1)
            target[a] = own
        arcs[b, own >> 3] &= 255 ^ (1 << (own & 7))
        arcs[c] = arcs[a]
        target[c] = r
        refs[r] += 1
    width = (len(refs) + 7) // 8
    out, to = np.zeros((n_tokens, width), np.uint8), np.full(n_tokens, -1, np.int64)
    out[order], to[order] = arcs[:, :width], target
    return out, to


def load(path: str) -> Automaton:
    """Compile a byte-level BPE vocabulary file (tokenizers' JSON)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    n = max([*vocab.values(), *added.values()]) + 1
    letters = byte_letters()
    labels = [b""] * n
    for text, k in vocab.items():
        labels[k] = bytes(letters[ch] for ch in text) if all(ch in letters for ch in text) else text.encode()
    for text, k in added.items():
        labels[k] = text.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    arcs, target = compile_merges(n, [vocab[ch] for ch in letters if ch in vocab], merges)
    rows: dict[bytes, int] = {}
    row = [rows.setdefault(r.tobytes(), len(rows)) * arcs.shape[1] for r in arcs]
    return Automaton(b"".join(rows), arcs.shape[1], row, target.tolist(), labels, added)


class Coder:
    """Encodes and decodes texts with an automaton, in one process."""

    def __init__(self, a: Automaton):
        self.arcs, self.row, self.target, self.labels = a.arcs, array("q", a.row), array("i", a.target), a.labels
        # the trie of labels as one table: each beginning of a label to the token that it is, -1 if it is none
        self.step: dict[bytes, int] = {}
        for k, label in enumerate(a.labels):
            if a.target[k] >= 0:
                for i in range(1, len(label)):
                    self.step.setdefault(label[:i], -1)
                self.step[label] = k
        self.split = [splitter(0x7F), splitter(0xFFFF), splitter()]
        self.added = a.added
        self.marks = re.compile("|".join(map(re.escape, sorted(a.added, key=len, reverse=True)))) if a.added else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, data: bytes) -> list[int]:
        step, arcs, row, target, labels = self.step.get, self.arcs, self.row, self.target, self.labels
        out: list[int] = []
        at, s, last = 0, 0, len(data)
        while at < len(data):
            # the longest arc; where there is none, the arc that led here gives way to the next shorter one. As each
            # beginning of a word has one accepted path, no place is come to by two
            here = []
            for i in range(at + 1, last + 1):
                t = step(data[at:i])
                if t is None:
                    break
                if t >= 0:
                    here.append(t)
            byte, bit = s >> 3, s & 7
            while here:
                t = here.pop()
                if arcs[row[t] + byte] >> bit & 1:
                    out.append(t)
                    at += len(labels[t])
                    s, last = target[t], len(data)
                    break
            else:
                last = at - 1
                at -= len(labels[out.pop()])
                s = target[out[-1]] if out else 0
        return out

    def _new(self, w: str) -> bytes:
        """The packed ids of a word that wasn't in the cache."""
        ids = self.cache.get(w) or self.older.get(w) or packed(self.word(w.encode("utf-8", "surrogatepass")))
        if len(w) <= 64:
            if len(self.cache) >= MAX_CACHED:
                self.older, self.cache = self.cache, {}
            self.cache[w] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        kind = 0 if text.isascii() else 1 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 2
        words = self.split[kind].findall(text)
        ids = list(map(self.cache.get, words))
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = self._new(words[i])
        return b"".join(ids)

    def pack(self, text: str) -> bytes:
        """The ids of a text, packed."""
        out, at = [], 0
        for m in self.marks.finditer(text) if self.marks else ():
            out += [self._plain(text[at : m.start()]), packed([self.added[m[0]]])]
            at = m.end()
        out.append(self._plain(text[at:] if at else text))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return unpacked(self.pack(text))

    def forget(self) -> None:
        """Between tasks: Spark hands this process to other stages, which need the memory."""
        self.cache, self.older = {}, {}

    def decode(self, ids) -> str:
        return decode(self.labels, ids)


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def decode(labels: list[bytes], ids) -> str:
    return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """One coder for each worker process and vocabulary."""
    key = zlib.crc32(shared.value)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(Automaton.unpacked(shared.value))
    return _coders[key]


def encode_texts(docs: DataFrame, automaton: Automaton, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded_col: str | None = None) -> DataFrame:
    """The columns of keep (but for those whose names the new ones take), n_tokens, and ids: little-endian unsigned
    32-bit integers, packed. decoded_col: adds what the ids decode to, in the same pass."""
    keep = tuple(c for c in keep if c not in ("n_tokens", "ids", decoded_col))
    shared = docs.sparkSession.sparkContext.broadcast(automaton.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = [coder.pack(t or "") for t in part.column(0).to_pylist()]
                new = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if decoded_col:
                    new[decoded_col] = pa.array([coder.decode(unpacked(x)) for x in ids], pa.string())
                yield pa.record_batch([*part.columns[1:], *new.values()], [*part.schema.names[1:], *new])
        coder.forget()

    rows = docs.select(docs[text_col].cast("string").alias("_text"), *(docs[c] for c in keep))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return map_arrow(rows, run, ", ".join([*fields, "n_tokens long", "ids binary", *([f"`{decoded_col}` string"] if decoded_col else [])]))


def decode_ids(rows: DataFrame, automaton: Automaton, *, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), out_col: str = "decoded") -> DataFrame:
    """The columns of keep, and the text of the packed ids."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [decode(labels, unpacked(x or b"")) for x in part.column(0).to_pylist()]
                yield pa.record_batch([*part.columns[1:], pa.array(texts, pa.string())], [*part.schema.names[1:], out_col])

    picked = rows.select(rows[ids_col].alias("_ids"), *(rows[c] for c in keep))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:]]
    return map_arrow(picked, run, ", ".join([*fields, f"`{out_col}` string"]))
