"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 100 words. Each passage is encoded from its words: the mean of learned
embeddings of the words (lower-cased, hashed to ``BUCKETS`` rows), beside counts that its text alone gives (word
lengths, letter cases, symbols, repeated words, and so on), through a tanh layer. Gated attention weighs the
encoded passages, and the score is a logistic function of their weighted sum. Embeddings and all layers are learned
together from document labels, by Adam on the driver, over a bounded sample: of the ``SAMPLE_DOCS`` labelled
documents of least hash, those that have ``SAMPLE_WORDS`` words together, whole (a document that would pass the bound
is left out). Learning and scoring read every passage of their documents.

Defined results. A null text, or one without words, scores 0. Labels that are null or contradict each
other are left out. Without labels of both kinds there is nothing to learn, and every text with a word
scores the share of good labels (0.5 without any). Repeated rows score alike. Rows with a null id are
scored, not learned from, and not held out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .shingles import MULTIPLIERS, mix, word_places

PASSAGE_WORDS = 100
SAMPLE_DOCS, SAMPLE_WORDS = 4000, 10_000_000
CUTOFF = 0.7
BUCKETS, EMBEDDING, HIDDEN, GATES = 4096, 12, 16, 8


def _flags(chars: str | bytes | range) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars if isinstance(chars, (bytes, range)) else chars.encode())] = 1
    return out


CLASSES = [_flags(range(65, 91)), _flags("#*$%&|<>"), _flags(range(48, 58)), _flags(".,;:?'\"()-"), _flags("!"), _flags(range(0xC0, 0x100)), _flags("\n")]
COUNTS = len(CLASSES) + 5


def encode(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, one row of COUNTS for each passage)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    starts, ends, h = word_places(raw.lower())
    n = len(h)
    if not n:
        return np.zeros(0, np.uint16), np.zeros((0, COUNTS), np.float32)
    data = np.frombuffer(raw, np.uint8)
    count = np.diff(np.concatenate([np.arange(0, n, PASSAGE_WORDS), [n]])).astype(np.float32)
    p = len(count)
    out = np.empty((p, COUNTS), np.float32)
    for k, c in enumerate(CLASSES):
        out[:, k] = np.add.reduceat(c[data], starts[::PASSAGE_WORDS]) / count
    passage = np.arange(n) // PASSAGE_WORDS
    lengths = (ends - starts).astype(np.float32)
    k = len(CLASSES)
    mean = np.bincount(passage, lengths, p) / count
    out[:, k] = mean
    out[:, k + 1] = np.sqrt(np.maximum(0, np.bincount(passage, lengths * lengths, p) / count - mean * mean))
    _, ids = np.unique(h, return_inverse=True)
    distinct = np.unique(passage * (int(ids.max()) + 1) + ids) // (int(ids.max()) + 1)
    out[:, k + 2] = np.bincount(distinct, minlength=p) / count
    seen = np.zeros(p)
    if n >= 3:
        windows = mix(h[:-2] * MULTIPLIERS[0] + h[1:-1] * MULTIPLIERS[1] + h[2:] * MULTIPLIERS[2])
        again = np.ones(n - 2, bool)
        again[np.unique(windows, return_index=True)[1]] = False
        seen = np.bincount(passage[:-2], again, p)
    out[:, k + 3] = seen / count
    out[:, k + 4] = np.log1p(count)
    return (h >> np.uint64(52)).astype(np.uint16), out


class Bags:
    """Encoded documents side by side: words, passages (first word, counts), documents (first passage)."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]]):
        words = np.array([len(w) for w, _ in docs], np.int64)
        sizes = np.array([len(x) for _, x in docs], np.int64)
        self.words = np.concatenate([w for w, _ in docs]).astype(np.int64)
        self.counts = np.concatenate([x for _, x in docs]).astype(np.float64)
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.bag = np.repeat(np.arange(len(docs)), sizes)
        place = np.arange(len(self.bag)) - self.first[self.bag]
        base = np.concatenate([[0], np.cumsum(words)[:-1]])
        self.first_word = base[self.bag] + place * PASSAGE_WORDS
        self.n_words = np.diff(np.concatenate([self.first_word, [len(self.words)]]))


class Model:
    """Gated attention over passages that are encoded by word embeddings and a tanh layer, then a logistic score."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(COUNTS), np.ones(COUNTS)
        self.p = {
            "E": rng.normal(0, 0.5, (BUCKETS, EMBEDDING)), "W": rng.normal(0, 0.3, (EMBEDDING + COUNTS, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": rng.normal(0, 0.3, (HIDDEN, GATES)), "U": rng.normal(0, 0.3, (HIDDEN, GATES)), "w": rng.normal(0, 0.3, GATES), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
        }
        self.prior: float | None = 0.5  # the score, where nothing was learned

    def _forward(self, x: Bags):
        p = self.p
        said = np.add.reduceat(p["E"][x.words], x.first_word, axis=0) / x.n_words[:, None]
        x_ = np.hstack([said, np.clip((x.counts - self.mean) / self.scale, -8, 8)])
        h = np.tanh(x_ @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, x.first)[x.bag])
        a = e / np.add.reduceat(e, x.first)[x.bag]
        z = np.add.reduceat(a[:, None] * h, x.first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return x_, h, v, u, a, z, y

    def gradients(self, x: Bags, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        x_, h, v, u, a, z, y = self._forward(x)
        p, g = self.p, {}
        dy = (y - labels) / len(labels)
        g["c"], g["d"] = z.T @ dy, dy.sum(keepdims=True)
        dz = dy[:, None] * p["c"]
        da = (dz[x.bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, x.first)[x.bag])
        g["w"] = (v * u).T @ de
        dv, du = de[:, None] * p["w"] * u * (1 - v * v), de[:, None] * p["w"] * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = (a[:, None] * dz[x.bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        g["W"], g["b"] = x_.T @ dh, dh.sum(axis=0)
        said = (dh @ p["W"][:EMBEDDING].T) / x.n_words[:, None]
        each = np.repeat(said, x.n_words, axis=0)
        g["E"] = np.stack([np.bincount(x.words, each[:, k], BUCKETS) for k in range(EMBEDDING)], axis=1)
        return g

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """0 for documents without words."""
        out = np.zeros(len(docs))
        full = [i for i, (w, _) in enumerate(docs) if len(w)]
        if full:
            out[full] = self.prior if self.prior is not None else self._forward(Bags([docs[i] for i in full]))[-1]
        return out

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 5, batch: int = 128, rate: float = 0.02, decay: float = 1e-4) -> Model:
        labels = np.asarray(labels, np.float64)
        if not len(labels):
            return self
        if labels.min() == labels.max():
            self.prior = float(labels.mean())
            return self
        self.prior = None
        x = np.concatenate([c for _, c in docs]).astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order, step = np.random.default_rng(11), 0
        epochs = max(epochs, 100 // max(1, len(docs) // batch))  # few documents take more rounds
        for _ in range(epochs):
            for some in np.array_split(order.permutation(len(docs)), max(1, len(docs) // batch)):
                step += 1
                g = self.gradients(Bags([docs[i] for i in some]), labels[some])
                for k, at in self.p.items():
                    grad = g[k] + decay * at
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad * grad
                    self.p[k] = at - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Model:
    """labels: rows to learn from."""
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("id", "y")
    some = known.orderBy(F.xxhash64("id"), "id").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [encode(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch(
                [b.column(0).cast(pa.string()), b.column(1), pa.array([len(w) for w, _ in both], pa.int64()), pa.array([w.tobytes() for w, _ in both], pa.binary()), pa.array([c.tobytes() for _, c in both], pa.binary())],
                ["id", "y", "n", "words", "counts"])

    # the sample has at most sample_docs rows of an id and a label, so it is broadcast
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t")).join(F.broadcast(some), "id").select("id", "y", "t")
    rows = map_arrow(texts, run, "id string, y int, n long, words binary, counts binary").filter("n > 0")
    rows = cut(rows.groupBy("id").agg(F.min(F.struct("n", "y", "words", "counts")).alias("x")).select("id", "x.*"))  # of repeated ids one
    left, take = sample_words, []
    for r in rows.select("id", "n").orderBy(F.xxhash64("id"), "id").collect():  # at most sample_docs
        if r["n"] <= left:
            left -= r["n"]
            take.append(r["id"])
    held = sorted(rows.filter(F.col("id").isin(take)).collect(), key=lambda r: r["id"])  # at most sample_words
    return Model().fit([(np.frombuffer(r["words"], np.uint16), np.frombuffer(r["counts"], np.float32).reshape(-1, COUNTS)) for r in held], np.array([r["y"] for r in held]))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                yield pa.record_batch([part.column(0), pa.array(m.scores([encode(t) for t in part.column(1).to_pylist()]))], ["id", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
