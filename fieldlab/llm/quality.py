"""Quality by random-indexing word vectors and a small calibrated network.

Every run of letters, digits or other signs of a text is a token, hashed to one of ``ROWS``
rows.  Over all documents, a row's vector sums the sparse random index vectors of the
tokens within ``WINDOW`` places; the sums are a table of fixed size, kept per task and
added up by row ranges.  A document is the mean and the spread of its tokens' unit vectors;
a two-layer network, trained with numpy on a bounded sample of labelled rows, scores it,
and a temperature fitted on a part of that sample calibrates the probabilities.

Word vectors cover every whole text.  Only the network's sample is bounded (``max_rows``).
Summing whole numbers makes the vectors independent of the order of tasks.

Cases: null and empty texts have zero vectors and get the network's score for those; labels
that are null or of unknown documents are ignored; without labels of both kinds every score
is the share of 1 among the labels, or 0 without any; empty tables work; repeated documents
and extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .exchange import pack, unpack
from .toxicity import held_out, labelled_sample

ROWS, WIDTH, WINDOW, SLICES = 1 << 15, 32, 2, 16


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, second hash, where each document's tokens begin)."""
    starts, ends, _, begins = tk.pieces(data, offsets)
    h = tk.span_hash(data, starts, ends)
    return (h >> np.uint64(49)).astype(np.int64), (h & np.uint64((1 << 40) - 1)).astype(np.int64), begins


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ROWS * WIDTH, np.int64)
    for batch in batches:
        for _, _, data, offs in tk.chunks(batch, "text"):
            row, extra, begins = tokens(data, offs)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(begins))
            plus, minus = extra % WIDTH, (extra // WIDTH) % WIDTH
            up, down = [], []
            for gap in range(1, WINDOW + 1):
                if len(row) <= gap:
                    continue
                same = doc[:-gap] == doc[gap:]
                a, b = row[:-gap][same] * WIDTH, row[gap:][same] * WIDTH
                up += [a + plus[gap:][same], b + plus[:-gap][same]]
                down += [a + minus[gap:][same], b + minus[:-gap][same]]
            if up:
                total += np.bincount(np.concatenate(up), minlength=len(total))
                total -= np.bincount(np.concatenate(down), minlength=len(total))
    parts = total.reshape(SLICES, -1)
    some = [k for k in range(SLICES) if parts[k].any()]
    yield _sums(some, [TaskContext.get().partitionId()] * len(some), [parts[k] for k in some])


def _sums(slices: list[int], parts: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(parts, pa.int64()), pa.array([pack(s.astype("<i8")) for s in sums], pa.binary())], ["slice", "part", "sums"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by slice and part, of which equal ones stand together."""
    key: tuple[int, int] | None = None
    held = np.zeros(0, np.int64)
    for batch in batches:
        for k, part, raw in zip(*(batch.column(c).to_pylist() for c in ("slice", "part", "sums")), strict=True):
            more = unpack(raw, "<i8")
            if (k, part) == key:
                held = held + more
                continue
            if key is not None:
                yield _sums([key[0]], [key[1]], [held])
            key, held = (k, part), more
    if key is not None:
        yield _sums([key[0]], [key[1]], [held])


#: How many tasks' sums one task adds up, and how often before all that is left is added.
FAN, LEVELS = 64, 2


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors (ROWS, WIDTH): 4 MB, whatever the table's size.  The tasks' sums are
    added up in a tree, so no task reads those of all."""
    schema = "slice long, part long, sums binary"
    rows = docs.select("text").mapInArrow(_add, schema)
    for level in range(LEVELS + 1):
        part = F.floor(F.col("part") / FAN) if level < LEVELS else F.lit(0).cast("long")
        rows = rows.withColumn("part", part).repartition("slice", "part").sortWithinPartitions("slice", "part").mapInArrow(_merge, schema)
    table = np.zeros((SLICES, ROWS * WIDTH // SLICES))
    for r in rows.collect():
        table[r.slice] = unpack(bytes(r.sums), "<i8")
    table = table.reshape(ROWS, WIDTH)
    common = table.sum(axis=0)
    seen = np.abs(table).sum(axis=1)
    share = table / np.maximum(seen, 1)[:, None] - common / max(np.abs(common).sum(), 1.0)
    return (share / np.maximum(np.linalg.norm(share, axis=1), 1e-9)[:, None] * (seen > 0)[:, None]).astype(np.float32)


def pool(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, 2 * WIDTH + 2): mean and spread of each document's tokens, how alike
    neighbours are, and log length."""
    row, _, begins = tokens(data, offsets)
    n = np.diff(begins)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), 2 * WIDTH + 2))
    if len(some):
        v = vectors[row]
        at = begins[:-1][some]
        mean = np.add.reduceat(v, at, axis=0, dtype=np.float64) / n[some, None]
        square = np.add.reduceat(v * v, at, axis=0, dtype=np.float64) / n[some, None]
        out[some, :WIDTH], out[some, WIDTH:-2] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
        near = np.zeros(len(row))
        near[1:] = np.einsum("ij,ij->i", v[1:], v[:-1])
        near[at] = 0
        out[some, -2] = np.add.reduceat(near, at) / n[some]
    out[:, -1] = np.log1p(n)
    return out


def _features(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, 2 * WIDTH + 2))
            for lo, hi, data, offs in tk.chunks(batch, "text"):
                found[lo:hi] = pool(vectors, data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([f.astype("<f4").tobytes() for f in found], pa.binary())], ["doc_id", "label", "features"])

    return run


class Network:
    """tanh hidden layer, logistic output, Adam, temperature."""

    def __init__(self, prior: float = 0.0):
        self.prior, self.layers, self.temperature = prior, None, 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -35, 35)))

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = 16, epochs: int = 60, batch: int = 64, rate: float = 5e-3, decay: float = 1e-4) -> Network:
        self.prior = float(y.mean()) if len(y) else 0.0
        if len(np.unique(y)) < 2:
            return self
        rng = np.random.default_rng(17)
        aside = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
        tx, ty = x[~aside], y[~aside]
        mean, scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
        z = (tx - mean) / scale
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.array(0.0)]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for k in range(0, len(z), batch):
                b = order[k : k + batch]
                h = np.tanh(z[b] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -35, 35))) - ty[b]) / len(b)
                gh = np.outer(g, p[2]) * (1 - h * h)
                grads = [z[b].T @ gh + decay * p[0], gh.sum(axis=0), h.T @ g + decay * p[2], g.sum()]
                t += 1
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.layers = (mean, scale, *p)
        if aside.any():
            logit, truth = self.logit(x[aside]), y[aside]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.mean(np.logaddexp(0, -np.where(truth == 1, logit, -logit) / s)) for s in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = 12_000, vectors: np.ndarray | None = None) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs) if vectors is None else vectors
    rows = labelled_sample(docs, labels, target, max_rows).mapInArrow(_features(vectors), "doc_id long, label int, features binary").collect()
    rows.sort(key=lambda r: (r.doc_id * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, bytes(r.features)))
    x = np.array([np.frombuffer(bytes(r.features), "<f4") for r in rows], np.float64).reshape(len(rows), 2 * WIDTH + 2)
    return vectors, Network().fit(x, np.array([r.label for r in rows], np.float64))


def _score(vectors: np.ndarray, network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for lo, hi, data, offs in tk.chunks(batch, "text"):
                found[lo:hi] = network.score(pool(vectors, data, offs).astype(np.float32).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    vectors, network = fit(docs, labels)
    out = docs.select("doc_id", "text").mapInArrow(_score(vectors, network), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
