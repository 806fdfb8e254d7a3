"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the distinct words, word pairs and word pairs with one word between (letters
and digits, A-Z lower-cased) of a whole text, hashed to ``2**BITS`` coordinates.  Training
keeps FTRL's two sums per coordinate, which give each its own rate, and L1 leaves most
weights at exactly 0; what scoring needs is the few others, at most ``2**BITS`` pairs of 12
bytes, so the broadcast has a fixed bound.

The model is fitted on a bounded sample of labelled rows: ``max_rows`` of them with the
least hash of doc_id.  Scoring covers every row and whole texts.

Cases: null and empty texts are scored by the bias alone; rows with null id are scored too
and never held out; labels that are null or of unknown documents are ignored; repeated
label rows count once (the largest label); without any label every score is 0; repeated
documents and extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

BITS = 18


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` training rows, chosen by hash of doc_id.

    The sample of ids is of bounded size and is broadcast, so the documents are scanned but
    never shuffled.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def grams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every n-gram occurrence in a chunk."""
    starts, ends, kinds, _ = tk.pieces(data, offsets)
    of = kinds < 3
    starts, ends = starts[of], ends[of]
    begins = np.searchsorted(starts, offsets)
    h = tk.span_hash(tk.LOWER[data], starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    shift = np.uint64(64 - bits)
    docs, slots = [doc], [h >> shift]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][same])
            slots.append(tk.mix(h[:-gap] * np.uint64(3) + h[gap:] * np.uint64(salt))[same] >> shift)
    return np.concatenate(docs), np.concatenate(slots).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss, one example a step."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def _fit(epochs: int, how: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray, int]] = []
        size = 1 << BITS
        for batch in batches:
            keys, marks = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
            for lo, hi, data, offs in tk.chunks(batch, "text"):
                doc, slot = grams(data, offs)
                pair = np.unique(doc * size + slot)
                cut = np.searchsorted(pair, np.arange(hi - lo + 1) * size)
                for i in range(hi - lo):
                    rows.append((keys[lo + i], np.append(pair[cut[i] : cut[i + 1]] - i * size, size).astype(np.int32), marks[lo + i]))
        rows.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, r[2], len(r[1])))
        model = Ftrl(size, **how)
        for _ in range(epochs if rows else 0):
            for _, at, label in rows:
                model.learn(at, label)
        w = model.weights(np.arange(size + 1))
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([kept.astype("<i4").tobytes()], pa.binary()), pa.array([w[kept].astype("<f8").tobytes()], pa.binary())], ["n_rows", "slots", "weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = 12_000, epochs: int = 3, **how) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows fitted on, coordinates, weights); the last coordinate, 2**BITS, is the bias."""
    sample = labelled_sample(docs, labels, target, max_rows).repartition(1)
    row = sample.mapInArrow(_fit(epochs, how), "n_rows long, slots binary, weights binary").first()
    if row is None:
        return 0, np.zeros(0, np.int32), np.zeros(0)
    return row.n_rows, np.frombuffer(bytes(row.slots), "<i4"), np.frombuffer(bytes(row.weights), "<f8")


def _score(n_rows: int, slots: np.ndarray, weights: np.ndarray, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BITS
        dense = np.zeros(size + 1)
        dense[slots] = weights
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, data, offs in tk.chunks(batch, "text"):
                doc, slot = grams(data, offs)
                of = dense[slot] != 0
                pair = np.unique(doc[of] * size + slot[of])
                logit = dense[size] + np.bincount(pair >> BITS, dense[pair & (size - 1)], hi - lo)
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(logit, -35, 35))) if n_rows else 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: tuple[int, np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The ``keep`` columns of docs and the score as ``name``, for every row."""
    names = [*dict.fromkeys([*keep, "text"])]
    some = docs.select(*names)
    schema = some.withColumn(name, F.lit(0.0)).schema
    return some.mapInArrow(_score(*model, name), schema).select(*keep, name)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
