"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are compared with A-Z lower-cased and every run of white space as one
space.  A region that matches an item of m bytes within k edits shares at least
``m - q + 1 - k * q`` q-grams with it, all on diagonals (place in the text less place in
the item) within k of each other.  Bands of ``2 * k + 1`` diagonals that overlap by k are
counted; bands that reach the bound give regions, which a banded alignment of the item
within the region verifies.  The budget is ``rate`` of the item's bytes, lessened where the
bound would fall below 1; items shorter than q bytes must occur exactly.

Shared q-grams are counted by place, so bands in repetitive texts only ever count too
much; the alignment decides.

The items travel with the plan when they take at most ``BROADCAST_BYTES``; a larger benchmark
is cut into parts of that size, and documents meet one part after the other, with each
part's result written to the shared folder, so no plan holds more than one part.

Hits are looked for in stretches of ``SCAN_BYTES`` and expanded to the places of their
q-grams ``HITS`` at a time, so repetitive and very long texts take no more memory than
others beyond a few times their bytes.

Cases: null and empty texts match nothing; null, empty or blank items are ignored; repeated
documents and repeated items each yield their own rows; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import discard, materialize

Q, RATE = 8, 0.1
BROADCAST_BYTES = 8 << 20
#: Bytes of text whose q-grams are looked up together, and shared places that are counted together.
SCAN_BYTES, HITS = 4 << 20, 1 << 21
#: Bands that are aligned together.
LANES = 2048

SCHEMA = "doc_id long, item_id long, edits int, start long, stop long"


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, runs of white space as one space, none at a document's ends."""
    if not len(data):
        return data, offsets
    space = tk.IS_SPACE[data]
    keep = ~space
    after = np.zeros(len(data), bool)
    after[1:] = space[1:] & ~space[:-1]  # the first of a run stays
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after[edge[:-1]] = False
    # nor the run that ends a document
    solid = np.flatnonzero(keep)
    doc_end = np.searchsorted(solid, offsets[1:])
    last = np.where(doc_end > 0, solid[np.maximum(doc_end - 1, 0)], -1) if len(solid) else np.full(len(offsets) - 1, -1)
    tail = (np.maximum(last, offsets[:-1] - 1) + 1)[offsets[1:] > offsets[:-1]]
    after[tail[tail < len(data)]] = False
    keep |= after
    out = tk.LOWER[data[keep]]
    out[tk.IS_SPACE[out]] = 32
    return out, np.append(0, np.cumsum(keep))[offsets]


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes (at most 8) from every place, as one number each."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) - q + 1,), "<u8", padded, strides=(1,)) & np.uint64((1 << (8 * q)) - 1)


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key of several (keys, counts)."""
    if len(found) == 1:
        return found[0]
    keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([c for _, c in found])).astype(np.int64)


class Items:
    """The q-gram index of a set of items."""

    def __init__(self, ids: list[int], texts: list[bytes], q: int = Q, rate: float = RATE):
        self.q = q
        self.short: list[tuple[int, bytes]] = []
        self.ids: list[int] = []
        self.texts: list[np.ndarray] = []
        for i, t in zip(ids, texts, strict=True):
            x, _ = folded(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
            if len(x) >= q:
                self.ids.append(i)
                self.texts.append(x)
            elif len(x):
                self.short.append((i, x.tobytes()))
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.minimum((rate * self.size).astype(np.int64), (self.size - q) // q)
        self.least = self.size - q + 1 - self.budget * q
        all_grams = [grams(t, q) for t in self.texts]
        flat = np.concatenate(all_grams) if all_grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(self.texts)), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams]) if all_grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.at, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, least diagonal) of every band that reaches its item's bound."""
        none = np.zeros(0, np.int64)
        low = len(data) + 1  # keeps band numbers positive
        span, docs = 2 * low + 2, len(offsets) - 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(data) if len(self.keys) else 0, SCAN_BYTES):
            g = grams(data[lo : lo + SCAN_BYTES + self.q - 1], self.q)
            hit = np.flatnonzero(self.bits[self._slot(g)])
            slot = np.minimum(np.searchsorted(self.keys, g[hit]), len(self.keys) - 1)
            good = self.keys[slot] == g[hit]
            hit, slot = hit[good] + lo, slot[good]
            doc = np.searchsorted(offsets, hit, side="right") - 1
            good = hit + self.q <= offsets[doc + 1]
            hit, slot, doc = hit[good], slot[good], doc[good]
            upto = np.cumsum(self.count[slot])
            at = 0
            while at < len(hit):  # at least one hit at a time
                end = max(at + 1, int(np.searchsorted(upto, HITS + (upto[at - 1] if at else 0), side="right")))
                n = self.count[slot[at:end]]
                entry = np.repeat(self.at[slot[at:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                item = self.item[entry]
                # bands of item i begin every budget + 1 diagonals and are twice as wide
                band = (np.repeat(hit[at:end], n) - self.place[entry] + low) // (self.budget[item] + 1)
                found.append(np.unique((item * docs + np.repeat(doc[at:end], n)) * span + band, return_counts=True))
                if len(found) > 16:
                    found = [_added(found)]
                at = end
        if not found:
            return none, none, none
        unique, count = _added(found)
        above = np.searchsorted(unique, unique + 1)
        leads = (above < len(unique)) & (unique[np.minimum(above, len(unique) - 1)] == unique + 1)
        with_next = count + np.where(leads, count[np.minimum(above, len(unique) - 1)], 0)
        which = unique // span
        item, doc = which // docs, which % docs
        ok = with_next >= self.least[item]
        band = unique[ok] % span
        item, doc = item[ok], doc[ok]
        return doc, item, band * (self.budget[item] + 1) - low

    def verify(self, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, item: np.ndarray, low: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, start, stop) of the bands whose best alignment is within
        budget, places counted in the folded document.  All bands advance together, one byte
        of their items a step; a document that holds an item unchanged needs no alignment."""
        out = []
        raw = data.tobytes()
        exact: dict[tuple[int, int], int] = {}
        for d, i in zip(doc.tolist(), item.tolist(), strict=True):
            if (d, i) not in exact:
                exact[d, i] = raw.find(self.texts[i].tobytes(), int(offsets[d]), int(offsets[d + 1]))
                if exact[d, i] >= 0:
                    start = exact[d, i] - int(offsets[d])
                    out.append((d, i, 0, start, start + int(self.size[i])))
        left = np.array([k for k, pair in enumerate(zip(doc.tolist(), item.tolist(), strict=True)) if exact[pair] < 0], np.int64)
        left = left[np.argsort(-self.size[item[left]], kind="stable")]  # longest items first
        for part in range(0, len(left), LANES):
            some = left[part : part + LANES]
            m, k = self.size[item[some]], self.budget[item[some]]
            # diagonals low - k .. low + 2 * (k + 1) + k; a wider band than a lane's own does no harm
            width, far = 4 * int(k.max()) + 3, int(m.max()) + 1
            base, first, last = (low[some] - k)[:, None], offsets[doc[some]][:, None], offsets[doc[some] + 1][:, None]
            text = np.zeros((int(m.max()), len(some)), np.uint8)
            for lane, i in enumerate(item[some].tolist()):
                text[: self.size[i], lane] = self.texts[i]
            column = np.arange(width)[None, :]
            place = base + column
            # cost[d]: fewest edits to match an item's first r bytes ending at place base + d + r
            cost = np.where((place >= first) & (place <= last), 0, far)
            origin = place.copy()
            alive = np.searchsorted(-m, -np.arange(int(m[0])), side="left")  # lanes whose item has a byte r
            for r in range(int(m[0])):
                n = int(alive[r])
                here, begin, end = place[:n] + r, first[:n], last[:n]
                same = data[np.minimum(np.maximum(here, 0), len(data) - 1)] == text[r, :n, None]
                new = np.where((here >= begin) & (here < end), cost[:n] + ~same, far)
                came = origin[:n].copy()
                # the item's byte without a text byte comes from diagonal d + 1
                skip = cost[:n, 1:] + 1
                better = skip < new[:, :-1]
                new[:, :-1] = np.where(better, skip, new[:, :-1])
                came[:, :-1] = np.where(better, origin[:n, 1:], came[:, :-1])
                # a text byte without the item's comes from diagonals to the left
                new = np.where((here + 1 >= begin) & (here + 1 <= end), new, far)
                score = np.minimum.accumulate((new - column) * width + column, axis=1)
                pick = score % width
                lanes = np.arange(n)[:, None]
                cost[:n] = np.minimum(np.where((here + 1 >= begin) & (here + 1 <= end), new[lanes, pick] + column - pick, far), far)
                origin[:n] = came[lanes, pick]
            best = cost.argmin(axis=1)
            lanes = np.arange(len(some))
            edits = cost[lanes, best]
            start, stop = origin[lanes, best] - first[:, 0], place[lanes, best] + m - first[:, 0]
            for j in np.flatnonzero(edits <= k).tolist():
                out.append((int(doc[some[j]]), int(item[some[j]]), int(edits[j]), int(start[j]), int(stop[j])))
        return out


def find(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The best match (fewest edits, then leftmost) of each item in each document of a chunk:
    (document, item id, edits, start, stop)."""
    data, offsets = folded(data, offsets)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, i, edits, start, stop in items.verify(data, offsets, *items.regions(data, offsets)):
        if (d, i) not in best or (edits, start, stop) < best[d, i]:
            best[d, i] = (edits, start, stop)
    out = [(d, items.ids[i], *v) for (d, i), v in best.items()]
    raw = data.tobytes() if items.short else b""
    for i, text in items.short:
        for d in range(len(offsets) - 1):
            at = raw.find(text, int(offsets[d]), int(offsets[d + 1]))
            if at >= 0:
                out.append((d, i, 0, at - int(offsets[d]), at - int(offsets[d]) + len(text)))
    return sorted(out)


def _scan(ids: list[int], texts: list[bytes], q: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, q, rate)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            rows = []
            for lo, _, data, offs in tk.chunks(batch, "text", 2 * tk.CHUNK_BYTES):
                rows += [(names[lo + d], *rest) for d, *rest in find(items, data, offs)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "start", "stop"])

    return run


def parts_of(benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """The items in parts of at most ``limit`` bytes (or one longer item), in order of id."""
    total = benchmark.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = benchmark.where("text is not null").select("item_id", "text")
    # small benchmarks come at once; larger ones row by row, never whole on the driver
    rows = rows.orderBy("item_id", "text").collect() if total <= limit else rows.orderBy("item_id", "text").toLocalIterator()
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0
    for r in rows:
        raw = r.text.encode()
        if ids and held + len(raw) > limit:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(raw)
        held += len(raw)
    if ids:
        yield ids, texts


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, start, stop): the best match of each item in each document."""
    some = docs.select("doc_id", "text")
    out = None
    for (ids, texts), alone in _whether_alone(parts_of(benchmark)):
        found = some.mapInArrow(_scan(ids, texts, q, rate), SCHEMA)
        found = found if alone else materialize(found, "matches")
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _whether_alone(parts: Iterator) -> Iterator[tuple[tuple[list[int], list[bytes]], bool]]:
    """Each part, and whether it's the only one."""
    first, second = next(parts, None), next(parts, None)
    if first is not None:
        yield first, second is None
    if second is not None:
        yield second, False
    for part in parts:
        yield part, False


def _mark(ids: list[int], texts: list[bytes], q: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, q, rate)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for lo, _, data, offs in tk.chunks(batch, "text", 2 * tk.CHUNK_BYTES):
                clean[[lo + d for d, *_ in find(items, data, offs)]] = False
            yield batch.filter(pa.array(clean))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of docs, with all their columns, that match no item."""
    before = None
    for (ids, texts), alone in _whether_alone(parts_of(benchmark)):
        docs = docs.mapInArrow(_mark(ids, texts, q, rate), docs.schema)
        if not alone:
            docs = materialize(docs, "clean")
            if before is not None:
                discard(before)
            before = docs
    return docs
