"""Ranked lexical search over dual-sorted wavelet trees.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z
lower-cased.  A document's score for an item sums, over the item's terms with repeats, the
term's weight times the term's *impact* on the document, an integer that grows with its
frequency there and falls with the document's length.

* ``build`` makes one index row a *shard* of about ``SHARD_BYTES`` of whole texts: every
  term's postings ordered by impact, highest first, laid end to end, and over the sequence of
  their document numbers a wavelet tree, level by level.  Splitting a level by one bit of the
  number is stable, so in every subtree a term's postings are still ordered by impact, while
  the subtree itself is a range of documents: the index is sorted both ways.
* ``search`` walks each shard's tree best first.  A node is a range of documents and, for
  each term of the item, a range of postings; its bound is the sum of the terms' weighted
  first impacts, since no document below can have more of any.  Nodes are opened by
  descending bound, the least document first among equals; a node that can't beat the item's
  k-th best so far is dropped, so the k best leaves are exact.  Nodes of many items are opened
  together, as arrays.

The k-th best of one shard is carried to the next one of the same task; the tasks' best are
ranked by a window.  Terms are told apart by 64-bit hashes.

Cases: a null text or one without terms is never found and counts nowhere; items without
terms find nothing; items alike in id and text are one, two texts with one id are ranked each
on its own; equal scores go by ascending doc_id, null ids last; repeated rows are documents of
their own; texts of any length are indexed whole, one longer than a shard in a shard of its
own, in memory that follows its size; an empty table finds nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bytes_of, discard, materialize

SHARD_BYTES = 4 << 20
#: Bytes of item texts that one pass over the index searches for, shipped with its tasks.
ITEM_BYTES = 4 << 20
#: Items whose nodes are held at once, and the first number of nodes that an item opens at once.
ITEM_BLOCK, OPEN = 64, 16

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term of a chunk, and where each document's terms begin (n_docs + 1)."""
    n = len(data)
    solid = IS_TERM[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[:-1]
    edge = edge[edge < n]
    first[edge] |= solid[edge]
    starts = np.flatnonzero(first)
    last = solid
    last[:-1] &= ~solid[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return tk.span_hash(tk.LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for batch in batches:
        for _, _, data, offsets in tk.chunks(batch, "text"):
            solid = IS_TERM[data]
            first = solid.copy()
            first[1:] &= ~solid[:-1]
            edge = offsets[:-1]
            edge = edge[edge < len(data)]
            first[edge] |= solid[edge]
            at = np.searchsorted(np.flatnonzero(first), offsets)
            docs += int((np.diff(at) > 0).sum())
            total += int(at[-1])
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [total]})


def measure(docs: DataFrame) -> tuple[int, int]:
    """The documents with terms, and all their terms."""
    row = docs.select("text").mapInArrow(_measure, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Integer impacts of terms that occur tf times in documents of n terms."""
    m = 25 + (75 * n.astype(np.int64) * docs) // total
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def weight(docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)


INDEX = "docs long, ids array<long>, terms array<long>, starts array<int>, impacts array<int>, bits array<binary>"


def shard(ids: pa.Array, pieces: list[tuple[np.ndarray, np.ndarray]], docs: int, total: int) -> pa.RecordBatch:
    """The index row of whole documents; pieces hold their term hashes and begins."""
    n = np.concatenate([np.diff(b) for _, b in pieces])
    numbers = ids.to_numpy(zero_copy_only=False) if not ids.null_count else ids.fill_null(0).to_numpy()
    rank = np.lexsort((numbers, ids.is_null().to_numpy(zero_copy_only=False)))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    hashes = np.concatenate([h for h, _ in pieces])
    doc = place[np.repeat(np.arange(len(n)), n)]
    order = np.lexsort((doc, hashes))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    tf = np.diff(np.append(at, len(doc)))
    hashes, doc = hashes[at], doc[at]
    gain = impact(tf, n[rank][doc], docs, total) if len(doc) else np.zeros(0, np.int64)
    order = np.lexsort((doc, -gain, hashes))
    hashes, doc, gain = hashes[order], doc[order], gain[order]
    new = np.ones(len(doc), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    starts = np.append(np.flatnonzero(new), len(doc))
    levels = max(1, (len(n) - 1).bit_length())
    bits, now = [], doc
    for level in range(levels):
        bit = (now >> (levels - 1 - level)) & 1 == 1
        bits.append(np.packbits(bit).tobytes())
        now = np.concatenate([now[~bit], now[bit]])
    return pa.RecordBatch.from_arrays([pa.array([len(n)]), pa.array([ids.take(pa.array(rank)).to_pylist()], pa.list_(pa.int64())), pa.array([hashes[starts[:-1]].view(np.int64)], pa.list_(pa.int64())), pa.array([starts.astype(np.int32)], pa.list_(pa.int32())), pa.array([gain.astype(np.int32)], pa.list_(pa.int32())), pa.array([bits], pa.list_(pa.binary()))], ["docs", "ids", "terms", "starts", "impacts", "bits"])


def _shards(docs: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pieces, held = [], [], 0
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch, "text"):
                if pieces and held + len(data) > SHARD_BYTES:
                    yield shard(pa.concat_arrays(ids), pieces, docs, total)
                    ids, pieces, held = [], [], 0
                ids.append(batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()))
                pieces.append(terms(data, offsets))
                held += len(data)
        if pieces:
            yield shard(pa.concat_arrays(ids), pieces, docs, total)

    return run


def build(docs: DataFrame, counts: tuple[int, int]) -> DataFrame:
    """One index row a shard, for all rows of docs(doc_id, text); ``counts`` from ``measure``."""
    return docs.select("doc_id", "text").mapInArrow(_shards(*counts), INDEX)


class Tree:
    """A shard's wavelet tree, opened: for each level how many zeros stand before each posting,
    and the impacts in the level's order."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.terms = np.asarray(row["terms"].values, np.int64).view(np.uint64)
        self.starts = np.asarray(row["starts"].values, np.int64)
        gain = np.asarray(row["impacts"].values, np.int64)
        bits = row["bits"].as_py()
        self.levels, p = len(bits), len(gain)
        self.zeros = np.zeros((self.levels, p + 1), np.int32)
        self.gain = np.zeros((self.levels + 1, p), np.int32)
        self.gain[0] = gain
        for level, raw in enumerate(bits):
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=p).astype(bool)
            np.cumsum(~bit, out=self.zeros[level, 1:])
            now = self.gain[level]
            self.gain[level + 1] = np.concatenate([now[~bit], now[bit]])
        self.docs = len(self.ids)
        #: ids by number, for ties; nulls stand last
        self.order = self.ids.values.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


class Nodes:
    """Tree nodes of some items: one row a node, and its terms' ranges of postings end to end."""

    FIELDS = ("item", "level", "prefix", "bound")

    def __init__(self, item, level, prefix, bound, cut, lo, hi, w):
        self.item, self.level, self.prefix, self.bound, self.cut, self.lo, self.hi, self.w = item, level, prefix, bound, cut, lo, hi, w

    def take(self, keep: np.ndarray) -> Nodes:
        count = np.diff(self.cut)[keep]
        cut = np.append(0, np.cumsum(count))
        flat = np.repeat(self.cut[:-1][keep] - cut[:-1], count) + np.arange(cut[-1])
        return Nodes(*(getattr(self, f)[keep] for f in self.FIELDS), cut, self.lo[flat], self.hi[flat], self.w[flat])

    def __add__(self, other: Nodes) -> Nodes:
        both = (np.concatenate([getattr(self, f), getattr(other, f)]) for f in self.FIELDS)
        return Nodes(*both, np.concatenate([self.cut, other.cut[1:] + self.cut[-1]]), *(np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("lo", "hi", "w")))

    @staticmethod
    def of(tree: Tree, level: np.ndarray, item: np.ndarray, prefix: np.ndarray, owner: np.ndarray, lo, hi, w) -> Nodes:
        """Nodes from ranges whose owner is a row of level, item and prefix; without empty ones."""
        full = lo < hi
        owner, lo, hi, w = owner[full], lo[full], hi[full], w[full]
        rows = np.flatnonzero(np.bincount(owner, minlength=len(level)))
        cut = np.append(np.searchsorted(owner, rows), len(owner))
        gains = np.append(0, np.cumsum(w * tree.gain[level[owner], lo]))
        return Nodes(item[rows], level[rows], prefix[rows], gains[cut[1:]] - gains[cut[:-1]], cut, lo, hi, w)

    def open(self, tree: Tree) -> Nodes:
        """Both children of every node."""
        owner = np.repeat(np.arange(len(self.item)), np.diff(self.cut))
        level = self.level[owner]
        lo, hi = tree.zeros[level, self.lo].astype(np.int64), tree.zeros[level, self.hi].astype(np.int64)
        zeros = tree.zeros[level, -1]
        left = Nodes.of(tree, self.level + 1, self.item, self.prefix * 2, owner, lo, hi, self.w)
        return left + Nodes.of(tree, self.level + 1, self.item, self.prefix * 2 + 1, owner, zeros + self.lo - lo, zeros + self.hi - hi, self.w)


class Best:
    """The k best (score, document) of each item that a task has met."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.doc = np.full((items, k), np.iinfo(np.int64).max)
        self.null = np.zeros((items, k), bool)

    def may_enter(self, item: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document not before ``doc``, of at most this score, could be among them."""
        last, least = self.score[item, -1], self.doc[item, -1]
        return (bound > last) | ((bound == last) & (bound > 0) & (doc < least))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        touched, own = np.unique(item, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(touched)), self.k), own])
        scores = np.concatenate([self.score[touched].ravel(), score])
        docs = np.concatenate([self.doc[touched].ravel(), doc])
        nulls = np.concatenate([self.null[touched].ravel(), null])
        order = np.lexsort((docs, -scores, rows))
        begin = np.searchsorted(rows[order], np.arange(len(touched)))
        chosen = order[begin[:, None] + np.arange(self.k)]
        self.score[touched], self.doc[touched], self.null[touched] = scores[chosen], docs[chosen], nulls[chosen]


def walk(tree: Tree, wanted: list[tuple[np.ndarray, np.ndarray]], first: int, best: Best) -> None:
    """Search one shard for a block of items, the first of which has number ``first``; an item
    is its terms' hashes and weights."""
    counts = [len(h) for h, _ in wanted]
    owner = np.repeat(np.arange(len(wanted)), counts)
    hashes = np.concatenate([h for h, _ in wanted])
    at = np.minimum(np.searchsorted(tree.terms, hashes), len(tree.terms) - 1)
    known = tree.terms[at] == hashes
    zero = np.zeros(len(wanted), np.int64)
    nodes = Nodes.of(tree, zero, np.arange(first, first + len(wanted)), zero, owner[known], tree.starts[at[known]], tree.starts[at[known] + 1], np.concatenate([w for _, w in wanted])[known])
    width, rounds = OPEN, 0
    while len(nodes.item):
        least = tree.order[np.minimum(nodes.prefix << (tree.levels - nodes.level), tree.docs - 1)]
        alive = best.may_enter(nodes.item, nodes.bound, least)
        nodes, least = nodes.take(np.flatnonzero(alive)), least[alive]
        order = np.lexsort((least, -nodes.bound, nodes.item))
        ranked = nodes.item[order]
        place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        opened = nodes.take(order[place < width]).open(tree)
        nodes = nodes.take(order[place >= width])
        done = opened.level == tree.levels
        if done.any():
            leaf = opened.take(np.flatnonzero(done))
            best.add(leaf.item, leaf.bound, tree.order[leaf.prefix], tree.ids.values.is_null().to_numpy(zero_copy_only=False)[leaf.prefix])
            opened = opened.take(np.flatnonzero(~done))
        nodes = nodes + opened
        rounds += 1
        if rounds > tree.levels:
            width *= 2


HITS = "item long, doc_id long, score long"


def _search(items: list[tuple[np.ndarray, np.ndarray]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in ("ids", "terms", "starts", "impacts", "bits")}
                if not len(row["terms"].values):
                    continue
                tree = Tree(row)
                for lo in range(0, len(items), ITEM_BLOCK):
                    walk(tree, items[lo : lo + ITEM_BLOCK], lo, best)
        item, place = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best.doc[item, place], mask=best.null[item, place]), pa.array(best.score[item, place])], ["item", "doc_id", "score"])

    return run


def _count(wanted: np.ndarray):
    """How many documents of the task's shards hold each of the sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                known, starts = (np.asarray(batch.column(c)[r].values) for c in ("terms", "starts"))
                if len(known):
                    known = known.view(np.uint64)
                    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                    df += np.where(known[at] == wanted, starts[at + 1] - starts[at], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(df[some])], ["term", "df"])

    return run


def _items(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct term hashes, repeats) of each item."""
    data, offsets = tk.text_buffers(pa.array(texts, pa.string()))
    hashes, begins = terms(data, offsets)
    return [np.unique(hashes[a:b], return_counts=True) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


def search(index: DataFrame, items: DataFrame, docs_with_terms: int, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of items(item_id, text).

    ``index`` is what ``build`` made, written to the shared folder.  Items are searched for in
    passes of about ``ITEM_BYTES`` of their texts, so what a task is shipped is bounded.
    """
    spark = index.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    passes = max(1, -(-bytes_of(items, "text") // ITEM_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    out = spark.createDataFrame([], "item_id long, item long, doc_id long, score long")
    for p in range(passes):
        rows = items.where(part == p).orderBy("item_id", "text").collect()  # bounded by ITEM_BYTES
        asked = _items([r.text for r in rows])
        if not asked:
            continue
        wanted = np.unique(np.concatenate([h for h, _ in asked]))
        found = index.select("terms", "starts").mapInArrow(_count(wanted), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = np.zeros(len(wanted), np.int64)
        for r in found.collect():  # at most one row a term of this pass
            df[np.searchsorted(wanted, np.array([r.term]).view(np.uint64))[0]] = r.df
        w = weight(docs_with_terms, df)
        ready = [(h, c * w[np.searchsorted(wanted, h)]) for h, c in asked]
        hits = index.select("ids", "terms", "starts", "impacts", "bits").mapInArrow(_search(ready, k), HITS)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item long, item_id long")
        hits = materialize(hits.join(F.broadcast(names), "item").select("item_id", (F.col("item") + (p << 32)).alias("item"), "doc_id", "score"), "hits")
        out = out.union(hits)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best of docs(doc_id, text) for each of items(item_id, text)."""
    counts = measure(docs)
    if not counts[0]:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    index = materialize(build(docs, counts), "index")
    out = search(index, items, counts[0], k)
    discard(index)
    return out
