"""Token-id output: Re-Pair grammar blocks with random-access decoding.

A *block* holds the ids of consecutive documents.  Frequent adjacent id pairs are
replaced by new symbols ("nonterminals"), round after round until no pair is frequent; the
block stores the rules,
each symbol's expansion length and an index of documents, so one document is decoded
without the rest of the block.  A pair never spans two documents.

Layout of a block, little-endian: magic ``RPG1``; seven uint32 (documents, ids, rules,
rounds, sequence length, first nonterminal, bytes a symbol takes); then rules a round
(uint32 x rounds), rules (2 uint32 each), expansion lengths (uint32 a rule), document ids
(int64), a null flag per id (uint8), documents' id counts (uint32), documents' positions in
the sequence (uint32), the sequence (2, 3 or 4 bytes a symbol).

Cases: a null text is an empty one and yields only the end id; null ids come first, as in
Spark's ascending order; repeated rows are kept and are ordered by text among equal ids;
an empty table gives no blocks and no rows; other columns of the input are ignored; a text
longer than a block makes a block of its own.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bytes_of, partitions, scratch

MAGIC = b"RPG1"
HEADER = struct.Struct("<7I")
END_ID = 1
#: Distinct words a worker keeps ids of; beyond it the store starts again.
VOCABULARY_WORDS = 1 << 21
#: Bytes of text encoded together: arrays that stay in a core's cache.
ENCODE_CHUNK = 1 << 18
_CUT_KIND = tk.KIND.copy()
_CUT_KIND[128:] = 0
_CUT_KIND[[ord(c) for c in "'<|>"]] = 0


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first eight, last eight) of spans: all there is of up to 16 bytes; of longer
    ones the last is a hash of 64 bits independent of ``span_hash``."""
    n = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    wide = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    short = np.minimum(n, 8)
    head, tail = wide[starts] & tk._MASK[short], wide[ends - short] & tk._MASK[short]
    for k in np.flatnonzero(n > 16).tolist():
        tail[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), 1)
    return n.astype(np.int32), head, tail


class WordEncoder:
    """ids of whole texts, each distinct unit (a word or a part of one) encoded once.

    A unit is found by hash and then held against its own bytes; where another unit has its
    hash, it gets the next one.

    Units are words, cut further between an ASCII letter, digit or sign and a neighbour of
    another of these kinds, except next to ``'<|>``.  That is correct for tokenizers whose
    normaliser and pre-tokenizer never look across such places and drop white space, which
    ``tests/llm/test_repair.py`` holds against whole-text encoding.  ``fold`` says that the
    normaliser lower-cases, so units may be folded first.  ``mark`` is a special token that
    keeps the units of one call apart.
    """

    def __init__(self, path: str, fold: bool = True, mark: str = "<|startoftext|>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fold, self.mark, self.mark_id = fold, mark, self.tokenizer.token_to_id(mark)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(2 * VOCABULARY_WORDS, -1, np.int32)  # open addressing
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)
        self.bytes, self.head, self.tail = np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's unit, or -1."""
        top, shift = len(self.slots), np.uint64(64 - (len(self.slots) - 1).bit_length())
        found = np.full(len(hashes), -1, np.int64)
        if not len(self.keys):
            return found
        place = (hashes >> shift).astype(np.int64)
        unit = self.slots[place]
        good = (unit >= 0) & (self.keys[unit] == hashes)
        found[good] = unit[good]
        todo = np.flatnonzero(~good & (unit >= 0))
        place = place[todo]
        while len(todo):
            place = (place + 1) % top
            unit = self.slots[place]
            good = (unit >= 0) & (self.keys[unit] == hashes[todo])
            found[todo[good]] = unit[good]
            more = ~good & (unit >= 0)
            todo, place = todo[more], place[more]
        return found

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, ids per unit)."""
        encode = lambda text: np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        if all(map(str.isalpha, units)):  # one pre-token each, whose last id ends a word
            flat = encode(" ".join(units))
            stops = np.flatnonzero(self.closes[flat])
            if len(stops) == len(units) and stops[-1] == len(flat) - 1:
                return flat, np.diff(stops, prepend=-1)
        if not any(self.mark in u for u in units):
            flat = encode(self.mark.join(units))
            stops = np.append(np.flatnonzero(flat == self.mark_id), len(flat))
            return flat[flat != self.mark_id], np.diff(stops, prepend=-1) - 1
        parts = [encode(u) for u in units]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _learn(self, keys: np.ndarray, units: list[str], own: list[np.ndarray]) -> None:
        plain = np.fromiter(map(str.isalpha, units), bool, len(units))
        order = np.argsort(~plain, kind="stable")
        cut = int(plain.sum())
        flats, sizes = [], []
        for lo, hi in ((0, cut), (cut, len(units))):
            for k in range(lo, hi, 4096):
                flat, size = self._encode_units([units[i] for i in order[k : min(k + 4096, hi)].tolist()])
                flats.append(flat)
                sizes.append(size)
        keys, flat, size = keys[order], np.concatenate(flats), np.concatenate(sizes)
        n = len(self.keys)
        self.at = np.concatenate([self.at, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.flat = np.concatenate([self.flat, flat])
        self.keys = np.concatenate([self.keys, keys])
        self.bytes, self.head, self.tail = (np.concatenate([x, y[order]]) for x, y in zip((self.bytes, self.head, self.tail), own, strict=True))
        place = (keys >> np.uint64(64 - (len(self.slots) - 1).bit_length())).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.slots[place] < 0
            _, first = np.unique(place[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slots[place[put]] = n + todo[put]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, place = todo[left], (place[left] + 1) % len(self.slots)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and where each document's units begin (n_docs + 1)."""
        starts, ends, _ = tk.words(data, offsets)
        kind = _CUT_KIND[data]
        cut = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        cut = np.flatnonzero(cut) + 1
        edge = np.zeros(len(data) + 1, bool)
        edge[starts], edge[cut] = True, True
        out = np.flatnonzero(edge)
        stop = np.zeros(len(data) + 1, bool)
        stop[ends], stop[cut] = True, True
        # a document boundary inside a run of text starts a word already, so cuts there coincide
        return out, np.flatnonzero(stop), np.searchsorted(out, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per document) of a chunk, each document closed by END_ID."""
        starts, ends, begins = self.units(data, offsets)
        fold = self.fold and b"<|" not in data.tobytes()  # special tokens heed case
        seen = tk.LOWER[data] if fold else data
        hashes, own = tk.span_hash(seen, starts, ends), spelled(seen, starts, ends)
        while True:
            unit = self._find(hashes)
            missing = np.flatnonzero(unit < 0)
            if len(missing):
                new, first = np.unique(hashes[missing], return_index=True)
                if len(self.keys) + len(new) > VOCABULARY_WORDS and len(self.keys):
                    self.clear()
                    return self.encode(data, offsets)
                which = missing[first]
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
                self._learn(new, texts, [x[which] for x in own])
                unit[missing] = self._find(hashes[missing])
            same = (self.bytes[unit] == own[0]) & (self.head[unit] == own[1]) & (self.tail[unit] == own[2])
            other = np.flatnonzero(~same)
            if not len(other):
                break
            hashes[other] = tk.mix(hashes[other] + np.uint64(1))
        # a slot for the end id after the last unit of each document
        n_docs, n = len(offsets) - 1, len(unit)
        size = np.ones(n + n_docs, np.int32)
        at = np.zeros(n + n_docs, np.int32)
        place = np.arange(n) + np.repeat(np.arange(n_docs), np.diff(begins))
        size[place], at[place] = self.size[unit], self.at[unit]
        stop = np.cumsum(size, dtype=np.int32 if n < 1 << 24 else np.int64)
        source = np.repeat(at - (stop - size), size)
        source += np.arange(len(source), dtype=source.dtype)
        flat = self.flat if len(self.flat) else np.zeros(1, np.int32)
        ids = flat.take(source, mode="clip")
        ends_at = stop[begins[1:] + np.arange(n_docs)]
        ids[ends_at - 1] = END_ID
        return ids, np.diff(ends_at, prepend=0)


#: Slots that pairs are counted in by hash before any of them is counted exactly.
PAIR_SLOTS = 18


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - PAIR_SLOTS)


def repair(ids: np.ndarray, lengths: np.ndarray, rounds: int | None = None, top: int = 8192, least: int = 8) -> tuple[np.ndarray, np.ndarray, list[int], int, np.ndarray]:
    """(sequence, rules, rules a round, first nonterminal, symbols per document).

    A round takes the ``top`` slots of most pairs by hash (and those as full as the last of
    them) and replaces, by exact counts, the most frequent pair of each; without ``rounds``,
    rounds follow until no pair stands ``least`` times.  Only *open* places are counted: a
    pair without new symbols never becomes more frequent, so the places of a rare one are
    closed until a neighbour is replaced.
    """
    seq = ids.astype(np.uint32)
    base = first = int(seq.max()) + 1 if len(seq) else 0
    last = np.zeros(len(seq), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules: list[np.ndarray] = []
    per_round: list[int] = []
    at = np.flatnonzero(~last)  # a pair at the last place would span two documents
    while rounds is None or len(per_round) < rounds:
        slot = _slot(seq[at], seq[at + 1])
        total = np.bincount(slot, minlength=1 << PAIR_SLOTS)
        often = (total >= least)[slot]
        if 4 * np.count_nonzero(often) < 3 * len(at):
            at, slot = at[often], slot[often]
        full = total[total >= least]
        for floor in (int(np.partition(full, -top)[-top]) if len(full) > top else least, least):
            near = np.flatnonzero((total >= floor)[slot])
            put = at[near]
            code = (seq[put].astype(np.int64) << 32) | seq[put + 1]
            ranked = np.sort(code)
            starts = np.flatnonzero(np.diff(ranked, prepend=-1))
            counts = np.diff(starts, append=len(ranked))
            often = (counts >= least) & (2 * counts > floor)
            pairs, counts = ranked[starts[often]], counts[often]
            if 2 * len(pairs) >= top:
                break  # else the slots are full of rare pairs: look at all that may be frequent
        if not len(pairs):
            break
        if len(pairs) > top:
            often = counts >= np.partition(counts, -top)[-top]
            pairs, counts = pairs[often], counts[often]
        # a slot stands for its most frequent pair; another pair in it waits for a later round
        order = np.argsort(counts, kind="stable")
        index = np.full(1 << PAIR_SLOTS, -1, np.int32)
        index[_slot((pairs[order] >> 32).astype(np.uint32), pairs[order].astype(np.uint32))] = order
        rank = index[slot[near]]
        fits = (pairs[rank] == code) & (rank >= 0)
        put, rank = put[fits], rank[fits]
        # of overlapping pairs every other one, from the left
        fresh = np.diff(put, prepend=-2) != 1
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(put)), 0))
        take = (np.arange(len(put)) - start) % 2 == 0
        put, rank = put[take], rank[take]
        used = np.zeros(len(pairs), bool)  # a pair may lose all its places to its neighbours
        used[rank] = True
        pairs, rank = pairs[used], (np.cumsum(used) - 1)[rank]
        seq[put] = base + rank
        last[put] |= last[put + 1]
        open_ = np.zeros(len(seq), bool)
        open_[at] = True
        open_[put] = True
        open_[put[put > 0] - 1] = True
        keep = np.ones(len(seq), bool)
        keep[put + 1] = False
        seq, last = seq[keep], last[keep]
        at = np.flatnonzero(open_[keep] & ~last)
        rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1))
        per_round.append(len(pairs))
        base += len(pairs)
    ends = np.flatnonzero(last) + 1
    symbols = np.zeros(len(lengths), np.int64)
    symbols[lengths > 0] = np.diff(ends, prepend=0)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), per_round, first, symbols


def write_block(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, **how) -> bytes:
    seq, rules, per_round, first, symbols = repair(ids, lengths, **how)
    size = np.ones(first + len(rules), np.int64)
    done = 0
    for n in per_round:  # a round's rules are of symbols of rounds before
        size[first + done : first + done + n] = size[rules[done : done + n]].sum(axis=1)
        done += n
    width = 2 if first + len(rules) <= 1 << 16 else 3 if first + len(rules) <= 1 << 24 else 4
    packed = seq.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)[:, :width]
    return b"".join([
        MAGIC, HEADER.pack(len(doc_ids), len(ids), len(rules), len(per_round), len(seq), first, width),
        np.array(per_round, "<u4").tobytes(), rules.astype("<u4").tobytes(), size[first:].astype("<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        lengths.astype("<u4").tobytes(), (np.cumsum(symbols) - symbols).astype("<u4").tobytes(), np.ascontiguousarray(packed).tobytes(),
    ])


class Block:
    """A stored block; ``ids()`` decodes it whole, ``document(k)`` one document alone."""

    def __init__(self, stored: bytes):
        if stored[:4] != MAGIC:
            raise ValueError("not a grammar block")
        self.n_docs, self.n_ids, n_rules, n_rounds, n_seq, self.first, width = HEADER.unpack_from(stored, 4)
        at = 4 + HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(stored, kind, n, at)
            at += out.nbytes
            return out

        self.per_round, self.rules, self.sizes = take("<u4", n_rounds), take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        ids, null = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.lengths, self.starts = take("<u4", self.n_docs).astype(np.int64), take("<u4", self.n_docs).astype(np.int64)
        wide = np.zeros((n_seq, 4), np.uint8)
        wide[:, :width] = take("u1", n_seq * width).reshape(-1, width)
        self.seq = wide.view("<u4").ravel()

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        top = self.first + len(self.rules)
        for n in self.per_round[::-1].tolist():
            low = top - n
            rule = seq >= low
            at = np.cumsum(np.where(rule, 2, 1)) - np.where(rule, 2, 1)
            out = np.empty(len(seq) + int(rule.sum()), np.uint32)
            out[at] = seq
            pairs = self.rules[seq[rule] - self.first]
            out[at[rule]], out[at[rule] + 1] = pairs[:, 0], pairs[:, 1]
            seq, top = out, low
        return seq

    def ids(self) -> np.ndarray:
        """All ids: each rule is expanded once, a round after those it is made of."""
        top = self.first
        size = np.append(np.ones(top, np.int64), self.sizes)
        at = np.cumsum(size) - size
        flat = np.arange(size.sum(), dtype=np.uint32)

        def spell(symbols: np.ndarray) -> np.ndarray:
            n = size[symbols]
            stop = np.cumsum(n)
            source = np.repeat(at[symbols] - (stop - n), n)
            source += np.arange(len(source))
            return flat[source]

        for n in self.per_round.tolist():
            found = spell(self.rules[top - self.first : top - self.first + n].ravel())
            flat[at[top] : at[top] + len(found)] = found
            top += n
        return spell(self.seq)

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < self.n_docs else len(self.seq)
        return self._expand(self.seq[self.starts[k] : end])

    def id_at(self, k: int, position: int) -> int:
        """The id at a position of document k, walking down the rules by expansion length."""
        if not 0 <= position < self.lengths[k]:
            raise IndexError(position)
        size = lambda s: 1 if s < self.first else int(self.sizes[s - self.first])
        at = int(self.starts[k])
        while position >= (n := size(int(self.seq[at]))):
            position, at = position - n, at + 1
        symbol = int(self.seq[at])
        while symbol >= self.first:
            a, b = self.rules[symbol - self.first].tolist()
            symbol, position = (a, position) if position < size(a) else (b, position - size(a))
        return symbol


_encoders: dict[str, WordEncoder] = {}

#: Bytes of text in a shard, at most on average.
SHARD_BYTES = 64 << 20

STORED = "shard int, block int, n_docs long, n_ids long, data binary"


def _encode_partition(path: str, block_ids: int, rounds: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.keep_heap()
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        shard, block = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids, lengths = np.concatenate(parts), np.concatenate(sizes)
            data = write_block(doc_ids, ids, lengths, rounds=rounds)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for lo, hi, data, offs in tk.chunks(batch, "text", ENCODE_CHUNK):
                ids, n = encoder.encode(data, offs)
                doc_ids += names[lo:hi]
                parts.append(ids)
                sizes.append(n)
                held += len(ids)
                if held >= block_ids:
                    yield flush()
                    block, held, doc_ids, parts, sizes = block + 1, 0, [], [], []
        if doc_ids:
            yield flush()

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, shards: int | None = None, block_ids: int = 1 << 20, rounds: int | None = None) -> str:
    """Encode docs(doc_id, text) with the tokenizer file and write grammar blocks in
    ascending doc_id order; returns where they are."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-ids")
    shards = shards or max(partitions(spark), -(-bytes_of(docs, "text") // SHARD_BYTES))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode_partition(tokenizer, block_ids, rounds), STORED).write.option("compression", "zstd").parquet(path)
    return path


def _read_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tk.keep_heap()
    for batch in batches:
        for shard, block, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "data")), strict=True):
            b = Block(data)
            raw = b.ids().astype("<u4").tobytes()
            cut = np.append(0, np.cumsum(b.lengths)) * 4
            view = memoryview(raw)
            crc = [zlib.crc32(view[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * b.n_docs, pa.int32()), "block": pa.array([block] * b.n_docs, pa.int32()), "doc_id": pa.array(b.doc_ids, pa.int64()), "at": pa.array(cut[:-1] // 4), "n_tokens": pa.array(b.lengths), "ids_crc32": pa.array(crc, pa.int64())})


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the blocks at path.

    ``start`` is a prefix sum in two levels: over blocks within a shard, then over the
    shards' totals, of which there is one row a shard.
    """
    blocks = spark.read.schema(STORED).parquet(path)
    sizes = blocks.select("shard", "block", "n_ids")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n_ids").over(upto), F.lit(0)).alias("shard_at"))
    sizes = sizes.select("shard", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("block_at")).join(shards, "shard")
    rows = blocks.select("shard", "block", "data").mapInArrow(_read_partition, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(sizes, ["shard", "block"]).select("doc_id", (F.col("shard_at") + F.col("block_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
