"""Substring dedup by repeated-phrase automata.

A window is ``size`` consecutive words of one document.  A window whose words also start in
a document with a smaller id is removed, word by word; windows are judged on the input.

1. A window's *block* is the one of its ``(size + 1) // 2``-word pieces with the least hash,
   so equal windows have equal blocks.  The groups of ``exchange`` learn which blocks more
   than one document id holds; a window of another block can't recur.
2. For the other windows the groups ask for the least document id that holds them, which
   confirms the recurring passages and names their first place.  Windows are told apart by
   96 bits of two independent hashes.
3. Each group compiles the passages that its documents have from elsewhere, or share among
   themselves, into Aho-Corasick automata of at most ``SHARD_WINDOWS`` windows, whose letters
   are words, and streams all of its documents through each.  What an automaton finds, word
   by word, in a document with a larger id than the passage's first is removed.  A group only
   meets passages that it can hold, so work grows with the corpus and not with its square.

Cases: null and empty texts have no words; documents shorter than a window stay whole; rows
with equal ids are one document as far as ids go: a window that occurs in no smaller id
stays, also where the same id repeats it; null ids count as larger than all others; an
empty table gives an empty result; extra columns are ignored; a very long text is a group of
its own, held whole by one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange
from . import textkit as tk

SIZE = 13
NO_ID = np.iinfo(np.int64).max

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Group:
    """Words and windows of a group's documents."""

    def __init__(self, table: pa.Table, size: int):
        column = table.column("doc_id")
        self.ids = column.to_pylist()
        self.size = size
        self.data, self.offsets = tk.text_buffers(tk.as_array(table.column("text")))
        starts, ends, words, counts = [], [], [], []
        n, lo = len(self.offsets) - 1, 0
        while lo < n:  # hash by pieces, which bounds the temporaries
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + tk.CHUNK_BYTES, side="right")) - 1)
            hi = min(hi, n)
            a, b = self.offsets[lo], self.offsets[hi]
            s, e, at = tk.words(self.data[a:b], self.offsets[lo : hi + 1] - a)
            words.append(tk.word_hashes(self.data[a:b], s, e))
            starts.append(s + a)
            ends.append(e + a)
            counts.append(np.diff(at))
            lo = hi
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.starts, self.ends, self.words, self.counts = join(starts, np.int64), join(ends, np.int64), join(words, np.uint64), join(counts, np.int64)
        self.begins = np.append(0, np.cumsum(self.counts))
        self.doc = np.repeat(np.arange(n), self.counts)
        self.key = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.at = np.flatnonzero(tk.within(self.begins, size, len(self.words)))
        self.windows = tk.gram_hashes(self.words, size)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.owner = self.key[self.doc[self.at]]

    def blocks(self) -> np.ndarray:
        """The hash of each window's block."""
        if not len(self.at):
            return self.windows
        piece = (self.size + 1) // 2
        return tk.sliding_min(tk.gram_hashes(self.words, piece), self.size - piece + 1)[self.at]

    def checks(self) -> np.ndarray:
        """A second hash of each window."""
        if not len(self.at):
            return np.zeros(0, exchange.CHECK)
        other = tk.mix(self.words ^ np.uint64(0xA0761D6478BD642F))
        return (tk.gram_hashes(other, self.size)[self.at] >> np.uint64(32)).astype(exchange.CHECK)


#: Blocks: whether more than one document id holds one; 2 stands for more than one.
SHARED = exchange.Question("u1", "u1", lambda values, starts: np.minimum(np.add.reduceat(values.astype(np.uint32), starts), 2).astype("u1"), lambda total: (total > 1).astype("u1"))


def _smaller(hashes: np.ndarray, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only windows that a smaller id than any of the group's holds."""
    some = least < own
    return hashes[some], least[some]


#: Windows: the least document id that holds one.
FIRST = exchange.Question("<i8", "<i8", np.minimum.reduceat, lambda least: least, checked=True, reply=_smaller)


def _runs(ranked: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)


def _ask_blocks(size: int):
    def extract(table: pa.Table) -> exchange.Asked:
        g = Group(table, size)
        blocks = g.blocks()
        order = np.argsort(blocks, kind="stable")  # rows stand in order of id
        ranked, owner = blocks[order], g.owner[order]
        starts = _runs(ranked)
        several = owner[np.append(starts[1:], len(ranked)) - 1] != owner[starts] if len(starts) else np.zeros(0, bool)
        return exchange.Asked(ranked[starts], 1 + several.astype("u1"))

    return extract


def _ask_windows(size: int):
    def extract(table: pa.Table, answers: pa.Table) -> exchange.Asked:
        g = Group(table, size)
        shared = exchange.in_order(answers, SHARED) > 0
        distinct, which = np.unique(g.blocks(), return_inverse=True)
        if len(distinct) != len(shared):
            raise ValueError("answers don't fit the group")
        some = np.flatnonzero(shared[which]) if len(which) else which
        key, check = g.windows[some], g.checks()[some]
        order = np.lexsort((check, key))  # stable: the first of equals has the least id
        key, check = key[order], check[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        return exchange.Asked(key[fresh], g.owner[some][order[fresh]].astype("<i8"), check[fresh])

    return extract


#: Windows in one automaton.
SHARD_WINDOWS = 1 << 18
#: Places at which the passages may hold one block; windows of blocks with more are compiled whole.
BLOCK_PLACES = 4


class Speller:
    """Words of a group's passages as fixed numbers of symbols.

    An automaton's node searches its children one by one, so a word is spelled with a few
    symbols of a small alphabet, another one for each of its places.
    """

    BITS = 5

    def __init__(self, g: Group, told: np.ndarray):
        held = np.zeros(len(g.words) + 1, np.int64)
        np.add.at(held, told, 1)
        np.subtract.at(held, told + g.size, 1)
        letters = np.unique(g.words[np.cumsum(held[:-1]) > 0])
        slot = np.minimum(np.searchsorted(letters, g.words), len(letters) - 1)
        self.known = letters[slot] == g.words
        self.width = max(1, -(-len(letters).bit_length() // self.BITS))
        places = np.arange(self.width)
        self.symbols = ((slot[:, None] >> (self.BITS * places)) & ((1 << self.BITS) - 1)) + (places << self.BITS) + 1
        self.text = self._text(self.symbols)
        self.doc = g.doc

    @staticmethod
    def _text(symbols: np.ndarray) -> str:
        return symbols.astype("<u4").tobytes().decode("utf-32-le")

    def words(self, start: int, n: int) -> str:
        return self.text[start * self.width : (start + n) * self.width]

    def stream(self, automaton, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(last word, value) of all that the automaton finds in the documents, of which
        stretches of fewer than ``least`` words of the passages are passed over."""
        n = len(self.known)
        fresh = np.ones(n, bool)
        fresh[1:] = (self.known[1:] != self.known[:-1]) | (self.doc[1:] != self.doc[:-1])
        begin = np.flatnonzero(fresh)
        long = np.diff(np.append(begin, n)) >= least
        kept = np.flatnonzero(np.repeat(long, np.diff(np.append(begin, n))) & self.known)
        if not len(kept):
            return kept, kept
        cut = np.flatnonzero(fresh[kept])[1:] * self.width
        spaced = np.insert(self.symbols[kept].ravel(), cut, 0)
        found = np.array(list(automaton.iter(self._text(spaced))), np.int64).reshape(-1, 2)
        cut = cut + np.arange(len(cut))
        at = found[:, 0] - np.searchsorted(cut, found[:, 0], side="left")
        return kept[at // self.width], found[:, 1]


def locate(g: Group, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word position, passage) of every occurrence of the windows that start at the words
    ``passages``, found by streaming all documents of the group through their automata.

    Runs of consecutive windows are cut into blocks of half a window, one of which lies in
    every window whatever its place; an automaton holds the blocks.  Around each block found,
    the words are compared with those around its places in the passages.
    """
    order = np.argsort(passages, kind="stable")
    places, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(passages), SHARD_WINDOWS):
        some = order[lo : lo + SHARD_WINDOWS]
        at, passage = _locate(g, passages[some])
        places.append(at)
        which.append(some[passage])
    return np.concatenate(places), np.concatenate(which)


def _locate(g: Group, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    import ahocorasick

    block = (g.size + 1) // 2
    spare = g.size - block
    begin = np.flatnonzero(np.append(True, np.diff(told) > 1))
    length = np.diff(np.append(begin, len(told)))  # windows in a run
    count = (length - 1 + block - 1) // block + 1
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    blocks = np.repeat(told[begin], count) + block * step
    speller = Speller(g, told)
    number: dict[str, int] = {}
    kind = np.array([number.setdefault(speller.words(p, block), len(number)) for p in blocks.tolist()], np.int64)
    by = np.argsort(kind, kind="stable")
    many = np.bincount(kind)
    first = np.cumsum(many) - many
    inside = np.zeros(len(g.words) + 1, bool)
    inside[g.at] = True
    index = np.full(len(g.words), -1, np.int64)
    index[told] = np.arange(len(told))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for text, k in number.items():
        if many[k] <= BLOCK_PLACES:
            automaton.add_word(text, k)
    automaton.make_automaton()
    places, passage = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(automaton):
        last, found = speller.stream(automaton, block)
        n = many[found]
        text = np.repeat(last - block + 1, n)
        model = blocks[by[np.repeat(first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        end = len(g.words) - 1
        # how many words agree before and after the block, up to a window's rest
        before, after = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for j in range(1, spare + 1):
            same = g.words[np.maximum(text - j, 0)] == g.words[np.maximum(model - j, 0)]
            before += (before == j - 1) & same & (text >= j) & (model >= j)
            right, wanted = text + block - 1 + j, model + block - 1 + j
            same = g.words[np.minimum(right, end)] == g.words[np.minimum(wanted, end)]
            after += (after == j - 1) & same & (right <= end) & (wanted <= end)
        for j in range(spare + 1):
            good = np.flatnonzero((before >= j) & (after >= spare - j))
            at, window = text[good] - j, index[model[good] - j]
            good = (window >= 0) & inside[at]
            places.append(at[good])
            passage.append(window[good])
    hot = np.flatnonzero(many[kind] > BLOCK_PLACES)
    if len(hot):
        served = (blocks[hot][:, None] - np.arange(spare + 1)).ravel()
        served = np.unique(index[served[served >= 0]])
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, p in zip(served[served >= 0].tolist(), told[served[served >= 0]].tolist(), strict=True):
            automaton.add_word(speller.words(p, g.size), k)
        automaton.make_automaton()
        if len(automaton):
            last, found = speller.stream(automaton, g.size)
            places.append(last - g.size + 1)
            passage.append(found)
    return np.concatenate(places), np.concatenate(passage)


def kept_digests(g: Group, gone: np.ndarray) -> list[str]:
    """sha256 of each document's kept words joined by one space."""
    out = []
    keep = ~gone
    for d in range(len(g.ids)):
        a, b = g.begins[d], g.begins[d + 1]
        of = np.flatnonzero(keep[a:b]) + a
        if not len(of):
            out.append(hashlib.sha256(b"").hexdigest())
            continue
        s, n = g.starts[of], g.ends[of] - g.starts[of]
        stop = np.cumsum(n + 1)
        source = np.repeat(s - (stop - n - 1), n + 1) + np.arange(stop[-1])
        text = g.data[np.minimum(source, len(g.data) - 1)]
        text[stop - 1] = 32
        out.append(hashlib.sha256(text[:-1].tobytes()).hexdigest())
    return out


def removed(table: pa.Table, answers: pa.Table, size: int) -> tuple[Group, np.ndarray]:
    """The group, and which of its words go."""
    g = Group(table, size)
    gone = np.zeros(len(g.words) + 1, np.int64)
    if len(g.windows):
        order = np.argsort(g.windows, kind="stable")
        ranked, owner = g.windows[order], g.owner[order]
        starts = _runs(ranked)
        distinct, own, most = ranked[starts], owner[starts], owner[np.append(starts[1:], len(ranked)) - 1]
        least = own.copy()
        hashes, elsewhere = exchange.replies(answers, FIRST)
        least[np.searchsorted(distinct, hashes)] = elsewhere
        later = np.flatnonzero(least < most)  # some of the group's documents lose these
        at, passage = locate(g, g.at[order[starts[later]]])
        at = at[g.key[g.doc[at]] > least[later][passage]]
        np.add.at(gone, at, 1)
        np.subtract.at(gone, at + size, 1)
    return g, np.cumsum(gone)[:-1] > 0


def _dedup(docs: DataFrame, size: int, rows, schema: str) -> DataFrame:
    dealt = exchange.Exchange(docs)
    shared = dealt.ask(_ask_blocks(size), SHARED)
    first = dealt.ask(_ask_windows(size), FIRST, shared)
    return dealt.finish(first, lambda table, answers: rows(*removed(table, answers, size)), schema)


def dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs(doc_id, text)."""

    def rows(g: Group, gone: np.ndarray) -> pa.Table:
        lost = np.append(0, np.cumsum(gone))
        return pa.table({"doc_id": pa.array(g.ids, pa.int64()), "n_words": pa.array(g.counts), "n_removed": pa.array(lost[g.begins[1:]] - lost[g.begins[:-1]]), "kept_sha256": pa.array(kept_digests(g, gone), pa.string())})

    return _dedup(docs, size, rows, SCHEMA)


def dedup_texts(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text) with the kept words joined by one space."""

    def rows(g: Group, gone: np.ndarray) -> pa.Table:
        raw = g.data.tobytes()
        texts = [b" ".join(raw[g.starts[k] : g.ends[k]] for k in np.flatnonzero(~gone[a:b]) + a).decode("utf-8", "replace") for a, b in zip(g.begins[:-1].tolist(), g.begins[1:].tolist(), strict=True)]
        return pa.table({"doc_id": pa.array(g.ids, pa.int64()), "text": pa.array(texts, pa.string())})

    return _dedup(docs, size, rows, "doc_id long, text string")
