"""Suffix-array dedup of long byte strings.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else in
the corpus, in the same document too; strings never cross documents and are judged on the
input.

1. Anchors.  The anchor of a string is its ``gram``-byte piece with the least hash (the
   leftmost of equals), so equal strings have equal anchors at equal places.  Consecutive
   strings share an anchor; such a *run*, one for each ~180 bytes of text, is the unit that
   is shuffled: its anchor's hash, a hash of its bytes, and where it is.
2. Runs with one anchor hash are counted by content.  Where all have the same content the
   count settles every string of the run.  Only where contents differ are their bytes
   fetched, once for each different content.
3. Those are laid end to end in packets and sorted by two-stage suffix sorting: suffixes
   smaller than their successors are sorted directly, the others are induced from them by
   one scan over the buckets of first bytes; then adjacent common prefixes tell which
   strings of ``length`` bytes occur twice.  Order and prefixes are only followed
   ``length`` bytes deep.
4. The runs' repeated strings go back to their documents.

An anchor with more than ``PACKET_RUNS`` different contents, such as a line that many pages
have, is divided first, so that none crowds a task: strings with their anchor in the same
stretch of ``stride`` places share a long piece, and only contents with an equal piece go to
one packet.  ``STRIDES`` go down to a few places; what is more than a packet even then
differs in a few bytes at its ends at most, and its strings are counted by 128 bits of hash.
A run's content is known by 128 bits too, 64 of its anchor and 64 of its bytes.

Cases: null and empty texts and texts shorter than ``length`` stay whole; repeated rows are
documents of their own and repeat each other; null ids are kept; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from . import textkit as tk
from .common import bytes_of, materialize

LENGTH, GRAM = 400, 32
PACKET_BYTES, PACKET_RUNS = 1 << 19, 20_000
#: Stretches of anchor places that crowded anchors are divided by, as shares of all places.
STRIDES = (1 / 8, 1 / 64)


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, anchor hash, content hash, anchor's place) of every
    run, starts and places counted in the chunk."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    starts = np.arange(n - gram + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tk.powers(tk._R, n), out=sums[1:])
    h = tk.mix((sums[gram:] - sums[: n - gram + 1]) * tk.powers(tk._R_INV, n)[: n - gram + 1])
    least = tk.sliding_min((h & ~np.uint64(0xFFFFFFFF)) | starts.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    whole = owner[: n - length + 1] == owner[length - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, none, none, none
    a = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (owner[at[1:]] != owner[at[:-1]])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    a = a[new]
    stop = last + length
    content = tk.mix(tk.span_hash(data, first, stop) + (a - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return owner[first].astype(np.int64), first, last, h[a], content, a


RUNS = "g long, doc_id long, tag long, anchor long, content long, first int, n int, rel int"


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offs in tk.chunks(batch, "text"):
                doc, first, last, anchor, content, place = runs_of(data, offs, length, gram)
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([batch.column("g").take(take), ids.take(take), batch.column("tag").take(take), pa.array(anchor.astype(np.uint64).view(np.int64)), pa.array(content.astype(np.uint64).view(np.int64)), pa.array((first - offs[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array((place - first).astype(np.int32))], ["g", "doc_id", "tag", "anchor", "content", "first", "n", "rel"])

    return run


# ------------------------------------------------------------- two-stage sorting


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order, followed ``depth`` symbols deep; symbols are 0..510, and the end is
    smaller than all."""
    n = len(symbols)
    s = symbols.astype(np.int64)
    if n < 2:
        return np.arange(n)
    # a suffix is smaller than its successor if its symbol is, or if it's equal and the
    # successor is smaller than its own; the last suffix is larger than the end
    step = np.sign(np.append(s[:-1] - s[1:], 1))
    decided = np.flatnonzero(step)
    kind = step[decided[np.searchsorted(decided, np.arange(n))]]
    smaller = kind < 0
    direct = _sort_directly(s, np.flatnonzero(smaller), depth)
    # the scan: buckets by first symbol, larger suffixes at their fronts, smaller ones behind
    alphabet = int(s.max()) + 1
    count = np.bincount(s, minlength=alphabet)
    head = np.cumsum(count) - count
    front = np.bincount(s[~smaller], minlength=alphabet)
    out = np.full(n, -1, np.int64)
    order = np.argsort(s[direct], kind="stable")
    out_at = np.arange(len(direct)) - np.repeat(np.cumsum(np.bincount(s[direct], minlength=alphabet)) - np.bincount(s[direct], minlength=alphabet), np.bincount(s[direct], minlength=alphabet))
    placed = direct[order]
    out[head[s[placed]] + front[s[placed]] + out_at] = placed
    fill = head.copy()

    def induce(seen: np.ndarray) -> None:
        before = seen - 1
        before = before[before >= 0]
        before = before[~smaller[before]]
        if not len(before):
            return
        c = s[before]
        by = np.argsort(c, kind="stable")
        c, before = c[by], before[by]
        edge = np.flatnonzero(np.diff(c, prepend=-1))
        size = np.diff(np.append(edge, len(c)))
        out[np.repeat(fill[c[edge]] - edge, size) + np.arange(len(c))] = before
        fill[c[edge]] += size

    induce(np.array([n]))  # the end comes first and induces the last suffix
    for c in np.flatnonzero(count).tolist():
        at, stop = int(head[c]), int(head[c] + front[c])
        while at < stop:  # what a bucket's front induces may belong to the same front
            upto = int(fill[c])
            if upto == at:
                break
            induce(out[at:upto])
            at = upto
        induce(out[stop : head[c] + count[c]])
    return out


def _sort_directly(s: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes ``which`` in order by their first ``depth`` symbols, seven symbols a pass;
    only those still tied take part in a pass."""
    n = len(s)
    padded = np.zeros(n + 7, np.uint64)
    padded[:n] = s + 1
    key = np.zeros(n + 1, np.uint64)
    for k in range(7):
        key[:n] = (key[:n] << np.uint64(9)) | padded[k : n + k]
    order = which.copy()
    first = np.argsort(key[order], kind="stable")
    order = order[first]
    k = key[order]
    group = np.zeros(len(order), np.int64)
    if len(order):
        group[1:] = np.cumsum(k[1:] != k[:-1])
    live = np.arange(len(order))
    at = 7
    while at < depth and len(live):
        tied = np.zeros(len(live), bool)
        same = group[live[1:]] == group[live[:-1]]
        tied[1:] |= same
        tied[:-1] |= same
        live = live[tied]
        if not len(live):
            break
        k, g = key[np.minimum(order[live] + at, n)], group[live]
        inner = np.zeros(len(live), bool)
        inner[1:] = g[1:] == g[:-1]
        begin = np.flatnonzero(~inner)
        differs = np.zeros(len(live), bool)
        differs[1:] = inner[1:] & (k[1:] != k[:-1])
        # only groups whose keys differ are sorted; repeats stay as they are
        mixed = np.repeat(np.logical_or.reduceat(differs, begin), np.diff(np.append(begin, len(live))))
        some = np.flatnonzero(mixed)
        if len(some):
            by = some[np.lexsort((k[some], g[some]))]
            k[some] = k[by]
            order[live[some]] = order[live[by]]
        fresh = ~inner
        fresh[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(fresh)
        # a group that splits gets numbers that no other has: the place of each part's start
        number = np.zeros(len(live), np.int64)
        number[fresh] = starts
        group[live] = np.maximum.accumulate(number)
        at += 7
    return order


def repeated_starts(contents: list[bytes], length: int) -> list[np.ndarray]:
    """Which strings of ``length`` bytes of each content occur elsewhere among the contents:
    one flag for each start."""
    m = len(contents)
    size = np.array([len(c) for c in contents])
    at = np.cumsum(size + 1) - size - 1
    symbols = np.zeros(int((size + 1).sum()), np.int64)
    flat = np.frombuffer(b"".join(contents), np.uint8)
    symbols[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat.astype(np.int64) + 1
    order = suffix_array(symbols, length)
    # how many bytes follow each place before its content ends
    stop = np.repeat(at + size, size + 1)
    room = stop - np.arange(len(symbols))
    long = order[room[order] >= length]
    twice = np.zeros(len(symbols), bool)
    if len(long) > 1:
        a, b = long[:-1], long[1:]
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.where(symbols > 0, symbols - 1, 0).astype(np.uint8), np.zeros(8, np.uint8)]), 8).copy().view("<u8").ravel()
        live = np.arange(len(a))
        for step in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]:
            live = live[wide[a[live] + step] == wide[b[live] + step]]
        if length < 8:
            for step in range(length):
                live = live[symbols[a[live] + step] == symbols[b[live] + step]]
        twice[a[live]] = True
        twice[b[live]] = True
    return [twice[a : a + n - length + 1] for a, n in zip(at.tolist(), size.tolist(), strict=True)]


def intervals(flags: np.ndarray) -> np.ndarray:
    """Flat (begin, end) pairs of the true stretches."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel()


FOUND = "anchor long, content long, spans array<int>"


def may_repeat(parts: np.ndarray, rel: np.ndarray, contents: list[bytes], length: int, gram: int) -> np.ndarray:
    """Which contents may share a string of ``length`` bytes with another of their part.

    A string with its anchor j bytes in contains the piece of ``length - stride`` bytes that
    begins ``stride * (j div stride)`` bytes before the anchor, so a content none of whose
    few such pieces another one has can be left out.
    """
    stride = -(-(length - gram) // 8) or 1
    size = np.array([len(c) for c in contents])
    base = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(contents), np.uint8)
    out = np.zeros(len(contents), bool)
    for t in range((length - gram) // stride + 1):
        start = rel - stride * t
        fits = np.flatnonzero((start >= 0) & (start + length - stride <= size))
        at = base[fits] + start[fits]
        key = tk.mix(tk.rolling_hash(flat, at, at + length - stride) ^ tk.mix(parts[fits].view(np.uint64)))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[fits[count[which] > 1]] = True
    return out


def _sort_packets(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # (part, anchor, content, copies, first, rel, bytes) that wait for the suffix array
        rows: list[tuple] = []  # wait for the rest of their part
        held = waiting = 0

        def sift() -> list[pa.RecordBatch]:
            nonlocal kept, rows, held, waiting
            done = []
            if rows:
                live = may_repeat(np.array([r[0] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64), [r[6] for r in rows], length, gram)
                kept += [r for r, x in zip(rows, live.tolist(), strict=True) if x]
                done = [r for r, x in zip(rows, live.tolist(), strict=True) if not x and r[3] > 1]
            held = sum(len(r[6]) for r in kept)
            rows, waiting = [], 0
            return [answer(done, [np.array([0, len(r[6]) - length + 1]) for r in done])] if done else []

        def flush() -> list[pa.RecordBatch]:
            nonlocal kept, held
            flags = repeated_starts([r[6] for r in kept], length)
            out = answer(kept, [intervals(f | (r[3] > 1)) for f, r in zip(flags, kept, strict=True)])
            kept, held = [], 0
            return [out]

        def answer(some: list, spans: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.int64()), pa.array([(x + r[4]).astype(np.int32) for x, r in zip(spans, some, strict=True)], pa.list_(pa.int32()))], ["anchor", "content", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "anchor", "content", "copies", "lo", "rel", "bytes")), strict=True):
                if waiting >= PACKET_BYTES and rows[-1][0] != row[0]:  # a part's contents stay together
                    yield from sift()
                    if held >= PACKET_BYTES:
                        yield from flush()
                rows.append(row)
                waiting += len(row[6])
        yield from sift()
        if kept:
            yield from flush()

    return run


#: Bytes to look at: ``part`` meets in one packet, ``lo`` is where the bytes begin in the content.
FETCHED = "part long, anchor long, content long, copies long, many boolean, lo int, rel int, bytes binary"


def _divide(length: int, gram: int, stride: int):
    """Each content's strings by the stretch of places that their anchor is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "anchor", "content", "copies", "many", "lo", "rel", "bytes"]
        for batch in batches:
            out: list[tuple] = []
            for part, anchor, content, copies, _, lo, rel, raw in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                for t in range((length - gram) // stride + 1):
                    piece = rel - stride * t
                    first, last = max(0, piece - stride + 1), min(piece, len(raw) - length)
                    if first <= last:
                        key = xxhash.xxh3_64_intdigest(raw[piece : piece + length - stride], seed=(part ^ (t * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF)
                        out.append((key - (1 << 64) if key >> 63 else key, anchor, content, copies, True, lo + first, rel - first, raw[first : last + length]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def divided(fetched: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows for packets, rows of parts that are more than a packet however divided)."""
    packets, crowded = fetched.where("not many"), fetched.where("many")
    if crowded.isEmpty():
        return packets, None
    for share in STRIDES:
        parts = materialize(crowded.mapInArrow(_divide(length, gram, max(1, round((length - gram + 1) * share))), FETCHED), "parts")
        large = parts.groupBy("part").agg(F.count("*").alias("rows")).where(F.col("rows") > PACKET_RUNS).select("part")
        packets = packets.union(parts.join(large, "part", "left_anti").select(*parts.columns))
        crowded = parts.join(large, "part", "left_semi").select(*parts.columns)
        if crowded.isEmpty():
            return packets, None
    return packets, crowded


def _string_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, copies, lo, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "copies", "lo", "bytes")), strict=True):
                n = len(raw) - length + 1
                keys = np.array([[xxhash.xxh3_64_intdigest(raw[k : k + length], seed) for seed in (0, 1)] for k in range(n)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([content] * n, pa.int64()), pa.array([copies] * n, pa.int64()), pa.array(np.arange(lo, lo + n, dtype=np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["anchor", "content", "copies", "at", "string", "other"])

    return run


def _fetch(length: int):
    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        """The bytes of wanted runs from the documents of a group."""
        names = ["part", "anchor", "content", "copies", "many", "lo", "rel", "bytes"]
        texts: dict[tuple, bytes] = {}
        for key, tag, text in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
            texts[key, tag] = text
        rows = [wanted.column(c).to_pylist() for c in ("doc_id", "tag", "first", "n", "anchor", "content", "copies", "many", "rel")]
        raw = {k: t.encode() for k, t in texts.items() if t is not None} if len(rows[0]) else {}
        parts = [raw[d, t][f : f + n + length - 1] for d, t, f, n, *_ in zip(*rows, strict=True)]
        anchor, content, copies, many, rel = rows[4:]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
        columns = (anchor, anchor, content, copies, many, [0] * len(anchor), rel, parts)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int, texts: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        gone: dict[tuple, list[np.ndarray]] = {}
        for key, tag, first, found in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "tag", "first", "spans")), strict=True):
            gone.setdefault((key, tag), []).append(np.array(found, np.int64) + first)
        out = []
        for key, tag, text in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
            raw = (text or "").encode()
            n = len(raw)
            if (key, tag) in gone:
                edge = np.zeros(n + 1, np.int64)
                pairs = np.concatenate(gone[key, tag])
                np.add.at(edge, pairs[0::2], 1)
                np.add.at(edge, pairs[1::2] + length - 1, -1)
                keep = np.cumsum(edge)[:-1] == 0
                n_removed = n - int(keep.sum())
                n_spans = int((np.diff(np.append(True, keep).astype(np.int8)) == -1).sum())
                kept = np.frombuffer(raw, np.uint8)[keep].tobytes()
            else:
                n_removed, n_spans, kept = 0, 0, raw
            out.append((key, n, n_removed, n_spans, kept if texts else hashlib.sha256(kept).hexdigest()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary() if texts else pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text);
    with ``texts`` the kept bytes themselves, in ``kept``, instead of their hash."""
    groups = exchange.group_count(bytes_of(docs, "text"))
    rows = docs.select("doc_id", "text", exchange.group_of(groups).alias("g"), F.xxhash64("text").alias("tag"))
    runs = materialize(rows.where(F.octet_length("text") >= length).mapInArrow(_runs(length, gram), RUNS), "runs")

    by_content = runs.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("g", "doc_id", "tag", "first", "n", "rel")).alias("at"))
    by_content = materialize(by_content, "contents")
    by_anchor = by_content.groupBy("anchor").agg(F.count("*").alias("contents"))
    mixed = by_content.join(by_anchor.where("contents > 1"), "anchor")
    settled = by_content.join(by_anchor.where("contents = 1"), "anchor").where("copies > 1").select("anchor", "content", F.array(F.lit(0), F.col("at.n")).alias("spans"))

    dealt = rows.repartition("g")
    wanted = mixed.select("at.*", "anchor", "content", "copies", (F.col("contents") > PACKET_RUNS).alias("many"))
    fetched = dealt.groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(_fetch(length), FETCHED)
    packets, crowded = divided(materialize(fetched, "fetched"), length, gram)
    packets = packets.repartition("part").sortWithinPartitions("part", "content")
    sorted_out = packets.mapInArrow(_sort_packets(length, gram), FOUND)
    found = settled.union(sorted_out.where("size(spans) > 0"))
    if crowded is not None:
        strings = crowded.mapInArrow(_string_hashes(length), "anchor long, content long, copies long, at int, string long, other long")
        seen = strings.groupBy("anchor", "string", "other").agg(F.sum("copies").alias("total"))
        counted = strings.join(seen.where("total > 1"), ["anchor", "string", "other"])
        found = found.union(counted.groupBy("anchor", "content").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + 1))).alias("spans")))
    spans = runs.join(found, ["anchor", "content"]).select("g", "doc_id", "tag", "first", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" if texts else RESULT
    return dealt.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(_cut(length, texts), schema)
