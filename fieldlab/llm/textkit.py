"""Vectorised byte and word primitives shared by the corpus operators.

Everything works on one chunk: the UTF-8 bytes of several whole documents laid end
to end, with ``offsets`` (n_docs + 1) marking where each begins.  Chunks are cut at
document boundaries and hold about ``CHUNK_BYTES``; one longer document makes one
longer chunk, so memory follows the longest document and never the table.

Words are ``[^\\x20\\x09-\\x0D]+``.  Every delimiter is ASCII, so splitting the UTF-8
bytes is the same as splitting the characters.
"""

from __future__ import annotations

import ctypes
import platform
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20

U64 = np.uint64
_R = U64(0x9E3779B97F4A7C15 | 1)
_R_INV = U64(pow(int(_R), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def keep_heap() -> None:
    """Let this worker reuse freed memory for its arrays of a few MB, rather than give it back
    to the system and fault it in again for every chunk (glibc only)."""
    if sys.platform == "linux" and platform.libc_ver()[0] == "glibc":
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 28)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolling_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash modulo 2**64 of values[start:end], cheap for long spans that overlap.

    Unequal contents can be built that collide, so it may only choose what is looked at more
    closely, never decide that two spans are equal.
    """
    n = len(values)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(_R, n), out=sums[1:])
    out = (sums[ends] - sums[starts]) * powers(_R_INV, n + 1)[starts]
    return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Spans beyond this many bytes are hashed one by one.
WIDE_SPAN = 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[start:end] of each span; equal content, equal hash.

    Eight bytes at a time go through ``mix``, which is not linear, so no repetition within a
    span cancels out; long spans go through xxh3.
    """
    n = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    wide = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix((wide[starts] & _MASK[np.minimum(n, 8)]) + n.astype(U64) * U64(0xD6E8FEB86659FD93))
    live = np.flatnonzero((n > 8) & (n <= WIDE_SPAN))
    at = 8
    while len(live):
        left = n[live] - at
        out[live] = mix((wide[starts[live] + at] & _MASK[np.minimum(left, 8)]) * U64(0x9E3779B97F4A7C15) ^ out[live])
        live = live[left > 8]
        at += 8
    for k in np.flatnonzero(n > WIDE_SPAN).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def as_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of about ``limit`` bytes each."""
    data, offs = text_buffers(as_array(batch.column(column)))
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and where each document's words begin (n_docs + 1)."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[:-1]
    edge = edge[edge < n]
    first[edge] |= solid[edge]
    starts = np.flatnonzero(first)
    last = solid
    last[:-1] &= ~solid[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(data, starts, ends)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive values (documents are not told apart here).

    The values are mixed hashes, and k is small: a polynomial modulo 2**64 only lets unequal
    sequences cancel out from 2**10 values on.
    """
    if k > 512:
        raise ValueError("windows of more than 512 values")
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(0xC2B2AE3D27D4EB4F)
        out += hashes[j : j + n]
    return mix(out)


def within(begins: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n - k + 1 windows of k items stay inside one document."""
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    return doc[: n - k + 1] == doc[k - 1 :] if n >= k else np.zeros(0, bool)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by block prefix and suffix minima."""
    n = len(values)
    if n < w:
        return values[:0]
    pad = -n % w
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


#: Byte kinds: 0 white space and control, 1 letters (A-Z, a-z and all of non-ASCII), 2 digits, 3 other.
KIND = np.full(256, 3, dtype=np.uint8)
KIND[:33] = 0
KIND[127] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one byte kind (white space left out): starts, ends, kinds, and where each
    document's runs begin (n_docs + 1)."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    kind = KIND[data]
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    edge = offsets[:-1]
    first[edge[edge < n]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    return starts, ends, kind[starts], np.searchsorted(starts, offsets)
