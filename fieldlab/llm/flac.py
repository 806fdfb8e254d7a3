"""FLAC media columns: lossless storage of samples, and decoding with checksums.

``encode_chunk`` and ``decode_streams`` work on many frames at once: a *lane* is the run of
frames behind one seek point, and all lanes of a chunk advance together, one sample a step,
so Rice codes and predictors cost a few array operations per step however many streams
there are.  The decoder takes constant, verbatim, fixed and linear-predictor subframes,
partitioned Rice codes of both kinds with escapes, wasted bits, and up to eight channels
with stereo decorrelation; it checks the CRC-8 of every frame header, the CRC-16 of every
frame and the MD5 of the samples.  Samples have at most 24 bits.

The format's constants (sync code, block size and sample size codes, fixed predictors, CRC
polynomials 0x07 and 0x8005) are the published ones.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 192
#: Fixed values of the format: predictor coefficients by order.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
BLOCK_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


class FlacError(ValueError):
    """A stream that breaks the format or fails a checksum."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of data[start:end] for every span, all spans advancing together."""
    order = np.argsort(starts - ends, kind="stable")  # longest first
    at, left = starts[order].astype(np.int64), (ends - starts)[order]
    crc, mask, shift = np.zeros(len(order), np.int64), (1 << bits) - 1, bits - 8
    live = len(order)
    longest = int(left[0]) if live else 0
    alive = np.searchsorted(-left, -np.arange(longest), side="left")
    for k in range(longest):
        live = int(alive[k])
        c = crc[:live]
        crc[:live] = ((c << 8) & mask) ^ table[(c >> shift) ^ data[at[:live] + k]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# ------------------------------------------------------------------ encoding


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = (values >> (width - 1 - b)) & 1


def _utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length code: (n, 6) bytes and lengths."""
    out, size = np.zeros((len(n), 6), np.uint8), np.ones(len(n), np.int64)
    for length, limit in ((2, 7), (3, 11), (4, 16), (5, 21), (6, 26)):
        size[n >= (1 << limit)] = length
    for length in range(1, 7):
        of = size == length
        if not of.any():
            continue
        v = n[of]
        if length == 1:
            out[of, 0] = v
            continue
        out[of, 0] = ((0xFF00 >> length) & 0xFF) | (v >> (6 * (length - 1)))
        for k in range(1, length):
            out[of, k] = 0x80 | ((v >> (6 * (length - 1 - k))) & 0x3F)
    return out, size


def _linear(frames: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised predictors: (coefficients (n, order), shifts, usable)."""
    n = len(frames)
    auto = np.stack([(frames[:, k:] * frames[:, : frames.shape[1] - k]).sum(axis=1) for k in range(order + 1)], axis=1).astype(float)
    err = auto[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((n, order))
    for i in range(order):
        acc = auto[:, i + 1].copy()
        for j in range(i):
            acc -= a[:, j] * auto[:, i - j]
        k = acc / err
        old = a[:, :i].copy()
        for j in range(i):
            a[:, j] = old[:, j] - k * old[:, i - 1 - j]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    most = np.abs(a).max(axis=1)
    _, exponent = np.frexp(most)
    shift = np.clip(precision - 1 - exponent, 0, 15).astype(np.int64)
    q = np.rint(a * np.exp2(shift)[:, None]).astype(np.int64)
    limit = 1 << (precision - 1)
    return q, shift, (most > 0) & (q >= -limit).all(axis=1) & (q < limit).all(axis=1)


def encode_frames(samples: np.ndarray, numbers: np.ndarray, lpc_order: int = 2, partition_order: int = 2, precision: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, frame offsets (n + 1)) of mono 8-bit frames; samples is (n, BLOCK) in -128..127.

    Each frame takes the cheapest of a constant, the fixed predictors, one linear predictor
    and verbatim samples, by exact size.
    """
    x = samples.astype(np.int32)
    n, size = x.shape
    parts, per = 1 << partition_order, size >> partition_order
    best_cost = np.full(n, np.iinfo(np.int64).max)
    order = np.zeros(n, np.int64)
    folded = np.zeros((n, size), np.int32)
    rice = np.zeros((n, parts), np.int64)

    def consider(residual: np.ndarray, used: int, head: int, label: int, allowed: np.ndarray | None = None) -> None:
        u = (residual << 1) ^ (residual >> 31)
        u[:, :used] = 0
        count = np.full(parts, per)
        count[0] -= used
        total = u.reshape(n, parts, per).sum(axis=2, dtype=np.int64)
        k = np.zeros((n, parts), np.int64)
        for step in range(14):
            k += (count << step) < total  # the least k with count * 2**k >= total
        q = u.reshape(n, parts, per) >> k[:, :, None].astype(np.int32)
        cost = head + 6 + (q.sum(axis=2, dtype=np.int64) + count * (k + 1) + 4).sum(axis=1)
        better = cost < best_cost
        if allowed is not None:
            better &= allowed
        best_cost[better], order[better] = cost[better], label
        folded[better], rice[better] = u[better], k[better]

    residual = x.copy()
    for p in range(5):
        if p:
            residual[:, p:] = residual[:, p:] - residual[:, p - 1 : -1]
        consider(residual.copy(), p, 8 * p, p)
    coefficients = shifts = None
    if lpc_order:
        coefficients, shifts, usable = _linear(x.astype(np.int64), lpc_order, precision)
        guess = np.zeros((n, size), np.int64)
        for j in range(lpc_order):
            guess[:, lpc_order:] += coefficients[:, j : j + 1] * x[:, lpc_order - 1 - j : size - 1 - j]
        left = x - (guess >> shifts[:, None])
        usable &= np.abs(left).max(axis=1) < 1 << 20
        consider(left.astype(np.int32), lpc_order, 8 * lpc_order + 9 + precision * lpc_order, 8 + lpc_order, usable)
    plain = best_cost >= 8 * size
    still = (x == x[:, :1]).all(axis=1)
    kind = np.where(still, -2, np.where(plain, -1, order))
    body = np.where(still, 8, np.where(plain, 8 * size, best_cost))

    code, code_len = _utf8_number(numbers)
    head_bytes = 4 + code_len + 1
    frame_bytes = head_bytes + (8 + body + 7) // 8 + 2
    offsets = np.concatenate([[0], np.cumsum(frame_bytes)])
    bits = np.zeros(int(offsets[-1]) * 8, np.uint8)
    at = (offsets[:-1] + head_bytes) * 8
    header = np.where(kind == -2, 0, np.where(kind == -1, 1, np.where(kind >= 8, 0x20 | (kind - 9), 8 | np.maximum(kind, 0))))
    _put(bits, at, header << 1, 8)
    at = at + 8
    raw = x & 0xFF
    of = np.flatnonzero(kind == -2)
    _put(bits, at[of], raw[of, 0], 8)
    of = np.flatnonzero(kind == -1)
    if len(of):
        _put(bits, (at[of, None] + 8 * np.arange(size)).ravel(), raw[of].ravel(), 8)
    coded = np.flatnonzero(kind >= 0)
    used = np.where(kind >= 8, kind - 8, np.maximum(kind, 0))
    for j in range(int(used[coded].max()) if len(coded) else 0):
        of = coded[used[coded] > j]
        _put(bits, at[of] + 8 * j, raw[of, j], 8)
    at = at + 8 * used
    of = np.flatnonzero(kind >= 8)
    if len(of):
        _put(bits, at[of], np.full(len(of), precision - 1), 4)
        _put(bits, at[of] + 4, shifts[of], 5)
        for j in range(lpc_order):
            _put(bits, at[of] + 9 + precision * j, coefficients[of, j] & ((1 << precision) - 1), precision)
        at[of] += 9 + precision * lpc_order
    _put(bits, at[coded] + 2, np.full(len(coded), partition_order), 4)
    at = at + 6
    if len(coded):
        u, k = folded[coded], np.repeat(rice[coded], per, axis=1).astype(np.int32)
        q = u >> k
        length = (q + 1 + k).astype(np.int64)
        length[np.arange(size)[None, :] < used[coded, None]] = 0
        extra = np.zeros(size, np.int64)
        extra[::per] = 4
        position = at[coded, None] + np.cumsum(length + extra, axis=1) - length
        _put(bits, (position[:, ::per] - 4).ravel(), rice[coded].ravel(), 4)
        live = length > 0
        position, q, k, u = position[live], q[live], k[live], u[live]
        one = position + q
        bits[one] = 1
        for b in range(int(k.max()) if len(k) else 0):
            of = np.flatnonzero(k > b)
            bits[one[of] + k[of] - b] = (u[of] >> b) & 1
    data = np.packbits(bits)
    start = offsets[:-1]
    data[start], data[start + 1], data[start + 2], data[start + 3] = 0xFF, 0xF8, 0x10, 0x02
    for b in range(6):
        of = code_len > b
        data[start[of] + 4 + b] = code[of, b]
    end = start + head_bytes - 1
    data[end] = crc_spans(data, start, end, CRC8, 8)
    end = offsets[1:] - 2
    crc = crc_spans(data, start, end, CRC16, 16)
    data[end], data[end + 1] = crc >> 8, crc & 0xFF
    return data, offsets


def encode_chunk(payloads: list[np.ndarray], every: int = 4, rate: int = 8000, **how) -> list[bytes]:
    """One mono 8-bit stream for each payload of bytes (each a multiple of BLOCK long), with
    a seek point every ``every`` frames."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    if not len(counts):
        return []
    flat = np.concatenate(payloads)
    samples = (flat.astype(np.int16) - 128).astype(np.int8)
    first = np.cumsum(counts) - counts
    numbers = np.arange(counts.sum()) - np.repeat(first, counts)
    data, offsets = encode_frames(samples.reshape(-1, BLOCK), numbers, **how)
    sizes = np.diff(offsets)
    out = []
    for i, (a, n) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
        own = sizes[a : a + n]
        digest = hashlib.md5(samples[a * BLOCK : (a + n) * BLOCK].tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += ((rate << 44) | (7 << 36) | n * BLOCK).to_bytes(8, "big") + digest
        marks = range(0, n, every)
        seek = b"".join(struct.pack(">QQH", k * BLOCK, int(offsets[a + k] - offsets[a]), BLOCK) for k in marks)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[offsets[a] : offsets[a + n]].tobytes())
    return out


# ------------------------------------------------------------------ decoding


class Stream:
    """The metadata of one stored stream."""

    def __init__(self, stored: bytes):
        if stored[:4] != b"fLaC":
            raise FlacError("no stream marker")
        at, last, info = 4, False, None
        self.seek: list[tuple[int, int]] = []
        while not last:
            if at + 4 > len(stored):
                raise FlacError("metadata is cut off")
            last, kind, size = bool(stored[at] & 0x80), stored[at] & 0x7F, int.from_bytes(stored[at + 1 : at + 4], "big")
            body = stored[at + 4 : at + 4 + size]
            if kind == 0:
                info = body
            elif kind == 3:
                points = [struct.unpack_from(">QQH", body, k) for k in range(0, size - 17, 18)]
                self.seek = [(s, o) for s, o, _ in points if s != 0xFFFFFFFFFFFFFFFF]
            at += 4 + size
        if info is None or len(info) < 34:
            raise FlacError("no stream information")
        packed = int.from_bytes(info[10:18], "big")
        self.rate, self.channels, self.bits, self.total = packed >> 44, ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1)
        self.md5, self.at, self.stored = info[18:34], at, stored
        if self.bits > 24:
            raise FlacError("more than 24 bits a sample")


class _Bits:
    """Big-endian bit reads at many places of one buffer."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.data = padded
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)

    def window(self, at: np.ndarray) -> np.ndarray:
        """64 bits from bit ``at``; the last 7 of them may be missing (0)."""
        byte = np.minimum(at >> 3, self.n + 8)
        return self.words[byte] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned values of ``width`` (0 to 32) bits."""
        width = np.asarray(width, np.uint64)
        return np.where(width > 0, self.window(at) >> (np.uint64(64) - np.maximum(width, np.uint64(1))), np.uint64(0)).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        value, width = self.read(at, width), np.asarray(width, np.int64)
        return value - np.where((width > 0) & (value >> np.maximum(width - 1, 0) > 0), np.int64(1) << width, 0)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """How many 0 bits stand from ``at`` on."""
        total = np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        while len(todo):
            top = (self.window(at[todo] + total[todo]) >> np.uint64(11)).astype(np.float64)
            _, exponent = np.frexp(top)
            total[todo] += np.where(top > 0, 53 - exponent, 53)
            todo = todo[top == 0]
            if len(todo) and (at[todo] + total[todo] > 8 * self.n).any():
                raise FlacError("a code runs past the end")
        return total


def _rice(bits: _Bits, at: np.ndarray, out: np.ndarray, order: int, size: int, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Fill out[order:size] (samples by lanes) from Rice residuals; returns the new places."""
    method, partition = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise FlacError("unknown residual coding")
    at = at + 6
    if len(at) and (partition != partition[0]).any():
        new = at.copy()
        for p in np.unique(partition):
            of = np.flatnonzero(partition == p)
            part = out[:, of]
            new[of] = _rice(bits, at[of] - 6, part, order, size, coefficients[:, of], shift[of])
            out[:, of] = part
        return new
    per = size >> int(partition[0]) if len(at) else size
    wide = 4 + method
    top = (np.int64(1) << wide) - 1
    k = raw = None
    escape = False
    for i in range(order, size):
        if i == order or i % per == 0:
            k = bits.read(at, wide)
            at = at + wide
            is_raw = k == top
            escape = bool(is_raw.any())
            if escape:
                raw = np.where(is_raw, bits.read(at, 5), 0)
                at = at + np.where(is_raw, 5, 0)
                k = np.where(is_raw, 0, k)
            k64 = k.astype(np.uint64)
            down = np.uint64(63) - k64
        if escape:
            q = np.where(is_raw, 0, bits.zeros(np.where(is_raw, 0, at)))
            u = (q << k) | bits.read(at + q + 1, k)
            value = np.where(is_raw, bits.signed(at, raw), (u >> 1) ^ -(u & 1))
            at = at + np.where(is_raw, raw, q + 1 + k)
        else:
            q = bits.zeros(at)
            at = at + q
            # the stop bit and k more, without the stop bit
            low = (bits.window(at) >> down).astype(np.int64)
            u = (q << k) + low - (np.int64(1) << k)
            at = at + 1 + k
            value = (u >> 1) ^ -(u & 1)
        if len(coefficients):
            guess = coefficients[0] * out[i - 1]
            for j in range(1, order):
                guess += coefficients[j] * out[i - 1 - j]
            value = value + (guess >> shift)
        out[i] = value
    return at


def _subframes(bits: _Bits, at: np.ndarray, size: int, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples (size, lanes), new places) of one channel for lanes of equal block size."""
    head = bits.read(at, 8)
    at = at + 8
    if (head & 0x80).any():
        raise FlacError("a subframe begins with 1")
    kind, wasted = (head >> 1) & 0x3F, np.zeros(len(at), np.int64)
    of = np.flatnonzero(head & 1)
    if len(of):
        wasted[of] = bits.zeros(at[of]) + 1
        at[of] += wasted[of]
    depth = depth - wasted
    out = np.zeros((size, len(at)), np.int64)
    for value in np.unique(kind):
        of = np.flatnonzero(kind == value)
        place, wide = at[of], depth[of]
        part = np.zeros((size, len(of)), np.int64)
        if value == 0:
            part[:] = bits.signed(place, wide)
            place = place + wide
        elif value == 1:
            for i in range(size):
                part[i] = bits.signed(place, wide)
                place = place + wide
        elif 8 <= value <= 12 or value >= 32:
            order = int(value - 8 if value < 32 else value - 31)
            if order > size:
                raise FlacError("a predictor longer than its block")
            for i in range(order):
                part[i] = bits.signed(place, wide)
                place = place + wide
            if value < 32:
                coefficients = np.repeat(np.array(FIXED[order], np.int64)[:, None], len(of), axis=1).reshape(order, len(of))
                shift = np.zeros(len(of), np.int64)
            else:
                precision, shift = bits.read(place, 4) + 1, bits.signed(place + 4, 5)
                if (precision == 16).any() or (shift < 0).any():
                    raise FlacError("a predictor that the format excludes")
                place = place + 9
                coefficients = np.zeros((order, len(of)), np.int64)
                for j in range(order):
                    coefficients[j] = bits.signed(place, precision)
                    place = place + precision
            place = _rice(bits, place, part, order, size, coefficients, shift)
        else:
            raise FlacError(f"reserved subframe type {value}")
        out[:, of], at[of] = part << wasted[of], place
    return out, at


def decode_streams(stored: list[bytes], ranges: list[tuple[int, int]] | None = None) -> list[np.ndarray]:
    """Samples (total, channels) of every stream, all checksums verified.

    With ``ranges`` only samples start to stop of each stream: decoding begins at the last
    seek point before the start and ends after the stop, so a stream's MD5 isn't verified,
    but all of the frames passed are.
    """
    streams = [Stream(s) for s in stored]
    whole = ranges is None
    ranges = [(0, s.total) for s in streams] if whole else [(max(0, a), min(b, s.total)) for (a, b), s in zip(ranges, streams, strict=True)]
    results = [np.zeros((max(0, b - a), s.channels), np.int64) for (a, b), s in zip(ranges, streams, strict=True)]
    base = np.cumsum([0, *(len(s) for s in stored)])
    bits = _Bits(np.frombuffer(b"".join(stored), np.uint8))
    lanes = []
    for i, s in enumerate(streams):
        points = sorted(set(s.seek) | {(0, 0)}) if s.total else []
        stops = [p[0] for p in points[1:]] + [s.total]
        lanes += [(i, sample, min(stop, ranges[i][1]), base[i] + s.at + offset) for (sample, offset), stop in zip(points, stops, strict=True) if stop > ranges[i][0] and sample < ranges[i][1]]
    if lanes:
        stream, sample, stop, at = (np.array(x, np.int64) for x in zip(*lanes, strict=True))
        at = at * 8
        limit = base[1:][stream] * 8
        bps = np.array([s.bits for s in streams])
        channels = np.array([s.channels for s in streams])
        todo = np.flatnonzero(sample < stop)
        while len(todo):
            begin = at[todo]
            if (begin + 64 > limit[todo]).any():
                raise FlacError("frames are cut off")
            if (bits.read(begin, 15) != 0x7FFC).any():
                raise FlacError("a frame without its sync code")
            codes = bits.read(begin + 16, 16)
            block_code, rate_code, mode, depth_code = codes >> 12, (codes >> 8) & 15, (codes >> 4) & 15, (codes >> 1) & 7
            place = begin + 32
            lead = bits.read(place, 8)
            more = np.where(lead < 0x80, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, np.where(lead < 0xFC, 4, np.where(lead < 0xFE, 5, 6))))))
            place = place + 8 + 8 * more
            size = np.zeros(len(todo), np.int64)
            for c in np.unique(block_code):
                of = block_code == c
                if c in (6, 7):
                    size[of] = bits.read(place[of], 8 * (c - 5)) + 1
                    place[of] += 8 * (c - 5)
                elif c in BLOCK_SIZES:
                    size[of] = BLOCK_SIZES[c]
                else:
                    raise FlacError("reserved block size")
            place = place + np.where(rate_code == 12, 8, np.where((rate_code == 13) | (rate_code == 14), 16, 0))
            if (crc_spans(bits.data, begin >> 3, place >> 3, CRC8, 8) != bits.read(place, 8)).any():
                raise FlacError("a frame header fails its CRC-8")
            place = place + 8
            depth = bps[stream[todo]].copy()
            for c, b in SAMPLE_BITS.items():
                depth[depth_code == c] = b
            for n, m in {(int(a), int(b)) for a, b in zip(size, mode, strict=True)}:
                of = np.flatnonzero((size == n) & (mode == m))
                if m > 10 or (channels[stream[todo[of]]] != (m + 1 if m < 8 else 2)).any():
                    raise FlacError("channels don't fit the stream")
                spot, signals = place[of], []
                for c in range(m + 1 if m < 8 else 2):
                    side = (m == 8 and c == 1) or (m == 9 and c == 0) or (m == 10 and c == 1)
                    got, spot = _subframes(bits, spot, n, depth[of] + side)
                    signals.append(got)
                if m == 8:
                    signals[1] = signals[0] - signals[1]
                elif m == 9:
                    signals[0] = signals[0] + signals[1]
                elif m == 10:
                    mid, diff = (signals[0] << 1) | (signals[1] & 1), signals[1]
                    signals = [(mid + diff) >> 1, (mid - diff) >> 1]
                place[of] = spot
                lane = todo[of]
                who, where = stream[lane], sample[lane]
                take = np.minimum(n, stop[lane] - where)
                rows = np.stack(signals, axis=2)  # (n, lanes, channels)
                for j in range(len(of)):
                    at_first = where[j] - ranges[who[j]][0]
                    if at_first + take[j] > 0:
                        results[who[j]][max(0, at_first) : at_first + take[j]] = rows[max(0, -at_first) : take[j], j]
            place = (place + 7) & ~7
            if (place + 16 > limit[todo]).any():
                raise FlacError("frames are cut off")
            if (crc_spans(bits.data, begin >> 3, place >> 3, CRC16, 16) != bits.read(place, 16)).any():
                raise FlacError("a frame fails its CRC-16")
            at[todo] = place + 16
            sample[todo] += size
            todo = todo[sample[todo] < stop[todo]]
    for s, got in zip(streams, results, strict=True):
        if whole and s.md5 != bytes(16) and hashlib.md5(pcm_bytes(got, s.bits)).digest() != s.md5:
            raise FlacError("the samples fail their MD5")
    return results


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian signed PCM, whole bytes a sample."""
    width = (bits + 7) // 8
    return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
