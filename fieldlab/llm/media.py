"""Media columns: texts (or any bytes) as FLAC streams, decoding to PCM blocks.

PCM blocks hold ``PCM_BLOCK`` samples and are known by their first sample's number; the seek
table leads from any such number to the frames that hold the block.

Cases: a null text counts as empty; an empty text becomes one block of spaces; repeated
rows get equal streams; an empty table gives an empty result; extra columns are dropped.
Documents are taken in chunks of whole texts, so memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import flac
from . import textkit as tk

PAD = 32
PCM_BLOCK = 4096
#: Samples of one stream that are decoded together.
PCM_STRETCH = 1 << 22
#: Bytes that one call of the codec takes together.
MEDIA_CHUNK = 2 << 20


def _store(every: int, lpc_order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offs in tk.chunks(batch, "text", MEDIA_CHUNK):
                payloads = []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    short = -(b - a) % flac.BLOCK if b > a else flac.BLOCK
                    payloads.append(np.concatenate([data[a:b], np.full(short, PAD, np.uint8)]))
                media = flac.encode_chunk(payloads, every=every, lpc_order=lpc_order)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def store(docs: DataFrame, every: int = 4, lpc_order: int = 2) -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded with spaces to a positive multiple of
    192 bytes, as a mono 8-bit stream with a seek point every ``every`` blocks."""
    return docs.select("doc_id", "text").mapInArrow(_store(every, lpc_order), "doc_id long, n_bytes long, media binary")


def _groups(media: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, m in enumerate(media):
        held += len(m)
        if held >= limit:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(media):
        yield lo, len(media)


def features(samples: np.ndarray) -> str:
    """Energy, zero crossings, peak and mean of the samples, as exact integers."""
    x = samples.astype(np.int64).ravel()
    if not len(x):
        return "energy=0;crossings=0;peak=0;sum=0"
    return f"energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())};sum={int(x.sum())}"


def pcm_of(samples: np.ndarray, bits: int, first: int = 0, size: int = PCM_BLOCK) -> list[tuple[int, bytes]]:
    """(sample_at, pcm) of samples that begin at number ``first``."""
    return [(first + a, flac.pcm_bytes(samples[a : a + size], bits)) for a in range(0, len(samples), size)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_blocks", "tail_at"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        media = batch.column("media").to_pylist()
        for lo, hi in _groups(media, MEDIA_CHUNK):
            some, rows = media[lo:hi], []
            decoded = [(pcm_of(samples, 8), features(samples)) for samples in flac.decode_streams(some)]
            # the last block once more, by its sample number through the seek table
            tails = flac.decode_streams(some, [(blocks[-1][0], blocks[-1][0] + PCM_BLOCK) for blocks, _ in decoded])
            for stored, (blocks, feature), tail in zip(some, decoded, tails, strict=True):
                if flac.pcm_bytes(tail, 8) != blocks[-1][1]:
                    raise flac.FlacError("a seek point leads elsewhere")
                payload = _unsigned(b"".join(pcm for _, pcm in blocks))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(_unsigned(flac.pcm_bytes(tail[-16:], 8))), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(blocks), blocks[-1][0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("n_bytes").slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)


def _unsigned(pcm: bytes) -> bytes:
    """Signed 8-bit samples as the payload's bytes."""
    return (np.frombuffer(pcm, np.uint8) ^ 128).tobytes()


def digest(media: DataFrame) -> DataFrame:
    """Read every stored stream of ``store`` back, with its checksums, as PCM blocks and
    describe it; the tail is read by its sample number."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_blocks long, tail_at long")


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = size * max(1, PCM_STRETCH // size)
        for batch in batches:
            media = batch.column("media").to_pylist()
            for key, stored in zip(batch.column("doc_id").to_pylist(), media, strict=True):
                if stored is None:
                    continue
                s = flac.Stream(stored)
                for first in range(0, s.total, stretch):
                    (samples,) = flac.decode_streams([stored], [(first, first + stretch)] if s.total > stretch else None)
                    blocks = pcm_of(samples, s.bits, first, size)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(blocks), pa.int64()), pa.array([a for a, _ in blocks], pa.int64()), pa.array([s.rate] * len(blocks), pa.int32()), pa.array([s.channels] * len(blocks), pa.int32()), pa.array([pcm for _, pcm in blocks], pa.binary())], ["doc_id", "sample_at", "rate", "channels", "pcm"])

    return run


def pcm_blocks(media: DataFrame, size: int = PCM_BLOCK) -> DataFrame:
    """(doc_id, sample_at, rate, channels, pcm): PCM in blocks of ``size`` samples, each
    found by its first sample's number; long streams are decoded by stretches.  Null media
    give no block."""
    return media.select("doc_id", "media").mapInArrow(_blocks(size), "doc_id long, sample_at long, rate int, channels int, pcm binary")


def _seek(start: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, media = batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()
            of = [k for k, m in enumerate(media) if m is not None]
            got = flac.decode_streams([media[k] for k in of], [(start, start + n)] * len(of))
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in of], pa.int64()), pa.array([flac.pcm_bytes(x, flac.Stream(media[k]).bits) for k, x in zip(of, got, strict=True)], pa.binary())], ["doc_id", "pcm"])

    return run


def seek(media: DataFrame, start: int, n: int) -> DataFrame:
    """(doc_id, pcm): samples start to start + n of every stream, read from the seek point
    before them; empty beyond a stream's end."""
    return media.select("doc_id", "media").mapInArrow(_seek(start, n), "doc_id long, pcm binary")
