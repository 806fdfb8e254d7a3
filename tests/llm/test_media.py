import hashlib
import zlib

import numpy as np
import pytest

from fieldlab.llm import flac, media

from .fixtures import frame, odd_rows


def payload(text):
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % 192 if raw else 192)


def test_streams_give_back_every_text(spark):
    rows = odd_rows()
    got = {(r.doc_id, r.payload_sha256): r for r in media.digest(media.store(frame(spark, rows))).collect()}
    for key, text in rows:
        p = payload(text)
        r = got[key, hashlib.sha256(p).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len((text or "").encode()), len(p), zlib.crc32(p[-16:]))
    assert media.digest(media.store(frame(spark, rows).where("doc_id > 99"))).count() == 0


def test_all_bytes_and_predictors_round_trip():
    rng = np.random.default_rng(1)
    wave = (100 * np.sin(np.arange(192 * 8) / 9) + 128).astype(np.uint8)
    spike = np.zeros(192 * 3, np.uint8)
    spike[300] = 255
    many = [wave, rng.integers(0, 256, 192 * 5).astype(np.uint8), spike, np.full(192, 32, np.uint8), np.tile(wave[:192], 400)]
    for order in (0, 2, 8):
        stored = flac.encode_chunk(many, lpc_order=order)
        assert len(stored[0]) < len(many[0])
        for p, s in zip(many, flac.decode_streams(stored), strict=True):
            assert np.array_equal(s[:, 0] + 128, p)


@pytest.mark.parametrize("at", [60, -1, -40])
def test_damage_is_found(at):
    wave = (100 * np.sin(np.arange(192 * 9) / 9) + 128).astype(np.uint8)
    stored = bytearray(flac.encode_chunk([wave])[0])
    stored[at if at < 0 else len(stored) // 2] ^= 1
    with pytest.raises(flac.FlacError):
        flac.decode_streams([bytes(stored)])
    with pytest.raises(flac.FlacError):
        flac.decode_streams([bytes(stored[: len(stored) // 2])])


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, width):
        self.s += format(value & ((1 << width) - 1), f"0{width}b") if width else ""
        return self

    def bytes(self):
        self.s += "0" * (-len(self.s) % 8)
        return bytes(int(self.s[i : i + 8], 2) for i in range(0, len(self.s), 8))


def frame_bytes(body, channels, number, size):
    head = bytes([0xFF, 0xF8, 0x70, (channels << 4) | 0x08, number]) + (size - 1).to_bytes(2, "big")
    one = lambda b, t, n: int(flac.crc_spans(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), t, n)[0])
    head += bytes([one(head, flac.CRC8, 8)])
    out = head + body
    return out + one(out, flac.CRC16, 16).to_bytes(2, "big")


def stream(frames, total, channels, pcm=None):
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + ((44100 << 44) | ((channels - 1) << 41) | (15 << 36) | total).to_bytes(8, "big")
    info += hashlib.md5(pcm).digest() if pcm is not None else bytes(16)
    return b"fLaC\x80\x00\x00\x22" + info + b"".join(frames)


def test_mid_side_escapes_wasted_bits_and_linear_predictor():
    n = 16
    rng = np.random.default_rng(5)
    left, right = rng.integers(-900, 900, n) * 4, rng.integers(-900, 900, n) * 4
    mid, side = (left + right) >> 1, left - right
    b = Bits()
    b.put(1 << 1 | 1, 8).put(1, 1)  # mid: verbatim with one wasted bit
    for v in mid:
        b.put(int(v) >> 1, 15)
    residual = side[2:] - ((3 * side[1:-1] - side[:-2]) >> 1)
    b.put((0x20 | 1) << 1, 8)  # side: linear predictor of order 2
    for v in side[:2]:
        b.put(int(v), 17)
    b.put(4, 4).put(1, 5).put(3, 5).put(-1, 5).put(1, 2).put(1, 4)  # Rice of the second kind, two partitions
    b.put(31, 5).put(18, 5)  # the first escaped
    for v in residual[:6]:
        b.put(int(v), 18)
    b.put(10, 5)
    for v in residual[6:]:
        u = int(v) * 2 if v >= 0 else -2 * int(v) - 1
        b.put(1, (u >> 10) + 1).put(u, 10)
    assert np.all(mid % 2 == 0)
    pcm = np.stack([left, right], axis=1).astype("<i2").tobytes()
    made = stream([frame_bytes(b.bytes(), 10, 0, n)], n, 2, pcm)
    (got,) = flac.decode_streams([made])
    assert np.array_equal(got, np.stack([left, right], axis=1))


def test_pcm_blocks_are_seekable(spark):
    docs = frame(spark, [(1, "abc" * 500), (2, None)])
    rows = media.pcm_blocks(media.store(docs), size=100).orderBy("doc_id", "sample_at").collect()
    one = b"".join(bytes(r.pcm) for r in rows if r.doc_id == 1)
    assert bytes((b + 128) % 256 for b in one) == payload("abc" * 500)
    assert [r.sample_at for r in rows if r.doc_id == 2] == [0, 100]


def test_seek_reads_any_sample(spark):
    rng = np.random.default_rng(3)
    texts = [(k, "".join(chr(97 + x) for x in rng.integers(0, 26, n))) for k, n in enumerate((10, 5000, 20_000))] + [(9, None)]
    stored = media.store(frame(spark, texts)).cache()
    whole = {k: payload(t) for k, t in texts}
    for start, n in ((0, 16), (4096, 300), (4999, 10_000), (60_000, 5)):
        got = {r.doc_id: media._unsigned(bytes(r.pcm)) for r in media.seek(stored, start, n).collect()}
        assert got == {k: p[start : start + n] for k, p in whole.items()}


def test_long_streams_are_decoded_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(media, "PCM_STRETCH", 1000)
    text = "".join(chr(97 + k * k % 26) for k in range(5000))
    from pyspark.sql import functions as F

    rows = media.pcm_blocks(media.store(frame(spark, [(1, text)])), size=300).orderBy("sample_at").select("sample_at", F.length("pcm").alias("n"), "pcm").collect()
    assert [r.sample_at for r in rows] == list(range(0, len(payload(text)), 300))
    assert b"".join(media._unsigned(bytes(r.pcm)) for r in rows) == payload(text)
