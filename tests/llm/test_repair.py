import zlib

import numpy as np
import pytest

from fieldlab.llm import repair
from fieldlab.llm import textkit as tk

from .fixtures import frame, odd_rows, thue_morse

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer

    return [e.ids + [repair.END_ID] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_words_encode_like_whole_texts():
    texts = ["", " ", "A b  c", "don't STOP<|endoftext|> x<|ENDOFTEXT|>", "café café ́x a\u0085b 　 ΑΣ ΑΣ. é", "12 345 $$$x%%% 'll", "tab\tx\x0by\x1cz"]
    raw = [t.encode() for t in texts]
    ids, n = repair.WordEncoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.split(ids, np.cumsum(n)[:-1]) and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == whole(texts)


def encoded(texts):
    raw = [t.encode() for t in texts]
    ids, n = repair.WordEncoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_structured_words():
    texts = [thue_morse(n, swap) for n in (8, 16, 32, 1024, 2048) for swap in (False, True)]
    assert encoded(texts) == whole(texts)


def test_units_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tk, "span_hash", lambda data, starts, ends: ((ends - starts) % 3).astype(np.uint64))
    texts = ["one two six ten a b c abcdefgh abcdefgi x" + "y" * k + " aaaaaaaaa aaaaaaaaaa 12 12a" for k in range(30)]
    assert encoded(texts) == whole(texts)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 400, 60)
    ids = np.where(rng.random(lengths.sum()) < 0.7, rng.integers(0, 4, lengths.sum()), rng.integers(0, 49408, lengths.sum()))
    names = [None, *range(59)]
    block = repair.Block(repair.write_block(names, ids, lengths, rounds=5, least=3))
    assert block.doc_ids == names and len(block.rules) > 0 and len(block.seq) < len(ids)
    assert np.array_equal(block.ids(), ids)
    parts = np.split(ids, np.cumsum(lengths)[:-1])
    for k in (0, 7, 59):
        assert np.array_equal(block.document(k), parts[k])
        for at in (0, len(parts[k]) // 2, len(parts[k]) - 1):
            assert block.id_at(k, at) == parts[k][at]


@pytest.mark.parametrize("seed", range(3))
def test_no_frequent_pair_is_left(seed):
    rng = np.random.default_rng(seed)
    passages = [rng.integers(0, 49408, n) for n in (40, 300, 2000)]
    parts = [np.concatenate([passages[rng.integers(3)], rng.integers(0, 300, rng.integers(1, 400))]) for _ in range(60)]
    ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
    block = repair.Block(repair.write_block(list(range(60)), ids, lengths))
    assert np.array_equal(block.ids(), ids) and block.sizes.max() > 8 and len(block.per_round) > 3
    last = np.zeros(len(block.seq), bool)
    last[np.append(block.starts[1:], len(block.seq)) - 1] = True
    pairs = (block.seq[:-1].astype(np.int64) << 32 | block.seq[1:])[~last[:-1]]
    assert np.unique(pairs, return_counts=True)[1].max() < 8
    for k, part in enumerate(parts):
        assert np.array_equal(block.document(k), part) and block.id_at(k, len(part) - 1) == part[-1]


def test_single_symbol_runs():
    ids = np.full(1001, 7)
    block = repair.Block(repair.write_block([5], ids, np.array([1001])))
    assert np.array_equal(block.ids(), ids) and block.id_at(0, 1000) == 7


def test_files_hold_every_document_in_order(spark, tmp_path):
    rows = odd_rows() + [(None, "no id"), (100, "a b")]
    path = repair.write_ids(frame(spark, rows), PATH, str(tmp_path / "ids"), block_ids=500)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in repair.read_ids(spark, path).collect())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for (key, _), ids in zip(ordered, whole([t or "" for _, t in ordered]), strict=True):
        want.append((key is not None, key or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_empty_table(spark, tmp_path):
    path = repair.write_ids(frame(spark, [(1, "x")]).where("doc_id < 0"), PATH, str(tmp_path / "ids"))
    assert repair.read_ids(spark, path).count() == 0


def test_chunks_cover_whole_texts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array([None, "ab", "c" * 50, ""])})
    seen = [data[a:b].tobytes() for _, _, data, offs in tk.chunks(batch, "text", 10) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert seen == [b"", b"ab", b"c" * 50, b""]
