import hashlib
import random

import numpy as np
import pytest

from fieldlab.llm import suffixes

from .fixtures import frame, odd_rows, thue_morse


def brute(rows, length):
    seen = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    return sorted((tuple(r) for r in suffixes.dedup(frame(spark, rows), **how).collect()), key=str)


def pieces(seed, n=40):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 160))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool) for _ in range(rng.randint(0, 3))] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))]
        t = "".join(parts)
        if t and rng.random() < 0.5:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rows = pieces(seed)
    assert run(spark, rows, length=40, gram=8) == brute(rows, 40)


def lines(n=30):
    """One long line in changing surroundings, some of them shared."""
    line = "the same long line that stands on every page "
    return [(i, f"{'left' * (i % 4)}{chr(97 + i % 5)}{line}{chr(97 + i % 3) * (i % 7)}{i if i % 2 else ''}") for i in range(n)]


@pytest.mark.parametrize("most", [1, 4])
def test_crowded_anchors_are_divided(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "PACKET_RUNS", most)
    rows = pieces(7) + [(100 + i, t) for i, t in lines()]
    assert run(spark, rows, length=40, gram=8) == brute(rows, 40)


def test_low_entropy_and_odd_rows(spark):
    rows = odd_rows() + [(20, "a" * 401), (21, "ab" * 300), (22, "x" * 399), (None, "z" * 400), (23, "y" * 400), (23, "y" * 400)]
    assert run(spark, rows) == brute(rows, 400)


def test_empty_table_and_kept_bytes(spark):
    assert suffixes.dedup(frame(spark, [(1, "x")]).where("doc_id > 5")).count() == 0
    (row,) = suffixes.dedup(frame(spark, [(1, "q" * 500 + "ü")]), texts=True).collect()
    assert bytes(row.kept).decode() == "ü"


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, rng.integers(1, 6), rng.integers(1, 200))
    got = suffixes.suffix_array(s, 1000).tolist()
    assert got == sorted(range(len(s)), key=lambda k: s[k:].tolist())
    shallow = suffixes.suffix_array(s, 8)
    heads = [tuple(s[k : k + 8].tolist()) for k in shallow]
    assert heads == sorted(heads) and sorted(shallow.tolist()) == list(range(len(s)))


def test_structured_bytes(spark):
    rows = [(1, "x" + thue_morse(2048)), (2, "x" + thue_morse(2048, swap=True)), (3, thue_morse(1024)), (4, "#" * 300 + thue_morse(1024, swap=True))]
    assert run(spark, rows, length=1024, gram=8) == brute(rows, 1024)
    assert run(spark, rows) == brute(rows, 400)
