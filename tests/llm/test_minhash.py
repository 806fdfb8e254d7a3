import random

import numpy as np
import pytest

from fieldlab.llm import exchange, minhash

from .fixtures import frame, odd_rows, words


def shingle_set(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)])


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if least.get(r) is None else min(least[r], i if i is not None else least[r])
    return sorted(((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect()), key=str)


def near_copies(seed, n=80, longest=80):
    rng = random.Random(seed)
    base = [[rng.choice(["a", "b", "c", f"w{k}", f"v{j}"]) for j in range(rng.randint(1, longest))] for k in range(9)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["A", "B", "edit", f"e{i}"])
        if rng.random() < 0.3:
            w += [f"t{i}x{j}" for j in range(rng.randint(0, 8))]
        rows.append((i * 7 % 71, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,longest", [(0, 80), (2, 14)])
def test_brute_force(spark, seed, longest, monkeypatch):
    monkeypatch.setattr(exchange, "GROUP_BYTES", 3000)
    rows = near_copies(seed, longest=longest)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rounds", [0, 1])
def test_rounds_lose_no_link(spark, rounds, monkeypatch):
    monkeypatch.setattr(minhash, "STAR_ROUNDS", rounds)
    rows = near_copies(6, n=60)
    assert run(spark, rows) == brute(rows)


def test_odd_rows_a_large_group_and_a_common_passage(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = odd_rows() + [(None, "alone here"), (12, "One"), (13, "one"), (None, "oNE"), (14, "one two three four"), (15, "ONE two three four")]
    for i in range(100, 180):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(200, 230):
        rows.append((i, " ".join(base[:40] + [f"y{i}_{k}" for k in range(12)])))
    assert run(spark, rows) == brute(rows)


def test_empty_and_extra_columns(spark):
    docs = frame(spark, near_copies(1)).withColumnRenamed("lang", "sid").withColumnRenamed("source", "signature").withColumnRenamed("n_chars", "root")
    assert minhash.near_duplicates(docs.where("doc_id > 1000")).count() == 0
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str) == brute(near_copies(1))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    one, other = (np.concatenate([shared, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(2))
    sig = minhash.signatures(np.concatenate([one, other]), np.array([0, 900]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.15
    assert len({*sig[0].tolist()}) == minhash.COORDINATES
