import random

import pytest

from fieldlab.llm import exchange, jaccard
from fieldlab.llm.components import components

from .fixtures import frame, odd_rows, thue_morse, words


def shingle_set(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


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
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if least.get(r) is None else min(least[r], i if i is not None else least[r])
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in jaccard.join(frame(spark, rows)).collect()), key=str)


def near_copies(seed, n=70, longest=60):
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


@pytest.mark.parametrize("seed,longest", [(0, 60), (1, 60), (2, 14), (3, 10)])
def test_brute_force(spark, seed, longest, monkeypatch):
    monkeypatch.setattr(exchange, "GROUP_BYTES", 1500)
    rows = near_copies(seed, longest=longest)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("boundary", [0, 4, 9, 12])
def test_any_boundary_gives_the_same(spark, boundary, monkeypatch):
    monkeypatch.setattr(jaccard, "boundary_of", lambda sets: boundary)
    rows = near_copies(5, longest=16)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rounds", [0, 1, 9])
def test_rounds_lose_no_link(spark, rounds, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    rows = near_copies(6, n=60, longest=30)
    assert run(spark, rows) == brute(rows)


def test_odd_rows_and_a_large_group(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = odd_rows() + [(None, "alone here"), (12, "One"), (13, "one")]
    for i in range(100, 220):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "a b c d e f"), (3, "x"), (3, "x"), (4, None), (None, "a b c d e f")]
    docs = frame(spark, rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (3, "x"), (4, None), (None, "a b c d e f")], key=str)
    assert jaccard.join(docs.where("doc_id > 10")).count() == 0


def test_one_of_each_of_repeated_ids(spark):
    one, other = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, one), (1, other), (2, one), (3, other), (4, "k l m n o p"), (5, "k l m n o p"), (5, "z y x w v"), (6, None), (6, ""), (7, "i j"), (7, "i j")]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(frame(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, one), (1, other), (4, "k l m n o p"), (5, "z y x w v"), (6, None), (6, ""), (7, "i j")], key=str)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (None, 1)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 200 + k) for k in range(1, 30)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {k: 100 for k in range(100, 141)} | {k: 200 for k in range(200, 230)}
    assert got == want


def test_structured_words(spark):
    rows = [(1, thue_morse(1024)), (2, thue_morse(1024, swap=True)), (3, "a b c d " + thue_morse(2048)), (4, "a b c d " + thue_morse(2048, swap=True)), (5, thue_morse(1024))]
    assert run(spark, rows) == brute(rows)


def test_relays(spark, monkeypatch):
    monkeypatch.setattr(exchange, "GROUP_BYTES", 900)
    monkeypatch.setattr(exchange, "BUCKET_HASHES", 60)
    monkeypatch.setattr(exchange, "RELAY_BUCKETS", 3)
    rows = near_copies(8)
    assert exchange.Exchange(frame(spark, rows)).ranges > 1
    assert run(spark, rows) == brute(rows)
