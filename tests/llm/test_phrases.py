import hashlib
import random

import pytest

from fieldlab.llm import exchange, phrases

from .fixtures import frame, odd_rows, thue_morse, words


def brute(rows, size=13):
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            t = tuple(w[k : k + size])
            first[t] = min(first.get(t, float("inf")), key(i))
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key(i):
                gone |= set(range(k, k + size))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in phrases.dedup(frame(spark, rows)).collect()), key=str)


def copies(seed, n=60):
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [p for p in rng.sample(pool, rng.randint(0, 4))] + [[f"u{i}x{j}" for j in range(rng.randint(0, 20))]]
        rng.shuffle(parts)
        w = [x for p in parts for x in p]
        if w and rng.random() < 0.4:
            w[rng.randrange(len(w))] = "edit"
        rows.append((i * 3 % 47, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(exchange, "GROUP_BYTES", 900)
    rows = copies(seed)
    assert run(spark, rows) == brute(rows)


def test_low_entropy_and_odd_rows(spark):
    rows = odd_rows() + [(20, "a " * 500), (21, "a " * 13), (22, "a " * 12), (None, "a " * 14), (23, "a b " * 100)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert phrases.dedup(frame(spark, [(1, "x")]).where("doc_id > 5")).count() == 0


def test_texts(spark):
    line = " ".join(f"w{i}" for i in range(15))
    rows = {r.doc_id: r.text for r in phrases.dedup_texts(frame(spark, [(1, "a  " + line), (2, line + "\nb")])).collect()}
    assert rows == {1: "a " + line, 2: "b"}


def test_structured_words(spark):
    for n in (1024, 2048):
        filler = " ".join(f"w{i}" for i in range(12))
        rows = [(1, f"{filler} {thue_morse(n)}"), (2, f"{filler} {thue_morse(n, swap=True)}"), (3, f"{filler} {thue_morse(n)}")]
        assert run(spark, rows) == brute(rows)


def test_automata_locate_and_nothing_else(spark):
    """What the automata don't find is not removed: of three documents of one group with one
    passage, the answers only name the passage once."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), (2, f"x {passage} y"), (3, f"{passage} z {passage}")]
    assert [r[2] for r in run(spark, rows)] == [0, 20, 40]


@pytest.mark.parametrize("limit,places", [(1, 4), (7, 4), (1000, 0), (1000, 1)])
def test_many_automata(spark, limit, places, monkeypatch):
    monkeypatch.setattr(exchange, "GROUP_BYTES", 4000)
    monkeypatch.setattr(phrases, "SHARD_WINDOWS", limit)
    monkeypatch.setattr(phrases, "BLOCK_PLACES", places)
    rows = copies(4)
    assert run(spark, rows) == brute(rows)


def test_relays(spark, monkeypatch):
    monkeypatch.setattr(exchange, "GROUP_BYTES", 500)
    monkeypatch.setattr(exchange, "BUCKET_HASHES", 60)
    monkeypatch.setattr(exchange, "RELAY_BUCKETS", 3)
    rows = copies(5) + odd_rows()
    dealt = exchange.Exchange(frame(spark, rows))
    assert dealt.ranges > 1 and dealt.groups // dealt.ranges > 1
    monkeypatch.setattr(exchange, "partitions", lambda spark: 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # each group's rows must meet wherever they are dealt
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
