import random

import numpy as np
import pytest

from fieldlab.llm import decontaminate as dc

from .fixtures import frame, odd_rows


def norm(text):
    return " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate({c: " " for c in [9, 10, 11, 12, 13]}).split(" ")).strip(" ")


def squeeze(text):
    out = norm(text)
    while "  " in out:
        out = out.replace("  ", " ")
    return out.encode()


def distance(item, text):
    """Fewest edits of item against any substring of text."""
    row = [0] * (len(text) + 1)
    for r, a in enumerate(item, 1):
        new = [r]
        for c, b in enumerate(text, 1):
            new.append(min(row[c - 1] + (a != b), row[c] + 1, new[c - 1] + 1))
        row = new
    return min(row)


def brute(rows, items, q, rate):
    out = set()
    for i, t in rows:
        x = squeeze(t)
        for k, s in items:
            y = squeeze(s)
            if not y:
                continue
            budget = min(int(rate * len(y)), (len(y) - q) // q) if len(y) >= q else 0
            if (e := distance(y, x)) <= budget:
                out.add((i, k, e))
    return out


def noisy(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        at = rng.randrange(len(s))
        s[at : at + 1] = rng.choice([[], ["#"], [s[at], "+"]])
    return "".join(s)


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 25)))) for k in range(12)] + [(90, None), (91, " "), (92, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (93, "ab")]
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.7:
            _, t = rng.choice(items[:12])
            parts.insert(rng.randint(0, 1), noisy(rng, t.upper() if rng.random() < 0.3 else t, rng.randint(0, len(t) // 8)))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(50, "a" * 200), (51, None), (52, ""), (53, "ab")]
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == brute(rows, items, dc.Q, dc.RATE)
    texts, by = dict(rows), dict(items)
    for r in got:
        part = squeeze(texts[r.doc_id])[r.start : r.stop]
        assert 0 <= r.start <= r.stop and distance(squeeze(by[r.item_id]), part) == r.edits
    bad = {r.doc_id for r in got}
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - bad


def test_a_large_benchmark_goes_in_parts(spark):
    bench = spark.createDataFrame([(k, f"benchmark item number {k} of many") for k in range(9)], "item_id long, text string")
    assert [i for ids, _ in dc.parts_of(bench, 70) for i in ids] == list(range(9))
    assert len(list(dc.parts_of(bench, 70))) == 5


def test_odd_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "nothing like this occurs anywhere")], "item_id long, text string")
    docs = frame(spark, odd_rows())
    assert dc.matches(docs, bench).count() == 0 and dc.clean(docs, bench).count() == len(odd_rows())
    assert dc.matches(docs, bench.where("item_id > 3")).count() == 0
    assert dc.matches(docs.where("doc_id > 99"), bench).count() == 0


def test_folding_keeps_documents_apart():
    raw = [b" A  b\n", b"", b"  ", b"c d"]
    data, offs = dc.folded(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [b"a b", b"", b"", b"c d"]


def test_a_long_repetitive_text_takes_bounded_memory():
    import tracemalloc

    items = dc.Items([1, 2], [b"a" * 200, b"ab" * 100])
    data = np.full(1 << 20, 97, np.uint8)
    tracemalloc.start()
    found = dc.find(items, data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 1, 0, 0, 200)] and peak < 500 << 20
