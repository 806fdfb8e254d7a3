import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldlab.llm import search

from .fixtures import frame, odd_rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c, n in docs:
            m = 25 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(spark, rows, items, k=10):
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search.rank(frame(spark, rows), asked, k).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"{'abcde'[k % 5]}{k}" for k in range(60)] + ["É", "ñu", "X9"]
    rows = [(rng.randrange(10 * n), " ".join(rng.choices(vocab, [1 / (1 + k) for k in range(len(vocab))], k=rng.randint(1, 50)))) for _ in range(n)]
    items = [(i, ", ".join(rng.choices(vocab, k=rng.randint(1, 20)))) for i in range(20)]
    return rows, items


@pytest.mark.parametrize("seed,size,k", [(0, 400, 10), (1, 1 << 20, 10), (2, 900, 3)])
def test_brute_force(spark, seed, size, k, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", size)
    monkeypatch.setattr(search, "ITEM_BLOCK", 7)
    monkeypatch.setattr(search, "OPEN", 2)
    rows, items = corpus(seed, 150)
    assert run(spark, rows, items, k) == brute(rows, items, k)


def test_odd_rows_ties_and_passes(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEM_BYTES", 20)
    rows = odd_rows() + [(None, "one tie"), (None, "one tie"), (30, "... !?"), (31, "one-two_THREE"), (32, "\x00one\x7fone"), (33, "é" * 3000)] + [(k, "one tie") for k in range(60, 40, -1)]
    items = [(1, "one"), (1, "one"), (1, "TWO three"), (2, None), (3, "..."), (None, "tie tie one"), (5, "É zz É"), (6, "nothing"), (7, "é" * 3000)]
    assert run(spark, rows, items) == brute(rows, items)


def test_empty_tables(spark):
    assert run(spark, [(1, None), (2, " .")], [(1, "a")]) == []
    docs = frame(spark, [(1, "a b")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert search.rank(docs, none).count() == 0
    assert search.rank(docs.where("doc_id > 1"), none).count() == 0


def test_clashing_columns(spark):
    rows, items = corpus(4, 40)
    docs = frame(spark, rows).withColumnRenamed("lang", "terms").withColumnRenamed("source", "item").withColumnRenamed("n_chars", "score")
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    assert sorted((tuple(r) for r in search.rank(docs, asked).collect()), key=str) == brute(rows, items)


def test_bounds_spare_most_of_the_tree():
    """One document that holds all of an item's rare terms is found without opening the rest."""
    texts = [f"common filler{k % 7} word{k}" for k in range(2000)]
    texts[1234] = "needle haystack common"
    data, offsets = search.tk.text_buffers(pa.array(texts))
    h, begins = search.terms(data, offsets)
    row = search.shard(pa.array(range(2000)), [(h, begins)], 2000, len(h))
    tree = search.Tree({c: row.column(c)[0] for c in row.schema.names})
    opened = 0

    def counted(self, tree, plain=search.Nodes.open):
        nonlocal opened
        opened += len(self.item)
        return plain(self, tree)

    best, w = search.Best(1, 1), np.array([9000, 9000, 1])
    wanted = np.concatenate([search.terms(*search.tk.text_buffers(pa.array([t])))[0] for t in ("needle", "haystack", "common")])
    plain = search.Nodes.open
    search.Nodes.open = counted
    try:
        search.walk(tree, [(wanted, w)], 0, best)
    finally:
        search.Nodes.open = plain
    assert best.doc[0, 0] == 1234 and opened < 200
