import hashlib
from collections import defaultdict

import pytest

from fieldlab.llm import mixing

from .fixtures import frame, odd_rows, words


def brute(rows, weights=(5, 2, 1), share=1.5, epochs=2):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    goal = {s: 0.0 for s in names}
    rest, free = share * sum(size.values()), list(names)
    while free and rest > 1e-9:
        part = rest / sum(w[s] for s in free)
        over = [s for s in free if goal[s] + part * w[s] > epochs * size[s]]
        if not over:
            for s in free:
                goal[s] += part * w[s]
            break
        # what a capped source can't take is shared again
        goal = {s: (epochs * size[s] if s in over or s not in free else 0.0) for s in names}
        free = [s for s in free if s not in over]
        rest = share * sum(size.values()) - sum(goal.values())
    out = []
    for s in names:
        budget = int(goal[s] + 1e-9)
        own = sorted(((hashlib.md5(str(i).encode() if i is not None else b"").hexdigest(), i or 0, len(words(t)), i) for i, t, z in rows if z == s), key=lambda r: r[:3])
        whole = budget // size[s] if size[s] else 0
        left = budget - whole * size[s]
        for _, _, n, i in own:
            more = max(0, min(n, left))
            left -= more
            out.append((i, n, size[s], round(goal[s], 6), whole * n + more))
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["even", "hot", "odd"])
def test_brute_force(spark, case):
    if case == "odd":
        rows = [(*r, s) for r in odd_rows() for s in ("a", None)][:-3] + [(None, "x y", "b"), (None, "x y z", "b"), (77, None, "empty")]
    else:
        rows = [(k, " ".join(["w"] * (k % 17)), f"s{k % 7}" if case == "even" or k % 3 else "hot") for k in range(300)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(rows)
    for s in {r[2] for r in rows}:
        own = [r for r in got if r.doc_id in {x[0] for x in rows if x[2] == s}]
        assert all(r.taken <= 2 * r.size for r in own)
    kept = mixing.keep_taken(docs)
    assert kept.columns == docs.columns


def test_kept_rows_repeat_by_epoch(spark):
    docs = frame(spark, [(1, "a b c d", "s"), (2, "a b c e", "s"), (3, "", "s"), (4, " ".join("x" * 40), "t")]).selectExpr("*", "1 as row")
    kept = [r.doc_id for r in mixing.keep_taken(docs, weights=(1, 1), share=0.8).collect()]
    assert mixing.keep_taken(docs).columns == docs.columns
    assert kept.count(1) == 2 and kept.count(2) == 2 and kept.count(3) == 1


def test_empty_table(spark):
    assert mixing.mix(frame(spark, [(1, "x")]).where("doc_id > 1")).count() == 0
