import random
import zlib

import numpy as np
import pytest

from fieldlab.llm import quality, toxicity

from .fixtures import frame, odd_rows


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def corpus(seed=0, n=600):
    """Toxic rows hold an insult; junk rows are made of marked words."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(5, 80)).split(" ")
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Moron.", "clown"]))
        if junk:
            words = [w + rng.choice(["%%%", "***", "$$$"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return docs, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def outside(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("module,place,least", [(toxicity, 2, 0.9), (quality, 1, 0.9)])
def test_held_out_accuracy(spark, module, place, least):
    docs, labels = corpus()
    got = {r.doc_id: r for r in module.classify(frame(spark, docs), label_frame(spark, labels)).collect()}
    assert len(got) == len(docs) and all(got[i].held_out == outside(i) for i, _ in docs)
    right = [got[r[0]].predicted == r[place] for r in labels if outside(r[0])]
    assert np.mean(right) > least and all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_held_out_labels_teach_nothing(spark, module):
    docs, labels = corpus(3, 120)
    flipped = [(i, 1 - q, 1 - t) if outside(i) else (i, q, t) for i, q, t in labels]
    one = {r.doc_id: r.score for r in module.classify(frame(spark, docs), label_frame(spark, labels)).collect()}
    two = {r.doc_id: r.score for r in module.classify(frame(spark, docs, 5), label_frame(spark, flipped)).collect()}
    assert one == two


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_missing_labels(spark, module):
    rows = odd_rows() + [(None, "idiot")]
    docs = frame(spark, rows).selectExpr("*", "1 as score", "2 as label")
    none = label_frame(spark, []).where("doc_id > 0")
    got = module.classify(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.0} and not any(r.held_out for r in got if r.doc_id is None)
    some = label_frame(spark, [(1, 1, 1), (1, 0, 0), (4, None, None), (6, 0, 0), (999, 1, 1)])
    assert len(module.classify(docs, some).collect()) == len(rows)
    assert module.classify(docs.where("doc_id > 99"), some).count() == 0


def test_weights_are_sparse_and_learn():
    model = toxicity.Ftrl(64, l1=1.0)
    rng = np.random.default_rng(0)
    for _ in range(400):
        label = int(rng.random() < 0.5)
        at = np.unique(np.append(rng.integers(8, 64, 5), [3] if label else [4]))
        model.learn(np.append(at, 64), label)
    w = model.weights(np.arange(65))
    assert w[3] > 0.5 > -0.5 > w[4] and (w[8:64] == 0).mean() > 0.3


def test_skip_grams_cross_no_document():
    data = np.frombuffer(b"a bc d", np.uint8)
    doc, slot = toxicity.grams(data, np.array([0, 3, 6]))
    assert sorted(doc.tolist()) == [0, 0, 0, 1, 1, 1] and len(set(slot.tolist())) == 6


def test_vectors_do_not_depend_on_partitions(spark):
    docs, _ = corpus(5, 60)
    assert np.array_equal(quality.word_vectors(frame(spark, docs, 1)), quality.word_vectors(frame(spark, docs, 7)))


def test_temperature_keeps_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0).astype(float)
    net = quality.Network().fit(x, y, epochs=20)
    assert np.array_equal(np.argsort(net.logit(x)), np.argsort(net.score(x))) and net.temperature > 0
