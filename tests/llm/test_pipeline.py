import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fieldlab.llm import toxicity  # noqa: E402

from .fixtures import frame, words  # noqa: E402
from .test_classifiers import corpus  # noqa: E402
from .test_decontaminate import brute as leaks  # noqa: E402
from .test_jaccard import brute as components  # noqa: E402
from .test_mixing import brute as mix  # noqa: E402
from .test_repair import whole  # noqa: E402


def write(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_run_follows_every_stage(spark, tmp_path):
    rows, labels = corpus(7, 160)
    item = "this benchmark question must not be found in any training text at all"
    rows = [(i, t, f"s{i % 3}") for i, t in rows] + [(900 + k, f"unique{k} lead {item} and more{k}", "s1") for k in range(3)] + [(800 + k, rows[k][1].upper(), "s2") for k in range(9)]
    docs = frame(spark, rows)
    path = str(tmp_path / "tables")
    write(spark, path, docs, labels, [(1, item)])
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    assert 10 < len(toxic) < len(rows) / 2
    left = [r for r in rows if r[0] not in toxic]
    least = {i: c for i, _, c in components([(i, t) for i, t, _ in left])}
    left = [r for r in left if least[r[0]] == r[0]]
    bad = {i for i, _, _ in leaks([(i, t) for i, t, _ in left], [(1, item)], 8, 0.1)}
    assert bad == {900, 901, 902} - toxic
    left = [r for r in left if r[0] not in bad]
    times = {i: -(-taken // n) if n else 1 for i, n, _, _, taken in mix(left)}
    want = sorted((i, t) for i, t, _ in left for _ in range(times[i]))
    ids = whole([t for _, t in want])
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in corpus_pipeline.run(spark, path).collect())
    at, expected = 0, []
    for (i, _), x in zip(want, ids, strict=True):
        expected.append((i, at, len(x)))
        at += len(x)
    assert got == sorted(expected)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = frame(spark, [(1, "a b c", "s"), (2, None, None), (None, "d", "t")])
    path = str(tmp_path / "tables")
    write(spark, path, docs, [(1, 1, 0)], [(1, "x")])
    for rows in (docs, docs.where("doc_id > 50")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, path)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * rows.count()


def test_query_is_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and os.path.exists(corpus_pipeline.__file__)
    assert words(None) == []
