"""Every operator and stage on documents whose other columns are named like its own."""

import pytest
from pyspark.sql import functions as F

from fieldlab.llm import decontaminate, jaccard, media, mixing, phrases, quality, repair, suffixes, toxicity

from .fixtures import frame, odd_rows

public_tokenizers = pytest.importorskip("public_tokenizers")

NAMES = ["score", "row", "row_0", "times", "g", "tag", "size", "key", "n", "label", "part", "Score", "bucket", "media"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = odd_rows() + [(None, None), (30, "a b c d e f g " * 3), (31, "a b c d e f g " * 3)]
    out = frame(spark, rows)
    for k, name in enumerate(NAMES):
        if name.lower() not in {c.lower() for c in out.columns}:
            out = out.withColumn(name, F.lit(k))
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_operators(spark, docs, labels, tmp_path):
    items = spark.createDataFrame([(1, "one two three four"), (2, None)], "item_id long, text string")
    n = docs.count()
    assert media.digest(media.store(docs)).count() == n
    assert toxicity.classify(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]
    assert jaccard.join(docs).count() == n
    assert suffixes.dedup(docs).count() == n
    assert decontaminate.matches(docs, items).count() == 1
    assert mixing.mix(docs).count() == n
    assert phrases.dedup(docs).count() == n
    path = repair.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "ids"))
    assert repair.read_ids(spark, path).count() == n
    assert quality.classify(docs, labels).count() == n


def test_stages(spark, docs, labels, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).count() == left.count()
