"""A training-data pipeline of corpus operators over the documents table.

``STAGES`` are applied in order, each to all that its predecessor kept, with the result
written as Parquet and read again in between:

* toxicity: documents scored at or above 0.5 go;
* near_duplicates: of each component of 5-word shingle sets linked from a similarity of
  0.75, the smallest doc_id stays;
* decontamination: documents that hold a benchmark item within 10 % edits go;
* mixing: a document stays if the mix of its sources takes any of its words;
* tokens: the ids of what is left as grammar blocks, read back as one row a document.

All but the last return the columns of documents.  What a stage wrote is deleted once the
next one has read it; only the rows that ``tokens`` reads stay in the shared folder.

Cases: null and empty texts are never toxic by their words, are nobody's copy, hold no item
and cost no budget, so they reach the end; null ids stay and come first among the tokens;
rows alike in id and text count once after the near duplicates; extra columns, also ones
named like those that stages add, are kept up to the last stage; empty tables give no rows;
very long texts are held whole by one task at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm import decontaminate, jaccard, mixing, repair, toxicity
from fieldlab.llm.common import discard, free_name, materialize, table
from fieldlab.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "score")
    return toxicity.score(docs, model, keep=tuple(docs.columns), name=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_taken(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return repair.read_ids(spark, repair.write_ids(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_leaks), ("mixing", mix_sources), ("tokens", write_tokens)]

#: The classifier, the alignment and the tokenizer have no SQL form; tests compare with
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
