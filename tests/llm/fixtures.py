"""Small awkward documents shared by the tests, and brute-force helpers."""

import re

from pyspark.sql import types as T

WORD = re.compile("[^\x20\x09-\x0d]+")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows, partitions=3):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def odd_rows():
    long = " ".join(f"w{i % 97}x{i % 13}" for i in range(9000))
    return [(1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "one two  three\x0bfour"), (6, long), (7, "É a b ÑÑ zz"), (8, long), (8, long), (9, "x" * 5000)]


def thue_morse(n, swap=False):
    """A word of n letters a and b whose mirror has the same polynomial hash modulo 2**64."""
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(n))
