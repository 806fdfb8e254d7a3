"""Typed literals in run logs: which logs hold readings and settings, of what kind and range.

Each row of the input is one log: ``doc_id``, ``text``, ``source`` (the machine or program
that wrote it), ``lang``.  Words that read as typed literals (bool, int, float, array, as in
configuration files) are counted for each log, with the least and greatest number and the
share of words that are literals, so that logs of measurements are told from prose, and runs
whose readings leave a range are found before they are parsed in full.

One scan, no shuffle: a log's words are looked at where its row is read.  The output has one
row a log, in folders by origin (``source`` with only letters, digits, ``.``, ``-`` and ``_``),
and only the folders of origins in the input are replaced, so a rerun on the same input leaves
the same files' content, and a run on one source's logs leaves the others alone.

Cases: a null or empty text has no words and null numbers; a null source goes to the folder
``none``; repeated rows stay; texts of any length are read whole; an empty input writes nothing.

    python -m jobs.log_literals --input documents.parquet --output out --config jobs/log_literals.json
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions import text as tx

from .common import LOG, command, counted, settings

SCHEMA = [
    ("input.format", "string", False, "parquet", "enum", None, None, ["parquet", "orc", "json"]),
    ("limits.low", "double", False, "-1.0E308", None, None, None, None),
    ("limits.high", "double", False, "1.0E308", None, None, None, None),
    ("output.digits", "int", False, "6", "range", 0.0, 12.0, None),
]

LOGS = "doc_id long, text string, lang string, source string"
OUT = "doc_id long, source string, lang string, n_words long, n_bool long, n_int long, n_float long, n_array long, least double, greatest double, density double, in_range boolean, origin string"

#: What a word that is a literal can begin with, besides the four words for a bool.
FIRST = list("+-.[0123456789")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def literals(logs: DataFrame, low: float, high: float, digits: int = 6) -> DataFrame:
    """One row a log: its literals by type, their range, and whether all lie within low and high."""
    every = logs.select("doc_id", "source", "lang", words(F.col("text")).alias("w"))
    few = F.filter("w", lambda x: F.substring(x, 1, 1).isin(FIRST) | F.lower(x).isin("true", "false", "yes", "no"))
    typed = every.select("doc_id", "source", "lang", F.size("w").cast("long").alias("n_words"), F.transform(few, lambda x: F.struct(tx.literal_type(x).alias("kind"), x.try_cast("double").alias("number"))).alias("typed"))
    count = lambda kind: F.size(F.filter("typed", lambda t: t["kind"] == kind)).cast("long").alias(f"n_{kind}")
    numbers = F.transform(F.filter("typed", lambda t: t["kind"].isin("int", "float")), lambda t: t["number"])
    rows = typed.select("doc_id", "source", "lang", "n_words", *(count(k) for k in ("bool", "int", "float", "array")), F.array_min(numbers).alias("least"), F.array_max(numbers).alias("greatest"))
    found = F.col("n_bool") + F.col("n_int") + F.col("n_float") + F.col("n_array")
    density = F.when(F.col("n_words") > 0, F.round(found / F.col("n_words"), digits)).otherwise(F.lit(0.0))
    inside = F.coalesce((F.col("least") >= low) & (F.col("greatest") <= high), F.lit(True))
    origin = F.coalesce(F.regexp_replace("source", "[^A-Za-z0-9._-]", "_"), F.lit("none"))
    return rows.select("*", density.alias("density"), inside.alias("in_range"), F.when(origin == "", "_").otherwise(origin).alias("origin"))


def run(spark: SparkSession, source: str, output: str, config: str | None = None, **given: object) -> DataFrame:
    """Read the logs of ``source``, write their literals to ``output``, return the whole output."""
    s = settings(spark, SCHEMA, config, **given)
    logs, read = counted(spark.read.format(s["input.format"]).load(source).selectExpr("cast(doc_id as long) doc_id", "text", "lang", "source"), "read")
    rows, wrote = counted(literals(logs, s["limits.low"], s["limits.high"], s["output.digits"]), "wrote")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin").parquet(output)
    LOG.info("read %d logs from %s, wrote %d rows to %s", read.get["rows"], source, wrote.get["rows"], output)
    return spark.read.schema(OUT).parquet(output)


if __name__ == "__main__":
    command(__doc__.splitlines()[0], lambda spark, a: run(spark, a.input, a.output, a.config), input="the logs", output="folder of the result")
