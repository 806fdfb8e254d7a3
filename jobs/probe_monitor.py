"""Incremental stability report over probe readings: what a run's monitor would say, by day.

The input is a folder of Parquet files that grows: ``event_id``, ``ts``, ``user_id`` (the
probe), ``event_type`` (the field) and ``value``.  A file stream with ``availableNow`` takes
the files that its checkpoint hasn't seen, in batches of ``stream.files`` files, and ends.

Each batch writes two things, both by replacing whole folders, so that a batch that is run
again after a failure leaves the same result:

* ``partials/batch=N/day=D``: for each field its count, sum, sum of squares, extremes and flags
  in this batch alone;
* ``report/day=D``: for each day that the batch touches, all partials of that day merged and
  judged by the monitor's rules (bounds, CFL number, growth, NaN and infinity).

A day's merge reads that day's partials only, one row a field and batch, so the work of a run
follows what is new and never the history; late readings just renew their day.  A probe or
field that a third of all rows share is summed map-side before it is shuffled.

Cases: null values count as readings and nothing else; readings without a time or field are
reported under the day ``none`` and the field ``none``; repeated rows count again; a NaN or
infinite value makes its day Critical; an empty folder gives an empty report.  Files must not
be changed once they are there.

    python -m jobs.probe_monitor --input events --output out --checkpoint mark --config jobs/probe_monitor.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.operators import norms
from fieldlab.streaming import history

from .common import LOG, command, counted, settings

SCHEMA = [
    ("stream.files", "int", False, "64", "range", 1.0, 1000000.0, None),
    ("limits.low", "double", False, "-1.0E308", None, None, None, None),
    ("limits.high", "double", False, "1.0E308", None, None, None, None),
    ("limits.rms", "double", False, "1.0", "positive", None, None, None),
    ("grid.dx", "double", False, "1.0", "positive", None, None, None),
    ("time.dt", "double", False, "1.0", "positive", None, None, None),
]

READINGS = "event_id long, ts timestamp, user_id long, event_type string, value double"
PARTIAL = "field string, n long, valued long, total double, squares double, least double, greatest double, has_nan boolean, has_inf boolean, in_bounds boolean, batch long, day string"
REPORT = "field string, n long, mean double, rms double, least double, greatest double, status string, day string"


def partials(readings: DataFrame, low: float, high: float) -> DataFrame:
    """(day, field) sums and flags of some readings."""
    rows = readings.select(F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none")).alias("day"), F.coalesce("event_type", F.lit("none")).alias("field"), "value")
    v = F.col("value")
    sums = rows.groupBy("day", "field").agg(F.count("*").alias("n"), F.count(v).alias("valued"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("least"), F.max(v).alias("greatest"))
    return sums.join(norms.flags(rows, ["day", "field"], "value", low, high).drop("diverging"), ["day", "field"])


def report(parts: DataFrame, rms: float, dx: float, dt: float) -> DataFrame:
    """One row a day and field, from all partials of the days."""
    merged = parts.groupBy("day", "field").agg(F.sum("n").alias("n"), F.sum("valued").alias("valued"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.bool_or("has_nan").alias("has_nan"), F.bool_or("has_inf").alias("has_inf"), F.bool_and("in_bounds").alias("in_bounds"))
    valued = F.nullif("valued", F.lit(0))
    rows = merged.select("*", (F.col("total") / valued).alias("mean"), F.sqrt(F.col("squares") / valued).alias("rms"))
    speed = F.greatest(F.abs("least"), F.abs("greatest"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = norms.status(no("has_nan"), no("has_inf"), ~F.coalesce("in_bounds", F.lit(True)), F.coalesce(speed * dt / dx, F.lit(0.0)), F.coalesce(F.col("rms") / rms, F.lit(0.0)), F.lit(0.0))
    return rows.select("field", "n", F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"), "least", "greatest", status.alias("status"), "day")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: str | None = None, **given: object) -> DataFrame:
    """Take the readings that are new in ``source``, renew the days they touch, and return the
    whole report."""
    s = settings(spark, SCHEMA, config, **given)
    at, taken = f"{output}/partials", []

    def renew(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new, read = counted(batch, f"read-{number}")
        parts = partials(new, s["limits.low"], s["limits.high"]).withColumn("batch", F.lit(number).cast("long"))
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(at)
        every = session.read.schema(PARTIAL).parquet(at)
        days = every.where(F.col("batch") == number).select("day").distinct()
        touched, wrote = counted(report(every.join(days, "day", "left_semi"), s["limits.rms"], s["grid.dx"], s["time.dt"]), f"wrote-{number}")
        touched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/report")
        taken.append((read.get["rows"], wrote.get["rows"]))
        LOG.info("batch %d: read %d readings from %s, renewed %d rows of %s/report", number, *taken[-1][:1], source, taken[-1][1], output)

    stream = history.read_parquet(spark, source, READINGS, s["stream.files"])
    stream.writeStream.foreachBatch(renew).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    LOG.info("%d batches, %d new readings", len(taken), sum(n for n, _ in taken))
    spark.createDataFrame([], REPORT).write.mode("append").partitionBy("day").parquet(f"{output}/report")
    return spark.read.schema(REPORT).parquet(f"{output}/report")


if __name__ == "__main__":
    command(__doc__.splitlines()[0], lambda spark, a: run(spark, a.input, a.output, a.checkpoint, a.config), input="the readings", output="folder of partials and report", checkpoint="folder of the stream's mark")
