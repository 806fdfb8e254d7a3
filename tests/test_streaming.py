"""Streams over growing folders against the same operators in batch."""

import pytest
from pyspark.sql import functions as F

from fieldlab.operators.iterate import StepController
from fieldlab.streaming import history


def feed(spark, rows, path):
    rows.coalesce(1).write.parquet(f"{path}/in", mode="append")


def parts(spark, n=60):
    return spark.createDataFrame([(k % 3, k, float((k * 7) % 5)) for k in range(n)], "key long, t long, value double")


def newest(spark, path):
    """The last row that the stream wrote of each key."""
    return {r.key: (r.n, r.oscillation) for r in spark.read.parquet(path).orderBy("batch").collect()}


def test_oscillation_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = parts(spark)
    for upto in (20, 45, 60):
        feed(spark, rows.where(F.col("t").between(upto - (20 if upto == 20 else 25 if upto == 45 else 15), upto - 1)), tmp_path)
        source = history.read_parquet(spark, f"{tmp_path}/in", rows.schema, 100)
        history.collected(history.oscillation(source, "key", ["t"], "value"), f"{tmp_path}/out", f"{tmp_path}/mark")
        for key, got in newest(spark, f"{tmp_path}/out").items():
            values = [r.value for r in rows.where((F.col("key") == key) & (F.col("t") < upto)).orderBy("t").collect()][-10:]
            assert got == (len(values), pytest.approx(history.turns(values)))
    assert history.PROVIDER not in spark.conf.getAll or "RocksDB" not in spark.conf.get(history.PROVIDER)


def test_controller_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = parts(spark).withColumn("error", (F.col("value") + 0.5) / 4)
    for lo, hi in ((0, 29), (30, 59)):
        feed(spark, rows.where(F.col("t").between(lo, hi)), tmp_path)
        source = history.read_parquet(spark, f"{tmp_path}/in", rows.schema, 100)
        history.collected(history.controller(source, "key", "t", "error", 0.1), f"{tmp_path}/out", f"{tmp_path}/mark")
    got = {(r.key, r.t): (r.accepted, r.dt) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    for key in range(3):
        c = StepController(0.1, "pi", 2)
        for r in rows.where(F.col("key") == key).orderBy("t").collect():
            assert got.pop((key, r.t)) == (c.step(r.error), pytest.approx(c.dt))
    assert not got


def test_idle_keys_are_let_go(spark, tmp_path):
    rows = parts(spark).withColumn("ts", F.timestamp_seconds("t"))
    for keep in ("key = 0 and t < 20", "key = 1", "key = 2"):
        feed(spark, rows.where(keep), tmp_path)
        source = history.read_parquet(spark, f"{tmp_path}/in", rows.schema, 100).withWatermark("ts", "1 second")
        history.collected(history.oscillation(source, "key", ["t"], "value", idle=("ts", 10_000)), f"{tmp_path}/out", f"{tmp_path}/mark")
    got = newest(spark, f"{tmp_path}/out")
    assert got[0] == (0, 0.0) and got[1][0] == 10
    assert got[2][0] == 1  # the others came behind the watermark


def timed(spark, seconds):
    return spark.createDataFrame([(k, float(k)) for k in seconds], "s long, value double").select(F.lit("a").alias("key"), F.timestamp_seconds("s").alias("ts"), "value")


def test_windows_with_late_rows(spark, tmp_path):
    schema = timed(spark, [0]).schema
    for seconds in ([1, 12, 26], [14, 3, 41], [90]):  # 14 is late but counts; 3 is too late
        feed(spark, timed(spark, seconds), tmp_path)
        source = history.read_parquet(spark, f"{tmp_path}/in", schema, 1)
        for name, stream in (("slide", history.sliding(source, "ts", "key", "value", "10 seconds", "5 seconds", "15 seconds")), ("tumble", history.tumbling(source, "ts", "key", "value", "10 seconds", "15 seconds")), ("session", history.sessions(source, "ts", "key", "8 seconds", "15 seconds"))):
            history.collected(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-mark", "append")
    at = lambda name: sorted((r.s, r.e, r.n) for r in spark.read.parquet(f"{tmp_path}/{name}").select(F.col("window.start").cast("long").alias("s"), F.col("window.end").cast("long").alias("e"), "n").collect())
    assert at("tumble") == [(0, 10, 1), (10, 20, 2), (20, 30, 1), (40, 50, 1)]
    assert at("slide") == [(-5, 5, 1), (0, 10, 1), (5, 15, 2), (10, 20, 2), (20, 30, 1), (25, 35, 1), (35, 45, 1), (40, 50, 1)]
    assert at("session") == [(1, 9, 1), (12, 22, 2), (26, 34, 1), (41, 49, 1)]
