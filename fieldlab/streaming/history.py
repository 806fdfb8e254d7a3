"""Streams of (key, t, value): bounded histories, step control and windowed aggregates.

Keyed state is one bounded list or a few numbers a key, held in the RocksDB state store, so it
grows with the number of keys only and need not fit in memory; ``idle`` (an event-time column
with a watermark, milliseconds) lets go of a key by a timer once the watermark has passed its
last row by so much (rows behind the watermark are then dropped), and watermarks close windows.
Start such streams within ``state_store``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def read_parquet(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def turns(values: list[float]) -> float:
    """The share of inner instants at which successive differences change sign."""
    if len(values) < 3:
        return 0.0
    d = [b - a for a, b in zip(values, values[1:], strict=False)]
    return sum(x * y < 0 for x, y in zip(d, d[1:], strict=False)) / (len(values) - 2)


class Keyed(StatefulProcessor):
    """State of a key that a timer clears once the key has been idle."""

    idle: tuple[str, int] | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def seen(self, rows: pd.DataFrame) -> None:
        if self.idle is not None:
            time, ms = self.idle
            due = int(rows[time].max().timestamp() * 1000) + ms
            for other in list(self.handle.listTimers()):
                due = max(due, other)
                self.handle.deleteTimer(other)
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class Oscillation(Keyed):
    def __init__(self, key: str, order: list[str], value: str, last: int, idle: tuple[str, int] | None):
        self.key, self.order, self.value, self.last, self.idle = key, order, value, last, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(self.order)
        new = part[self.value].astype(float).tolist()
        held = [*(v for (v,) in self.held.get()), *new][-self.last :] if self.held.exists() else new[-self.last :]
        self.held.put([(v,) for v in held])
        self.seen(part)
        yield pd.DataFrame({self.key: [key[0]], "n": [len(held)], "oscillation": [turns(held)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({self.key: [key[0]], "n": [0], "oscillation": [0.0]})


def oscillation(stream: DataFrame, key: str, order: list[str], value: str, last: int = 10, idle: tuple[str, int] | None = None) -> DataFrame:
    """(key, n, oscillation) of the newest ``last`` values of each key after every batch; a key
    let go says n = 0 once."""
    kind = dict(stream.dtypes)[key]
    processor = Oscillation(key, order, value, last, idle)
    return stream.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, n int, oscillation double", "Update", "None" if idle is None else "EventTime")


def tumbling(stream: DataFrame, time: str, key: str, value: str, width: str, delay: str) -> DataFrame:
    """(window, key, n, mean): event-time windows closed by a watermark."""
    return sliding(stream, time, key, value, width, width, delay)


def sliding(stream: DataFrame, time: str, key: str, value: str, width: str, slide: str, delay: str) -> DataFrame:
    """(window, key, n, mean): windows of ``width`` that begin every ``slide``; rows later than
    ``delay`` behind the newest are dropped, earlier ones still count."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width, slide).alias("window"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sessions(stream: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """(window, key, n): sessions of a key parted by a gap."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("window"), key).agg(F.count("*").alias("n"))


class Control(Keyed):
    def __init__(self, key: str, order: str, error: str, dt: float, kind: str, method_order: int, idle: tuple[str, int] | None):
        self.key, self.order, self.error, self.start, self.idle = key, order, error, (dt, kind, method_order), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "dt double, before double, before2 double, streak int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from ..operators.iterate import StepController

        c, out = StepController(*self.start), []
        if self.state.exists():
            c.dt, c.before, c.before2, c.streak = self.state.get()
        part = pd.concat(list(rows)).sort_values(self.order)
        for row in part.itertuples():
            good = c.step(float(getattr(row, self.error)))
            out.append((key[0], getattr(row, self.order), good, c.dt))
        self.state.update((c.dt, c.before, c.before2, c.streak))
        self.seen(part)
        yield pd.DataFrame(out, columns=[self.key, self.order, "accepted", "dt"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({self.key: [], self.order: [], "accepted": [], "dt": []})


def controller(stream: DataFrame, key: str, order: str, error: str, dt: float, kind: str = "pi", method_order: int = 2, idle: tuple[str, int] | None = None) -> DataFrame:
    """(key, order, accepted, dt): the adaptive step controller fed by a stream of errors."""
    types = dict(stream.dtypes)
    processor = Control(key, order, error, dt, kind, method_order, idle)
    return stream.groupBy(key).transformWithStateInPandas(processor, f"{key} {types[key]}, {order} {types[order]}, accepted boolean, dt double", "Update", "None" if idle is None else "EventTime")


def collected(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Run a stream over all there is and write each batch as ``batch=N`` below path, so that a
    batch that is run again replaces itself."""
    with state_store(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
