"""Mixing sources to target weights.

Every document gets a hash-random key (md5 of its id), is ordered by it within its source,
and is taken while the running total of sizes is below the source's budget; budgets beyond
one epoch repeat the order.  The running totals are two-level prefix sums: the key's first
hex digits cut each source into ``4096`` even ranges, range totals are summed per source,
and only within one range are documents ordered.  A source with a third of all rows is
thus spread like any other, and no task holds a source.

Cases: a null text has size 0; null sources form one source, last in order; null ids share
one key and are then ordered by size; an empty table gives an empty result; sources whose
size is 0 get target 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import free_name, materialize


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, offs in tk.chunks(batch, "text"):
            counts[lo:hi] = np.diff(tk.words(data, offs)[2])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("row"), pa.array(counts)], ["doc_id", "source", "row", "size"])


def row_hash() -> Column:
    """Tells rows apart by id, source and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.coalesce("source", F.lit("")), "text")


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, size): words of each whole text."""
    return docs.select("doc_id", "source", "text", row_hash().alias("row")).mapInArrow(_sizes, "doc_id long, source string, row long, size long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """(source, source_size, target) with one row a source.

    A source's target is its weight times one level, at most ``epochs`` times its size; the
    level shares out ``share`` of all sizes, and what capped sources can't take goes to the
    others by weight.  Sources are capped in the order of size over weight, so the level
    follows from running sums over sources, of which the table holds few.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (rank % len(weights) + 1).cast("int")))
    ratio = F.col("source_size").cast("double") / F.col("w")
    upto = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(epochs * F.col("source_size")).over(upto), F.lit(0))) / F.sum("w").over(rest)
    per = per.withColumn("level", level).withColumn("open", F.col("w") * F.col("level") <= epochs * F.col("source_size"))
    least = F.min(F.when(F.col("open"), F.struct(ratio.alias("r"), F.col("source").isNull().alias("n"), F.col("source"), F.col("level")))).over(every)
    line = least.getField("level")
    return per.select("source", "source_size", F.when(line.isNull() | (F.col("w") * line > epochs * F.col("source_size")), (epochs * F.col("source_size")).cast("double")).otherwise(F.col("w") * line).alias("target"))


def taken_rows(docs: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """(doc_id, row, size, source_size, target, taken) for every row of docs."""
    sizes = materialize(word_sizes(docs).withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    goal = targets(sizes, weights, share, epochs).withColumn("tag", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    rows = sizes.withColumn("tag", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).withColumn("range", F.substring("key", 1, 3))
    ranges = rows.groupBy("tag", "range").agg(F.sum("size").alias("in_range"))
    ahead = Window.partitionBy("tag").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("tag", "range", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("range_at"))
    ranges = ranges.join(goal.select("tag", "source_size", "target"), "tag")
    inside = Window.partitionBy("tag", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(ranges, ["tag", "range"])
    budget = F.floor(F.col("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    left = budget - whole * F.col("source_size") - F.col("range_at") - F.col("at")
    return rows.select("doc_id", "row", "size", "source_size", "target", (whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs(doc_id, source, text)."""
    return taken_rows(docs, weights, share, epochs).drop("row")


def keep_taken(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The mixed rows of docs, with all their columns: a row stands once for every epoch that
    takes any of its words, whole also where the budget cuts it.  Rows without words cost
    nothing and stay once; rows alike in id, source and text are taken alike."""
    name = free_name(docs.columns, "row")
    often = free_name([*docs.columns, name], "times")
    times = taken_rows(docs, weights, share, epochs)
    times = times.groupBy("row").agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.greatest("size", F.lit(1))))).cast("int").alias("times"))
    times = times.where("times > 0").select(F.col("row").alias(name), F.col("times").alias(often))
    kept = docs.withColumn(name, row_hash()).join(times, name)
    return kept.withColumn(often, F.explode(F.array_repeat(F.lit(0), F.col(often)))).select(*docs.columns)
