"""Partition and load formulas of distributed grids, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import col


def block_bounds(n, parts, rank) -> tuple[Column, Column]:
    """(start, size) of a rank's block, the remainder going to the low ranks."""
    n, parts, rank = col(n), col(parts), col(rank)
    base, extra = F.floor(n / parts), n % parts
    return (rank * base + F.least(rank, extra)).cast("long"), (base + F.when(rank < extra, 1).otherwise(0)).cast("long")


def owner(index, n, parts) -> Column:
    """The rank whose block holds an index."""
    index, n, parts = col(index), col(n), col(parts)
    base, extra = F.floor(n / parts), n % parts
    edge = extra * (base + 1)
    return F.when(index < edge, F.floor(index / (base + 1))).otherwise(extra + F.floor((index - edge) / F.greatest(base, F.lit(1)))).cast("int")


def process_grid(n: int) -> tuple[int, int, int]:
    """Three factors of n: the smallest factor of {2, 3, 5, 7} goes to the smallest side, and a
    remainder without such factors to it as well."""
    dims = [1, 1, 1]
    while n > 1:
        k = dims.index(min(dims))
        factor = next((f for f in (2, 3, 5, 7) if n % f == 0), n)
        dims[k] *= factor
        n //= factor
    return dims[0], dims[1], dims[2]


def cube_root_grid(n: int) -> tuple[int, int, int]:
    """The older factorization from the cube root and the square root of what is left."""
    if n < 4:
        return n, 1, 1
    z = round(n ** (1 / 3)) if round(n ** (1 / 3)) ** 3 == n else int(n ** (1 / 3))
    y = int((n // z) ** 0.5)
    return n // (y * z), y, z


def surface_ratio(x, y, z) -> Column:
    """1000 * surface / volume of a process grid, whole numbers."""
    x, y, z = col(x), col(y), col(z)
    return F.floor(2 * (x * y + y * z + z * x) * 1000 / (x * y * z)).cast("int")


def load_stats(metrics: DataFrame, keys: list[str], load: str) -> DataFrame:
    """least, greatest and mean load, and imbalance = greatest / mean (1 for a mean of 0)."""
    out = metrics.groupBy(*keys).agg(F.min(load).alias("least"), F.max(load).alias("greatest"), F.avg(load).alias("mean"))
    return out.withColumn("imbalance", F.when(F.col("mean") > 0, F.col("greatest") / F.when(F.col("mean") > 0, F.col("mean"))).otherwise(F.lit(1.0)))


def rebalance(metrics: DataFrame, key: str, rank: str, work: str, time: str) -> DataFrame:
    """metrics with ``target``: all work shared by inverse time per unit, whole numbers, the
    last rank taking the rest."""
    every = Window.partitionBy(key)
    speed = F.when(F.col(time) > 0, F.col(work) / F.when(F.col(time) > 0, F.col(time))).otherwise(F.lit(1.0))
    rows = metrics.withColumn("_w", speed).withColumn("_t", F.floor(F.sum(work).over(every) * F.col("_w") / F.sum("_w").over(every)))
    last = F.col(rank) == F.max(rank).over(every)
    rest = F.sum(work).over(every) - F.sum(F.when(~last, F.col("_t")).otherwise(0)).over(every)
    return rows.withColumn("_l", last).withColumn("target", F.when(last, rest).otherwise(F.col("_t")).cast("long")).drop("_w", "_t", "_l")


def weighted_split(parts: DataFrame, key: str, rank: str, capacity: str, total: int, halo: int = 0) -> DataFrame:
    """parts with start, stop and halos: positions shared by capacity, the last taking the rest."""
    every, along = Window.partitionBy(key), Window.partitionBy(key).orderBy(rank)
    size = F.floor(total * F.col(capacity) / F.sum(capacity).over(every))
    rows = parts.withColumn("_s", size)
    first, last = F.col(rank) == F.min(rank).over(every), F.col(rank) == F.max(rank).over(every)
    start = F.coalesce(F.sum("_s").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"start": start.cast("long"), "stop": F.when(last, F.lit(total)).otherwise(start + F.col("_s")).cast("long"), "halo_left": F.when(first, 0).otherwise(halo), "halo_right": F.when(last, 0).otherwise(halo)}).drop("_s")


def halo_rows(field: DataFrame, slab: str, index: str, size: int, width: int = 1) -> DataFrame:
    """field with ``slab`` of ``size`` positions and copies of the rows within ``width`` of a
    slab's edge for its neighbour (``ghost`` true), so that slabs step on their own."""
    home = F.floor(F.col(index) / size)
    places = F.array(F.struct(home.alias("s"), F.lit(False).alias("g")), F.struct(F.floor((F.col(index) - width) / size).alias("s"), F.lit(True).alias("g")), F.struct(F.floor((F.col(index) + width) / size).alias("s"), F.lit(True).alias("g")))
    rows = field.withColumn("_p", F.explode(places)).withColumns({slab: F.col("_p.s").cast("int"), "ghost": F.col("_p.g")}).drop("_p")
    return rows.where(~F.col("ghost") | ((F.col(slab) != home) & (F.col(slab) >= 0))).dropDuplicates([c for c in (*field.columns, slab, "ghost")])


def least_loaded(workers: DataFrame, key: str, worker: str, load: str) -> DataFrame:
    return workers.groupBy(key).agg(F.min(F.struct(F.col(load).alias("l"), F.col(worker).alias("w"))).alias("m")).select(key, F.col("m.w").alias(worker), F.col("m.l").alias(load))


def grid_search(points: DataFrame, objective: Column, names: list[str], key: str | None = None) -> DataFrame:
    """The parameters of the least objective (ties by parameters), per key if given."""
    best = F.min(F.struct(objective.alias("o"), *names)).alias("b")
    out = points.groupBy(key).agg(best) if key else points.agg(best)
    return out.select(*([key] if key else []), *(F.col(f"b.{n}").alias(n) for n in names), F.col("b.o").alias("objective"))
