"""Coupled runs: reacting cells with temperature, and multi-physics steps on a plane.

Cells of a reactor are independent, so each batch of cells advances in numpy; plane steps
are DataFrame stencils in the order chemistry, heat, diffusion, advection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import R
from .stencils import advect_2d, diffusion_step


def reactor(cells: DataFrame, key: str, c: str, T: str, A: float, Ea: float, enthalpy: float, heat_capacity: float, dt: float, steps: int, splitting: str = "sequential") -> DataFrame:
    """(key, c, T) after steps of A -> B with heat: dc/dt = -k(T) c, dT/dt = -H k(T) c / cp.

    ``strang`` takes chemistry in two half steps around the temperature's.
    """
    kind = dict(cells.dtypes)[key]

    def chemistry(x: np.ndarray, t: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
        rate = A * np.exp(-Ea / (R * t)) * x
        new = np.maximum(x - h * rate, 0.0)
        return new, x - new

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, t = part[c].to_numpy(float), part[T].to_numpy(float)
            for _ in range(steps):
                if splitting == "strang":
                    x, used = chemistry(x, t, dt / 2)
                    t = t - enthalpy * used / heat_capacity
                    x, more = chemistry(x, t, dt / 2)
                    t = t - enthalpy * more / heat_capacity
                else:
                    x, used = chemistry(x, t, dt)
                    t = t - enthalpy * used / heat_capacity
            yield pd.DataFrame({key: part[key], "c": x, "T": t})

    return cells.select(key, c, T).mapInPandas(run, f"{key} {kind}, c double, T double")


def plane_step(plane: DataFrame, dt: float, dx: float, dy: float, D: float, alpha: float, A: float, Ea: float, heat: float, run: str = "run") -> DataFrame:
    """One step of plane(run, i, j, c, T, ux, uy): reaction with heat, conduction of T,
    diffusion of c, upwind advection of c."""
    used = F.least(F.col("c"), dt * A * F.exp(-Ea / (R * F.col("T"))) * F.col("c"))
    out = plane.withColumn("_u", used).withColumns({"c": F.col("c") - F.col("_u"), "T": F.col("T") + heat * F.col("_u")}).drop("_u")
    for name, rate in (("T", alpha), ("c", D)):
        out = diffusion_step(out.withColumnRenamed(name, "v"), rate, dt, 2, (dx, dy), run=run).withColumnRenamed("v", name)
    return advect_2d(out.withColumnRenamed("c", "v"), dt, dx, dy, run).withColumnRenamed("v", "c")


def plane_stats(plane: DataFrame, dx: float, dy: float, run: str = "run") -> DataFrame:
    return plane.groupBy(run).agg(F.min("T").alias("t_min"), F.avg("T").alias("t_mean"), F.max("T").alias("t_max"), (F.sum("c") * dx * dy).alias("total"))


def interpolate(points: DataFrame, grid: DataFrame, radius: float, power: float = 2.0, key: str | None = None) -> DataFrame:
    """grid(x, y) with ``v``: inverse-distance means of the points(x, y, v) within a radius, the
    point's own value where one lies on the place, null where none is near.  Points meet
    places by squares of the radius."""
    keys = [key] if key else []
    box = lambda a, k=0: (F.floor(F.col(a) / radius) + k)
    near = F.explode(F.array(*(F.struct(box("x", i).alias("bx"), box("y", j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asked = grid.select(*keys, "x", "y", near.alias("b")).select(*keys, "x", "y", "b.*")
    given = points.select(*keys, F.col("x").alias("px"), F.col("y").alias("py"), F.col("v").alias("pv"), box("x").alias("bx"), box("y").alias("by"))
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    rows = asked.join(given, [*keys, "bx", "by"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    weight = 1.0 / F.pow(F.when(F.col("d2") > 1e-24, F.col("d2")), F.lit(power / 2))
    out = rows.groupBy(*keys, "x", "y").agg(F.max(F.when(F.col("d2") <= 1e-24, F.col("pv"))).alias("hit"), (F.sum(weight * F.col("pv")) / F.sum(weight)).alias("mean"))
    return grid.join(out, [*keys, "x", "y"], "left").withColumn("v", F.coalesce("hit", "mean")).drop("hit", "mean")
