"""Initial conditions as Columns of a position; any function of (x, y) will do in their place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Condition = Callable[[Column, Column], Column]


def gaussian(cx: float, cy: float, width: float, height: float = 1.0) -> Condition:
    return lambda x, y: height * F.exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * width * width))


def step(at: float, left: float, right: float) -> Condition:
    """``left`` below x = at, ``right`` from there on."""
    return lambda x, _: F.when(x < at, left).otherwise(right)


def sine(kx: float, ky: float, height: float = 1.0) -> Condition:
    return lambda x, y: height * F.sin(kx * x) * F.sin(ky * y)


def square(lo: float, hi: float, inside: float, outside: float) -> Condition:
    """``inside`` where both coordinates lie in [lo, hi)."""
    return lambda x, y: F.when((x >= lo) & (x < hi) & (y >= lo) & (y < hi), inside).otherwise(outside)


def noise(condition: Condition, amplitude: float, seed: int = 0) -> Condition:
    """A condition with noise in [-amplitude, amplitude) that depends on place and seed only."""
    unit = lambda x, y: F.pmod(F.xxhash64(x, y, F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)
    return lambda x, y: condition(x, y) + amplitude * (2 * unit(x, y) - 1)


def apply(grid: DataFrame, conditions: dict[str, Condition], spacing: tuple[float, float] = (1.0, 1.0), origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """grid (i[, j]) with a column for each condition, at x = origin + i * spacing."""
    x = origin[0] + F.col("i") * spacing[0]
    y = origin[1] + (F.col("j") if "j" in grid.columns else F.lit(0)) * spacing[1]
    return grid.withColumns({name: f(x, y).cast("double") for name, f in conditions.items()})
