"""Finite-difference stencils as ``lag``/``lead`` windows.

A field has (run, i, v), (run, i, j, v) or (run, i, j, k, v) rows.  Windows are partitioned
by every index but the one they run along, so a grid is spread over its rows and never
collapses to one task.  Within a window, where a position has no neighbour the boundary rule
supplies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("i", "j", "k")


def _window(keys: list[str], axis: str) -> Window:
    return Window.partitionBy(*keys).orderBy(axis)


def neighbours(keys: list[str], axis: str, value: str = "v", bc: str = "none", left: float = 0.0, right: float = 0.0, dx: float = 1.0) -> tuple[Column, Column]:
    """The values before and after a position along an axis.

    ``none``: null beyond the ends; ``dirichlet``: the given values; ``neumann``: the own
    value less or plus gradient * dx; ``periodic``: from the other end.
    """
    w = _window(keys, axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    if bc == "none":
        return before, after
    if bc == "dirichlet":
        return F.coalesce(before, F.lit(left)), F.coalesce(after, F.lit(right))
    if bc == "neumann":
        return F.coalesce(before, F.col(value) - left * dx), F.coalesce(after, F.col(value) + right * dx)
    if bc == "periodic":
        return F.coalesce(before, F.last(value).over(whole)), F.coalesce(after, F.first(value).over(whole))
    raise ValueError(f"unknown boundary condition {bc}")


def laplacian(field: DataFrame, axes: int = 1, spacing: tuple[float, ...] | float = 1.0, bc: str = "none", left: float = 0.0, right: float = 0.0, run: str = "run", value: str = "v") -> DataFrame:
    """field with ``lap``: the (2 * axes + 1)-point Laplacian; with ``none`` boundaries it is
    null where any neighbour is missing."""
    names = AXES[:axes]
    h = spacing if isinstance(spacing, tuple) else (spacing,) * axes
    out = field
    for a, d in zip(names, h, strict=True):
        before, after = neighbours([run, *(n for n in names if n != a)], a, value, bc, left, right, d)
        out = out.withColumn(f"_{a}", (after - 2.0 * F.col(value) + before) / (d * d))
    return out.withColumn("lap", sum((F.col(f"_{a}") for a in names[1:]), start=F.col(f"_{names[0]}"))).drop(*(f"_{a}" for a in names))


def diffusion_step(field: DataFrame, D: float, dt: float, axes: int = 1, spacing: tuple[float, ...] | float = 1.0, bc: str = "none", left: float = 0.0, right: float = 0.0, run: str = "run") -> DataFrame:
    """One explicit Euler step; with ``none`` boundaries the edge keeps its values."""
    rows = laplacian(field, axes, spacing, bc, left, right, run)
    return rows.withColumn("v", F.col("v") + D * dt * F.coalesce("lap", F.lit(0.0))).drop("lap")


def apply_boundary(field: DataFrame, kind: str, left: float = 0.0, right: float = 0.0, run: str = "run") -> DataFrame:
    """Overwrite the end rows: ``dirichlet`` values, ``neumann`` copies of the inner
    neighbours, ``periodic`` copies of the opposite inner neighbours."""
    w = _window([run], "i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.lag("v").over(w).isNull(), F.lead("v").over(w).isNull()
    if kind == "dirichlet":
        ends = F.lit(left), F.lit(right)
    elif kind == "neumann":
        ends = F.coalesce(F.lead("v").over(w), F.col("v")), F.coalesce(F.lag("v").over(w), F.col("v"))
    elif kind == "periodic":
        n = F.count("v").over(Window.partitionBy(run))
        ends = F.coalesce(F.max(F.when(F.col("i") == F.col("_n") - 2, F.col("v"))).over(whole), F.col("v")), F.coalesce(F.max(F.when(F.col("i") == 1, F.col("v"))).over(whole), F.col("v"))
        field = field.withColumn("_n", n)
    else:
        raise ValueError(f"unknown boundary condition {kind}")
    return field.withColumn("v", F.when(first, ends[0]).when(last, ends[1]).otherwise(F.col("v"))).drop("_n")


def convective_term(field: DataFrame, dx: float, scheme: str = "upwind", run: str = "run") -> DataFrame:
    """field (run, i, v, u) with ``conv``: minus the difference of face fluxes over dx, the
    face velocities being means; 0 at the ends."""
    from ..functions.transport import face_flux

    w = _window([run], "i")
    at = lambda name, k: (F.lag(name) if k < 0 else F.lead(name)).over(w)
    rows = field.select("*", at("v", -1).alias("_vl"), at("v", 1).alias("_vr"), at("u", -1).alias("_ul"), at("u", 1).alias("_ur"))
    left = face_flux(scheme, "_vl", "v", (F.col("_ul") + F.col("u")) / 2.0)
    right = face_flux(scheme, "v", "_vr", (F.col("u") + F.col("_ur")) / 2.0)
    return rows.withColumn("conv", F.coalesce(-(right - left) / dx, F.lit(0.0))).drop("_vl", "_vr", "_ul", "_ur")


def adr_term(field: DataFrame, D: float, reaction: Column | float, dx: float, scheme: str = "upwind", run: str = "run") -> DataFrame:
    """field with ``adr``: convection plus diffusion (0 at the ends) plus reaction."""
    rows = laplacian(convective_term(field, dx, scheme, run), 1, dx, run=run)
    return rows.withColumn("adr", F.col("conv") + D * F.coalesce("lap", F.lit(0.0)) + reaction)


def advect_2d(field: DataFrame, dt: float, dx: float, dy: float, run: str = "run") -> DataFrame:
    """One upwind step of v along velocities (ux, uy); the edge keeps its values."""
    wx, wy = _window([run, "j"], "i"), _window([run, "i"], "j")
    rows = field.select("*", F.lag("v").over(wx).alias("_l"), F.lead("v").over(wx).alias("_r"), F.lag("v").over(wy).alias("_d"), F.lead("v").over(wy).alias("_u"))
    gx = F.when(F.col("ux") > 0, F.col("v") - F.col("_l")).otherwise(F.col("_r") - F.col("v")) / dx
    gy = F.when(F.col("uy") > 0, F.col("v") - F.col("_d")).otherwise(F.col("_u") - F.col("v")) / dy
    inner = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_d").isNotNull() & F.col("_u").isNotNull()
    return rows.withColumn("v", F.when(inner, F.col("v") - dt * (F.col("ux") * gx + F.col("uy") * gy)).otherwise(F.col("v"))).drop("_l", "_r", "_d", "_u")


def oscillation_index(history: DataFrame, key: str, time: str, value: str, order: str | None = None, last: int | None = None) -> DataFrame:
    """(key, oscillation): the share of inner instants at which successive differences change
    sign, over the last ``last`` instants of each key if given."""
    sort = [time, order] if order else [time]
    w = Window.partitionBy(key).orderBy(*sort)
    rows = history
    if last is not None:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in sort)))).where(F.col("_r") <= last).drop("_r")
    rows = rows.select(key, (F.col(value) - F.lag(value).over(w)).alias("a"), (F.lead(value).over(w) - F.col(value)).alias("b"))
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("a") * F.col("b") < 0).alias("turns"))
    return out.select(key, F.when(F.col("n") >= 3, F.col("turns") / F.when(F.col("n") >= 3, F.col("n") - 2)).otherwise(F.lit(0.0)).alias("oscillation"))


def decimate(rows: DataFrame, key: str, order: list[str], step: int = 2) -> DataFrame:
    """Every ``step``-th row of each key, from its first."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where((F.col("_r") - 1) % step == 0).drop("_r")


def every(rows: DataFrame, step_column: str, k: int) -> DataFrame:
    """The rows of every k-th step."""
    return rows.where(F.col(step_column) % k == 0)
