"""Many explicit steps on one large plane, a few of them for each shuffle.

A plane has (run, i, j, values...) rows.  It is cut into square *tiles* of ``tile`` cells a side,
and a tile is stepped as numpy arrays together with a rim of ``halo`` cells of its neighbours:
a step spoils one more cell of the rim, so ``halo`` steps leave the tile itself right.  Then
tiles send each other themselves and their borders as packed patches, and the next ``halo``
steps follow.  ``steps`` steps therefore shuffle the plane ceil(steps / halo) times, whatever
its size, and a tile's arrays are all that a task holds.

Cells may be missing anywhere (ragged edges, holes): a missing neighbour is the boundary, by
``dirichlet`` of a value or by ``neumann`` (no gradient).  ``periodic`` planes need their shape.
A cell with a null or NaN value counts as missing; a value that stops being finite is an error.
No cells give no rows; several rows of one cell are an error of the caller (any one is taken).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import REACTIONS, check_cfl, keep

Arrays = dict[str, np.ndarray]
Step = Callable[[Arrays], Arrays]

TILE, HALO = 256, 8


def _targets(i: Column, tile: int, halo: int) -> Column:
    """The tiles along one axis that a cell belongs to or borders on."""
    return F.sequence(F.floor((i - halo) / tile), F.floor((i + halo) / tile))


def _images(i: Column, n: int | None, halo: int) -> Column:
    """A cell's index, and on a periodic axis of n cells those of its copies beyond the ends."""
    if n is None:
        return F.array(i)
    if n < halo:
        raise ValueError(f"a periodic axis of {n} cells is shorter than the halo of {halo}")
    return F.filter(F.array(i, i - n, i + n), lambda x: (x >= -halo) & (x < n + halo))


class _Layout:
    """Where tiles are and what they send."""

    def __init__(self, names: list[str], tile: int, halo: int, shape: tuple[int, int] | None):
        self.names, self.tile, self.halo, self.shape = names, tile, halo, shape
        self.side = tile + 2 * halo

    def blank(self) -> Arrays:
        return {c: np.full((self.side, self.side), np.nan) for c in self.names}

    def from_cells(self, table: pa.Table, ti: int, tj: int) -> Arrays:
        out = self.blank()
        i, j = (table.column(c).to_numpy() - t * self.tile + self.halo for c, t in (("i", ti), ("j", tj)))
        for c in self.names:
            out[c][i, j] = table.column(c).to_numpy().astype(float)
        gone = np.isnan(sum(out.values()))
        for a in out.values():
            a[gone] = np.nan
        return out

    def from_patches(self, table: pa.Table, ti: int, tj: int) -> Arrays:
        out = self.blank()
        for row in table.select(["pi", "pj", "h", "w", *self.names]).to_pylist():
            i, j = row["pi"] - ti * self.tile + self.halo, row["pj"] - tj * self.tile + self.halo
            for c in self.names:
                out[c][i : i + row["h"], j : j + row["w"]] = np.frombuffer(row[c]).reshape(row["h"], row["w"])
        return out

    def own(self, arrays: Arrays, ti: int, tj: int) -> Arrays:
        """The tile without its rim, and without what lies beyond a periodic plane's ends."""
        h, t = self.halo, self.tile
        rows, columns = (t, t) if self.shape is None else (self.shape[0] - ti * t, self.shape[1] - tj * t)
        return {c: a[h : h + min(t, rows), h : h + min(t, columns)] for c, a in arrays.items()}

    def cells(self, own: Arrays, ti: int, tj: int) -> dict[str, np.ndarray]:
        i, j = np.nonzero(~np.isnan(own[self.names[0]]))
        return {"i": i + ti * self.tile, "j": j + tj * self.tile} | {c: own[c][i, j] for c in self.names}

    def patches(self, own: Arrays, ti: int, tj: int) -> list[dict]:
        """What each tile around needs of this one, itself included."""
        t, h, out = self.tile, self.halo, []
        i0, j0 = ti * t, tj * t
        rows, columns = own[self.names[0]].shape
        shifts = [(a, b) for a in (0, -1, 1) for b in (0, -1, 1)] if self.shape else [(0, 0)]
        for a, b in shifts:
            si, sj = (i0 + a * self.shape[0], j0 + b * self.shape[1]) if self.shape else (i0, j0)
            last = (None, None) if self.shape is None else tuple((n - 1) // t for n in self.shape)
            for ui in range((si - h) // t, (si + rows - 1 + h) // t + 1):
                for uj in range((sj - h) // t, (sj + columns - 1 + h) // t + 1):
                    if self.shape and not (0 <= ui <= last[0] and 0 <= uj <= last[1]):
                        continue
                    lo_i, hi_i = max(si, ui * t - h), min(si + rows, (ui + 1) * t + h)
                    lo_j, hi_j = max(sj, uj * t - h), min(sj + columns, (uj + 1) * t + h)
                    if lo_i < hi_i and lo_j < hi_j:
                        part = {c: own[c][lo_i - si : hi_i - si, lo_j - sj : hi_j - sj] for c in self.names}
                        if not np.isnan(part[self.names[0]]).all():
                            out.append({"ti": ui, "tj": uj, "pi": lo_i, "pj": lo_j, "h": hi_i - lo_i, "w": hi_j - lo_j} | {c: np.ascontiguousarray(v).tobytes() for c, v in part.items()})
        return out


def advance(plane: DataFrame, values: list[str], steps: int, step: Step, tile: int = TILE, halo: int = HALO, shape: tuple[int, int] | None = None, reach: int = 1, run: str = "run", keep_every: int = 8) -> DataFrame:
    """(run, i, j, values) after ``steps`` calls of ``step`` on arrays with a rim.

    ``step`` takes and returns one array a value, in which NaN marks cells that don't exist; it
    may use what is at most ``reach`` cells away.  ``shape`` is given for periodic planes.  Every
    ``keep_every`` exchanges the state is written to the shared folder, which cuts the lineage.
    """
    if not reach <= halo <= tile:
        raise ValueError("the halo must be from a step's reach to the tile's side")
    if steps <= 0:
        return plane.select(run, "i", "j", *(F.col(c).cast("double").alias(c) for c in values))
    at, kind = _Layout(values, tile, halo, shape), dict(plane.dtypes)[run]
    cells_type = f"{run} {kind}, i long, j long, " + ", ".join(f"{c} double" for c in values)
    patch_type = f"{run} {kind}, ti long, tj long, pi long, pj long, h int, w int, " + ", ".join(f"{c} binary" for c in values)

    def work(load: Callable[[pa.Table, int, int], Arrays], count: int, last: bool):
        def apply(key: tuple, table: pa.Table) -> pa.Table:
            ti, tj = key[1].as_py(), key[2].as_py()
            arrays = load(table, ti, tj)
            there = ~np.isnan(at.own(arrays, ti, tj)[values[0]])
            if there.any():  # else neighbours' borders only
                for _ in range(count):
                    arrays = step(arrays)
            own = at.own(arrays, ti, tj)
            if not all(np.isfinite(a[there]).all() for a in own.values()):
                raise ValueError("the solution diverged: a value is no longer finite")
            rows = at.cells(own, ti, tj) if last else at.patches(own, ti, tj)
            if last:
                n = len(rows["i"])
                return pa.table({run: pa.array([key[0].as_py()] * n, table.schema.field(run).type)} | {c: pa.array(v) for c, v in rows.items()})
            fields = [("ti", pa.int64()), ("tj", pa.int64()), ("pi", pa.int64()), ("pj", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), *((c, pa.binary()) for c in values)]
            return pa.table({run: pa.array([key[0].as_py()] * len(rows), table.schema.field(run).type)} | {c: pa.array([r[c] for r in rows], t) for c, t in fields})

        return apply

    n_i, n_j = shape or (None, None)
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    seeds = plane.select(run, i.alias("i"), j.alias("j"), *(F.col(c).cast("double").alias(c) for c in values))
    seeds = seeds.withColumn("i", F.explode(_images(F.col("i"), n_i, halo))).withColumn("j", F.explode(_images(F.col("j"), n_j, halo)))
    state = seeds.withColumn("ti", F.explode(_targets(F.col("i"), tile, halo))).withColumn("tj", F.explode(_targets(F.col("j"), tile, halo)))
    if shape:
        state = state.where(F.col("ti").between(0, (n_i - 1) // tile) & F.col("tj").between(0, (n_j - 1) // tile))
    load, left, rounds, few = at.from_cells, steps, 0, halo // reach
    while left > few:
        state = state.groupBy(run, "ti", "tj").applyInArrow(work(load, few, False), patch_type)
        load, left, rounds = at.from_patches, left - few, rounds + 1
        if rounds % keep_every == 0:
            state = keep(state)
    return state.groupBy(run, "ti", "tj").applyInArrow(work(load, left, True), cells_type)


def neighbours(a: np.ndarray, bc: str, value: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The four neighbours of every cell (i - 1, i + 1, j - 1, j + 1), the boundary where one is
    missing; on periodic planes only what lies beyond the rim is missing."""
    full = np.pad(a, 1, constant_values=np.nan)
    edge = np.broadcast_to(value, a.shape) if bc == "dirichlet" else a
    return tuple(np.where(np.isnan(x), edge, x) for x in (full[:-2, 1:-1], full[2:, 1:-1], full[1:-1, :-2], full[1:-1, 2:]))


def laplacian(a: np.ndarray, spacing: tuple[float, float], bc: str, value: float = 0.0) -> np.ndarray:
    west, east, south, north = neighbours(a, bc, value)
    dx, dy = spacing
    return (east - 2.0 * a + west) / (dx * dx) + (north - 2.0 * a + south) / (dy * dy)


BOUNDARIES = ("dirichlet", "neumann", "periodic")


def _checked(bc: str, shape: tuple[int, int] | None) -> None:
    if bc not in BOUNDARIES:
        raise ValueError(f"unknown boundary condition {bc}")
    if (bc == "periodic") != (shape is not None):
        raise ValueError("periodic planes, and only they, need a shape")


def diffuse(plane: DataFrame, D: float, dt: float, steps: int, spacing: tuple[float, float] = (1.0, 1.0), bc: str = "dirichlet", value: float = 0.0, source: float = 0.0, **layout) -> DataFrame:
    """(run, i, j, v) after explicit five-point diffusion steps, with a constant source."""
    _checked(bc, layout.get("shape"))
    check_cfl(D, dt, *spacing)

    def step(a: Arrays) -> Arrays:
        return {"v": a["v"] + dt * (D * laplacian(a["v"], spacing, bc, value) + source)}

    return advance(plane, ["v"], steps, step, **layout)


def react_diffuse(plane: DataFrame, model: str | Callable[..., tuple[np.ndarray, np.ndarray]], diffusivities: tuple[float, float], parameters: tuple[float, ...], dt: float, steps: int, spacing: tuple[float, float] = (1.0, 1.0), bc: str = "periodic", values: tuple[float, float] = (0.0, 0.0), splitting: str = "none", **layout) -> DataFrame:
    """(run, i, j, u, v) after explicit steps of two reacting and diffusing species.

    ``model`` is a name of ``iterate.REACTIONS`` or a function of (u, v, *parameters) that gives
    both rates.  ``none`` adds both terms in one step, ``godunov`` takes them in turn, ``strang``
    halves diffusion around the reaction.
    """
    _checked(bc, layout.get("shape"))
    check_cfl(max(diffusivities), dt, *spacing)
    rates = REACTIONS[model] if isinstance(model, str) else model
    if splitting not in ("none", "godunov", "strang"):
        raise ValueError(f"unknown splitting {splitting}")

    def react(a: Arrays, h: float) -> Arrays:
        ru, rv = rates(a["u"], a["v"], *parameters)
        return {"u": a["u"] + h * ru, "v": a["v"] + h * rv}

    def spread(a: Arrays, h: float) -> Arrays:
        return {c: a[c] + h * k * laplacian(a[c], spacing, bc, b) for c, k, b in zip("uv", diffusivities, values, strict=True)}

    def step(a: Arrays) -> Arrays:
        if splitting == "godunov":
            return react(spread(a, dt), dt)
        if splitting == "strang":
            return spread(react(spread(a, dt / 2), dt), dt / 2)
        ru, rv = rates(a["u"], a["v"], *parameters)
        lap = {c: laplacian(a[c], spacing, bc, b) for c, b in zip("uv", values, strict=True)}
        return {"u": a["u"] + dt * (diffusivities[0] * lap["u"] + ru), "v": a["v"] + dt * (diffusivities[1] * lap["v"] + rv)}

    return advance(plane, ["u", "v"], steps, step, reach=2 if splitting == "strang" else 1, **layout)
