"""Integrations as table functions: each input row yields its trajectory, a row a step.

A table function joins laterally, so trajectories stay beside the columns of their cells and
stream out as they are computed; nothing is held but the current state.

    cells.lateralJoin(steps(rhs)(F.col("y").outer(), F.col("p").outer(), F.lit(1.0), F.lit(0.1)))

``rhs(t, y, p)`` gives dy/dt for a state ``y`` and parameters ``p``, both numpy arrays.

Where there are many cells, ``stepped`` and ``adapted`` give the same rows from whole Arrow
batches: all cells of a batch advance at once, and a step is one batch of rows.  There ``y`` and
``p`` are (components, cells), so ``y[0]`` is the first component of every cell, and ``t`` is a
number, or an array by cell in ``adapted``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .iterate import StepController, StepControllers, ode_step

Rhs = Callable[[float, np.ndarray, np.ndarray], np.ndarray]


def steps(rhs: Rhs, method: str = "rk4", save_every: float | None = None, clamp: bool = True):
    """Table function (y, p, t1, dt) of (step, t, h, state): from t = 0 to t1 in steps of dt, the
    last one shortened; with ``save_every`` only the steps that reach a multiple of it, and the
    last."""

    class Steps:
        def eval(self, y: list[float], p: list[float], t1: float, dt: float) -> Iterator[tuple]:
            now, par, t, n = np.array(y, float), np.array(p, float), 0.0, 0
            due = save_every
            yield 0, 0.0, 0.0, now.tolist()
            while t1 - t > 1e-12 * max(1.0, abs(t1)):
                h = min(dt, t1 - t)
                now, t, n = ode_step(lambda s, a: rhs(s, a, par), t, now, h, method, clamp), t + h, n + 1
                if save_every is None or t >= due - 1e-12 or t1 - t <= 1e-12 * max(1.0, abs(t1)):
                    yield n, t, h, now.tolist()
                    due = due and due + save_every

    return F.udtf(Steps, returnType="step int, t double, h double, state array<double>")


def controlled(rhs: Rhs, kind: str = "pi", abs_tol: float = 1e-6, rel_tol: float = 1e-3, dt_max: float = 1.0):
    """Table function (y, p, t1, dt) of (attempt, t, h, error, accepted, state): Heun's method
    with the difference to Euler's as its error, scaled and judged by ``StepController``; a
    rejected attempt is a row too, with the state and time it leaves unchanged."""

    class Controlled:
        def eval(self, y: list[float], p: list[float], t1: float, dt: float) -> Iterator[tuple]:
            now, par, t, n = np.array(y, float), np.array(p, float), 0.0, 0
            c = StepController(dt, kind, 1, dt_max=dt_max)
            while t1 - t > 1e-12 * max(1.0, abs(t1)):
                h = c.dt = min(c.dt, t1 - t)
                k1 = rhs(t, now, par)
                euler = now + h * k1
                heun = now + h / 2 * (k1 + rhs(t + h, euler, par))
                scale = abs_tol + rel_tol * np.maximum(np.abs(now), np.abs(heun))
                error = float(np.sqrt(np.mean(((heun - euler) / scale) ** 2)))
                good = c.step(error, diverging=not np.isfinite(error))
                if good:
                    now, t = heun, t + h
                n += 1
                yield n, t, h, error, good, now.tolist()

    return F.udtf(Controlled, returnType="attempt int, t double, h double, error double, accepted boolean, state array<double>")


def _cells(rows: DataFrame, y: str, p: str, more: str, advance: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]]]) -> DataFrame:
    """The other columns of rows(y, p, ...), the columns of ``more`` and ``state``.  ``advance``
    gets states and parameters as (components, cells) and yields (cells, columns, states)."""
    kept = [c for c in rows.columns if c not in (y, p)]
    schema = rows.select(*kept).schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, ps = batch.column(y), batch.column(p)
            if ys.null_count or ps.null_count:
                raise ValueError(f"a cell lacks {y} or {p}")
            sizes = np.stack([np.asarray(c.value_lengths()) for c in (ys, ps)])
            for m, k in np.unique(sizes, axis=1).T:  # cells of one shape advance together
                at = np.flatnonzero((sizes[0] == m) & (sizes[1] == k))
                own = pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in kept], kept) if len(at) < batch.num_rows else batch.select(kept)
                now, par = (np.asarray(c.take(pa.array(at)).flatten(), float).reshape(len(at), n).T for c, n in ((ys, m), (ps, k)))
                for cells, columns, state in advance(now, par):
                    mine = own if len(cells) == len(at) else own.take(pa.array(cells))
                    ends = pa.array(np.arange(len(cells) + 1) * m, pa.int32())
                    state = pa.ListArray.from_arrays(ends, pa.array(state.T.ravel()))
                    yield pa.RecordBatch.from_arrays([*mine.columns, *(pa.array(v) for v in columns.values()), state], [*kept, *columns, "state"])

    return spread(rows).mapInArrow(run, f"{schema}, {more}, state array<double>" if kept else f"{more}, state array<double>")


def stepped(rows: DataFrame, y: str, p: str, rhs: Rhs, t1: float, dt: float, method: str = "rk4", save_every: float | None = None, clamp: bool = True) -> DataFrame:
    """The rows of ``steps`` for every cell of rows(y, p, ...), beside its other columns."""

    def advance(now: np.ndarray, par: np.ndarray) -> Iterator[tuple]:
        every, t, n, due = np.arange(now.shape[1]), 0.0, 0, save_every
        row = lambda h: (every, {"step": np.full(len(every), n, np.int32), "t": np.full(len(every), t), "h": np.full(len(every), h)}, now)
        yield row(0.0)
        while t1 - t > 1e-12 * max(1.0, abs(t1)):
            h = min(dt, t1 - t)
            now, t, n = ode_step(lambda s, a: rhs(s, a, par), t, now, h, method, clamp), t + h, n + 1
            if save_every is None or t >= due - 1e-12 or t1 - t <= 1e-12 * max(1.0, abs(t1)):
                yield row(h)
                due = due and due + save_every

    return _cells(rows, y, p, "step int, t double, h double", advance)


def adapted(rows: DataFrame, y: str, p: str, rhs: Rhs, t1: float, dt: float, kind: str = "pi", abs_tol: float = 1e-6, rel_tol: float = 1e-3, dt_max: float = 1.0) -> DataFrame:
    """The rows of ``controlled`` for every cell of rows(y, p, ...), beside its other columns;
    each cell keeps its own time and step."""

    def advance(now: np.ndarray, par: np.ndarray) -> Iterator[tuple]:
        now, t, n = now.copy(), np.zeros(now.shape[1]), 0  # Arrow hands out arrays that cannot be written
        c = StepControllers(now.shape[1], dt, kind, 1, dt_max=dt_max)
        at = np.flatnonzero(t1 - t > 1e-12 * max(1.0, abs(t1)))
        while len(at):
            h = c.dt[at] = np.minimum(c.dt[at], t1 - t[at])
            y0, par0, n = now[:, at], par[:, at], n + 1
            k1 = rhs(t[at], y0, par0)
            euler = y0 + h * k1
            heun = y0 + h / 2 * (k1 + rhs(t[at] + h, euler, par0))
            scale = abs_tol + rel_tol * np.maximum(np.abs(y0), np.abs(heun))
            error = np.sqrt(np.mean(((heun - euler) / scale) ** 2, axis=0))
            good = c.step(at, error)
            now[:, at] = np.where(good, heun, y0)
            t[at] = np.where(good, t[at] + h, t[at])
            yield at, {"attempt": np.full(len(at), n, np.int32), "t": t[at], "h": h, "error": error, "accepted": good}, now[:, at]
            at = at[t1 - t[at] > 1e-12 * max(1.0, abs(t1))]

    return _cells(rows, y, p, "attempt int, t double, h double, error double, accepted boolean", advance)
