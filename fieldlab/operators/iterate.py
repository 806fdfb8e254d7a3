"""Bounded iteration over DataFrames, and numpy steppers for independent runs.

``iterate`` repeats a DataFrame step and cuts lineage through shared storage; it suits
grids that are spread over tasks.  Where runs (cells, particles, small grids) are
independent, ``per_run`` steps each in numpy inside ``applyInPandas``, all runs in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def keep(df: DataFrame) -> DataFrame:
    """df written to the folder that the cluster shares and read back."""
    spark = df.sparkSession
    at = shared_folder(spark, "state")
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._kept = at
    return out


def discard(*states: DataFrame) -> None:
    """Delete what ``keep`` wrote for them; nothing may read it any more."""
    for df in states:
        if at := getattr(df, "_kept", None):
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: If true, a query's shuffle files go when it ends, not when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it each query's shuffle files are deleted at its end."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, every: int = 10, until: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """step applied n times, lineage cut every ``every`` steps; ``until`` is asked at each cut."""
    for k in range(1, n + 1):
        state = step(state)
        if k % every == 0 and k < n:
            state = keep(state)
            if until is not None and until(state):
                return state
    return state


def per_run(rows: DataFrame, run: str, order: list[str], advance: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows of each run, in order, as arrays by column through ``advance``."""

    def apply(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        return pd.DataFrame(advance({c: part[c].to_numpy() for c in part.columns}))

    return rows.groupBy(run).applyInPandas(apply, schema)


# ----------------------------------------------------------------- ODE steppers

Rhs = Callable[[float, np.ndarray], np.ndarray]


def ode_step(f: Rhs, t: float, y: np.ndarray, dt: float, method: str, clamp: bool = True) -> np.ndarray:
    """One step of ``euler``, ``rk2`` (midpoint) or ``rk4``; every stage is clamped at 0."""
    low = (lambda a: np.maximum(a, 0.0)) if clamp else (lambda a: a)
    k1 = f(t, y)
    if method == "euler":
        return low(y + dt * k1)
    k2 = f(t + dt / 2, low(y + dt / 2 * k1))
    if method == "rk2":
        return low(y + dt * k2)
    if method != "rk4":
        raise ValueError(f"unknown method {method}")
    k3 = f(t + dt / 2, low(y + dt / 2 * k2))
    k4 = f(t + dt, low(y + dt * k3))
    return low(y + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4))


def integrate(f: Rhs, y: np.ndarray, t0: float, t1: float, dt: float, method: str = "rk4", save_every: float | None = None) -> list[tuple[float, np.ndarray]]:
    """(t, y) at the start, at each save interval and at t1; the last step is shortened."""
    t, out, due = t0, [(t0, y)], t0 + (save_every or np.inf)
    while t1 - t > 1e-12 * max(1.0, abs(t1)):
        h = min(dt, t1 - t)
        y, t = ode_step(f, t, y, h, method), t + h
        if t >= due - 1e-12:
            out.append((t, y))
            due += save_every
    if out[-1][0] != t:
        out.append((t, y))
    return out


def mechanism_rhs(nu_r: np.ndarray, nu_p: np.ndarray, k_f: np.ndarray, k_r: np.ndarray) -> Rhs:
    """d conc / dt of a mass-action mechanism; nu are (reactions, species)."""

    def f(_: float, c: np.ndarray) -> np.ndarray:
        forward = k_f * np.prod(np.power(c[None, :], nu_r), axis=1)
        reverse = k_r * np.prod(np.power(c[None, :], nu_p), axis=1)
        return (nu_p - nu_r).T @ (forward - reverse)

    return f


def jacobian(f: Rhs, y: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Forward differences with steps eps * max(|y|, 1)."""
    base, out = f(0.0, y), np.zeros((len(y), len(y)))
    for j in range(len(y)):
        d = eps * max(abs(y[j]), 1.0)
        z = y.copy()
        z[j] += d
        out[:, j] = (f(0.0, z) - base) / d
    return out


def stiffness(jac: np.ndarray) -> float:
    """Largest over smallest |diagonal| above 1e-12; 0 where there is none."""
    d = np.abs(np.diag(jac))
    d = d[d > 1e-12]
    return float(d.max() / d.min()) if len(d) else 0.0


def decay(rows: DataFrame, run: str, value: str, rate: str, dt: float, steps: int, method: str = "rk4") -> DataFrame:
    """(run, y): dy/dt = -rate y for each row, all cells of a batch in one array."""

    def apply(batches):
        for part in batches:
            y, k = part[value].to_numpy(float), part[rate].to_numpy(float)
            for s in range(steps):
                y = ode_step(lambda _, a: -k * a, s * dt, y, dt, method)
            yield pd.DataFrame({run: part[run], "y": y})

    return rows.select(run, value, rate).mapInPandas(apply, f"{run} long, y double")


# ----------------------------------------------------------------- grids of runs


def lap_1d(u: np.ndarray, dx: float, bc: str, left: float = 0.0, right: float = 0.0) -> np.ndarray:
    """Laplacian with ghosts: ``dirichlet`` values, ``neumann`` gradients, ``periodic``."""
    if bc == "dirichlet":
        a, b = left, right
    elif bc == "neumann":
        a, b = u[0] - left * dx, u[-1] + right * dx
    else:
        a, b = u[-1], u[0]
    full = np.concatenate([[a], u, [b]])
    return (full[2:] - 2 * full[1:-1] + full[:-2]) / (dx * dx)


def lap_2d(u: np.ndarray, dx: float, dy: float, bc: str, value: float = 0.0) -> np.ndarray:
    full = np.pad(u, 1, mode="wrap") if bc == "periodic" else np.pad(u, 1, mode="edge") if bc == "neumann" else np.pad(u, 1, constant_values=value)
    return (full[2:, 1:-1] - 2 * u + full[:-2, 1:-1]) / (dx * dx) + (full[1:-1, 2:] - 2 * u + full[1:-1, :-2]) / (dy * dy)


def check_cfl(D: float, dt: float, *spacing: float) -> float:
    """The explicit scheme's number; more than 1/2 is an error."""
    number = D * dt * sum(1 / (h * h) for h in spacing)
    if number > 0.5 + 1e-12:
        raise ValueError(f"unstable step: {number} > 0.5")
    return number


def diffuse_runs(field: DataFrame, D: float, dx: float, dt: float, steps: int, bc: str = "neumann", left: float = 0.0, right: float = 0.0, method: str = "explicit", run: str = "run") -> DataFrame:
    """(run, i, v) after steps of 1D diffusion: ``explicit``, ``implicit`` Euler or
    ``crank_nicolson``."""
    if method == "explicit":
        check_cfl(D, dt, dx)

    def advance(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        u = c["v"].astype(float)
        for _ in range(steps):
            u = u + dt * D * lap_1d(u, dx, bc, left, right) if method == "explicit" else implicit_step(u, D * dt / (dx * dx), 1.0 if method == "implicit" else 0.5, bc, left, right, dx)
        return {run: c[run], "i": c["i"], "v": u}

    return per_run(field.select(run, "i", "v"), run, ["i"], advance, f"{run} long, i long, v double")


def implicit_step(u: np.ndarray, number: float, theta: float, bc: str, left: float, right: float, dx: float) -> np.ndarray:
    """One theta-step of the tridiagonal system by forward elimination; periodic ends by the
    rank-one correction."""
    if bc == "periodic":
        n = len(u)
        matrix = np.eye(n) * (1 + 2 * theta * number)
        at = np.arange(n)
        matrix[at, (at + 1) % n] -= theta * number
        matrix[at, (at - 1) % n] -= theta * number
        return np.linalg.solve(matrix, u + (1 - theta) * number * lap_1d(u, 1.0, bc))
    lower = np.full(len(u), -theta * number)
    main = np.full(len(u), 1 + 2 * theta * number)
    rhs = u + (1 - theta) * number * dx * dx * lap_1d(u, dx, bc, left, right)
    if bc == "dirichlet":
        rhs[0] += theta * number * left
        rhs[-1] += theta * number * right
    else:
        main[0] -= theta * number
        main[-1] -= theta * number
        rhs[0] -= theta * number * left * dx
        rhs[-1] += theta * number * right * dx
    return tridiagonal(lower, main, lower, rhs)


def tridiagonal(lower: np.ndarray, main: np.ndarray, upper: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    n = len(rhs)
    c, d, x = np.zeros(n), np.zeros(n), np.zeros(n)
    c[0], d[0] = upper[0] / main[0], rhs[0] / main[0]
    for i in range(1, n):
        m = main[i] - lower[i] * c[i - 1]
        c[i], d[i] = upper[i] / m, (rhs[i] - lower[i] * d[i - 1]) / m
    x[-1] = d[-1]
    for i in range(n - 2, -1, -1):
        x[i] = d[i] - c[i] * x[i + 1]
    return x


REACTIONS: dict[str, Callable[..., tuple[np.ndarray, np.ndarray]]] = {
    "gray_scott": lambda u, v, a, b: (-u * v * v + a * (1 - u), u * v * v - (a + b) * v),
    "brusselator": lambda u, v, a, b: (a - (b + 1) * u + u * u * v, b * u - u * u * v),
    "schnakenberg": lambda u, v, a, b: (a - u + u * u * v, b - u * u * v),
}


def react_diffuse(u: np.ndarray, v: np.ndarray, model: str, Du: float, Dv: float, p: float, q: float, dt: float, steps: int, spacing: tuple[float, ...], bc: str = "periodic", splitting: str = "none") -> tuple[np.ndarray, np.ndarray]:
    """Two species on a 1D or 2D grid; ``none`` adds both terms in one Euler step, ``godunov``
    takes them in turn, ``strang`` halves diffusion around the reaction."""
    lap = (lambda a: lap_1d(a, spacing[0], bc)) if u.ndim == 1 else (lambda a: lap_2d(a, spacing[0], spacing[1], bc))
    f = REACTIONS[model]

    def diffuse(u, v, h):
        return u + h * Du * lap(u), v + h * Dv * lap(v)

    def react(u, v, h):
        fu, fv = f(u, v, p, q)
        return u + h * fu, v + h * fv

    for _ in range(steps):
        if splitting == "strang":
            u, v = diffuse(*react(*diffuse(u, v, dt / 2), dt), dt / 2)
        elif splitting == "godunov":
            u, v = react(*diffuse(u, v, dt), dt)
        else:
            fu, fv = f(u, v, p, q)
            u, v = u + dt * (Du * lap(u) + fu), v + dt * (Dv * lap(v) + fv)
    return u, v


def react_runs(field: DataFrame, model: str, Du: float, Dv: float, p: float, q: float, dt: float, steps: int, dx: float, bc: str = "periodic", splitting: str = "none", run: str = "run") -> DataFrame:
    """(run, i, u, v) after steps of 1D reaction-diffusion."""

    def advance(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        u, v = react_diffuse(c["u"].astype(float), c["v"].astype(float), model, Du, Dv, p, q, dt, steps, (dx,), bc, splitting)
        return {run: c[run], "i": c["i"], "u": u, "v": v}

    return per_run(field.select(run, "i", "u", "v"), run, ["i"], advance, f"{run} long, i long, u double, v double")


def steady_coverage(rates: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, dt: float = 1e-3, tolerance: float = 1e-10, most: int = 100_000) -> np.ndarray:
    """Pseudo-time steps clamped to [0, 1] until the largest change falls below the tolerance."""
    for _ in range(most):
        change = dt * rates(theta)
        theta = np.clip(theta + change, 0.0, 1.0)
        if np.abs(change).max() < tolerance:
            break
    return theta


class StepController:
    """Adaptive time steps: accept up to error 1, then Elementary, PI or PID."""

    def __init__(self, dt: float, kind: str = "pi", order: int = 2, safety: float = 0.9, least: float = 0.2, most: float = 5.0, dt_min: float = 1e-12, dt_max: float = 1.0, beta1: float = 0.7, beta2: float = 0.4, beta3: float = 0.1, max_rejections: int = 10):
        self.dt, self.kind, self.order, self.safety, self.least, self.most = dt, kind, order, safety, least, most
        self.dt_min, self.dt_max, self.betas, self.max_rejections = dt_min, dt_max, (beta1, beta2, beta3), max_rejections
        self.before = self.before2 = 0.0
        self.accepted = self.rejected = self.streak = 0

    def _scale(self, error: float) -> float:
        error, e = max(error, 1e-10), 1.0 / (self.order + 1)
        b1, b2, b3 = self.betas
        if self.kind == "elementary":
            out = self.safety * (1 / error) ** e
        else:
            ratio = error / self.before if self.before > 0 else 1.0
            out = self.safety * (1 / error) ** (b1 * e) * ratio ** (-b2 * e)
            if self.kind == "pid":
                older = self.before / self.before2 if self.before2 > 0 and self.before > 0 else 1.0
                out *= older ** (b3 * e)
        return min(self.most, max(self.least, out))

    def step(self, error: float, diverging: bool = False) -> bool:
        """Whether the step with this scaled error is accepted; ``dt`` is the next step."""
        good = not diverging and error <= 1.0
        if good:
            new = self.dt * self._scale(error)
            self.before2, self.before = self.before, error
            self.accepted, self.streak = self.accepted + 1, 0
        else:
            new = self.dt * self.least
            self.rejected, self.streak = self.rejected + 1, self.streak + 1
            if self.streak >= self.max_rejections and not diverging:
                raise RuntimeError("too many rejected steps in a row")
        self.dt = new if diverging else min(self.dt_max, max(self.dt_min, new))
        return good


class StepControllers(StepController):
    """StepController for n cells at once, each with its own step and history."""

    def __init__(self, n: int, dt: float, kind: str = "pi", order: int = 2, **how):
        super().__init__(dt, kind, order, **how)
        self.dt, self.before, self.before2, self.streak = np.full(n, float(dt)), np.zeros(n), np.zeros(n), np.zeros(n, int)

    def _scales(self, error: np.ndarray, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        error, e = np.maximum(error, 1e-10), 1.0 / (self.order + 1)
        b1, b2, b3 = self.betas
        if self.kind == "elementary":
            out = self.safety * (1 / error) ** e
        else:
            ratio = np.where(before > 0, error / np.where(before > 0, before, 1.0), 1.0)
            out = self.safety * (1 / error) ** (b1 * e) * ratio ** (-b2 * e)
            if self.kind == "pid":
                known = (before2 > 0) & (before > 0)
                out = out * np.where(known, before / np.where(known, before2, 1.0), 1.0) ** (b3 * e)
        return np.minimum(self.most, np.maximum(self.least, out))

    def step(self, at: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Which of the cells ``at`` have their steps accepted; errors that aren't finite diverge."""
        diverging = ~np.isfinite(error)
        good = ~diverging & (error <= 1.0)
        dt, before, before2 = self.dt[at], self.before[at], self.before2[at]
        new = dt * np.where(good, self._scales(np.where(good, error, 1.0), before, before2), self.least)
        self.before2[at], self.before[at] = np.where(good, before, before2), np.where(good, error, before)
        self.streak[at] = np.where(good, 0, self.streak[at] + 1)
        if np.any((self.streak[at] >= self.max_rejections) & ~diverging):
            raise RuntimeError("too many rejected steps in a row")
        self.accepted, self.rejected = self.accepted + int(good.sum()), self.rejected + int((~good).sum())
        self.dt[at] = np.where(diverging, new, np.clip(new, self.dt_min, self.dt_max))
        return good


def total_mass(field: DataFrame, dx: float, run: str = "run") -> DataFrame:
    return field.groupBy(run).agg((F.sum("v") * dx).alias("mass"))
