"""Solvers by name, strategies around them, and their options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from .linalg import bicgstab, conjugate_gradient, jacobi, residual

SOLVERS: dict[str, Callable[..., DataFrame]] = {"jacobi": jacobi, "cg": conjugate_gradient, "bicgstab": bicgstab}


def register(name: str, solver: Callable[..., DataFrame]) -> None:
    if name in SOLVERS:
        raise ValueError(f"solver {name} exists")
    SOLVERS[name] = solver


@dataclass(frozen=True)
class Options:
    solver: str = "cg"
    tolerance: float = 1e-8
    max_iterations: int = 100

    def problems(self) -> list[str]:
        out = [] if self.solver in SOLVERS else [f"unknown solver {self.solver}"]
        out += [] if self.tolerance > 0 else ["tolerance must be positive"]
        return out + ([] if self.max_iterations > 0 else ["max_iterations must be positive"])

    @classmethod
    def preset(cls, name: str) -> Options:
        return {"fast": cls("jacobi", 1e-3, 50), "balanced": cls("cg", 1e-6, 200), "accurate": cls("bicgstab", 1e-10, 1000)}[name]


@dataclass(frozen=True)
class Result:
    x: DataFrame
    residual: float
    converged: bool
    attempts: int


Hook = Callable[[int], None]


def solve(matrix: DataFrame, b: DataFrame, options: Options, before: Hook | None = None, after: Hook | None = None) -> Result:
    if options.problems():
        raise ValueError("; ".join(options.problems()))
    if before:
        before(1)
    x = SOLVERS[options.solver](matrix, b, options.max_iterations, options.tolerance)
    left = residual(matrix, x, b).first()[0]
    if after:
        after(1)
    return Result(x, left, left <= max(options.tolerance * 10, 1e-12), 1)


def retry(matrix: DataFrame, b: DataFrame, options: Options, attempts: int = 3) -> Result:
    """Solve again with ten times the tolerance and twice the iterations until it converges."""
    result = None
    for k in range(1, attempts + 1):
        result = replace(solve(matrix, b, options), attempts=k)
        if result.converged:
            break
        options = replace(options, tolerance=options.tolerance * 10, max_iterations=options.max_iterations * 2)
    return result


def time_steps(state: DataFrame, step: Callable[[DataFrame, float, float], DataFrame], t0: float, t1: float, dt: float) -> DataFrame:
    """step(state, t, dt) from t0 to t1, the last step shortened."""
    from .iterate import keep

    t, k = t0, 0
    while t1 - t > 1e-12 * max(1.0, abs(t1)):
        h = min(dt, t1 - t)
        state, t, k = step(state, t, h), t + h, k + 1
        if k % 10 == 0:
            state = keep(state)
    return state


def choose_method(cfl: float) -> str:
    """Explicit while stable, Crank-Nicolson a while beyond, implicit Euler after that."""
    return "explicit" if cfl <= 0.5 else "crank_nicolson" if cfl <= 5.0 else "implicit"


class LossScaler:
    """Scale that halves on overflow and doubles after a run of good steps."""

    def __init__(self, scale: float = 65536.0, interval: int = 2000):
        self.scale, self.interval, self.good = scale, interval, 0

    def update(self, overflow: bool) -> float:
        if overflow:
            self.scale, self.good = max(1.0, self.scale / 2), 0
        else:
            self.good += 1
            if self.good == self.interval:
                self.scale, self.good = self.scale * 2, 0
        return self.scale
