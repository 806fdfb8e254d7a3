"""Physics-informed networks: u(x, t) as a small tanh network that obeys u_t = D u_xx + f(u).

Training points are rows (kind, x, t, u): ``data``, ``bc`` and ``ic`` rows give a value, ``pde``
rows ask for the equation.  Each round, every task computes the residuals of its rows and their
exact derivatives by all weights (forward for u_t and u_xx, reverse for the weights), and sums
the normal equations; Spark adds the tasks' sums by position, and a Levenberg-Marquardt step of
the size of the weights follows on the driver.  So a round is one scan, whatever the number of
points, and what the driver gets is bounded by the square of the number of weights.

Each kind counts by its weight (10 for ``bc`` and ``ic``, else 1) over its number of rows, so the
loss is the weighted sum of mean squares.  ``D=None`` is the inverse problem: D is fitted with the weights.  Rows with nulls where
a value is needed, and rows of unknown kinds, are left out; no rows leave the first weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import iterate, ml

#: f(u) and its derivative.
Reaction = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]

POINTS = "kind string, x double, t double, u double"
KINDS = ("data", "pde", "bc", "ic")
#: More weights than this make the driver's step too large.
MOST_WEIGHTS = 512


def none(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros_like(u), np.zeros_like(u)


@dataclass
class Model:
    """One hidden layer of ``hidden`` units: p holds the weights by x, by t, the biases, the
    output weights, the output bias and log D."""

    p: np.ndarray
    hidden: int
    fixed: float | None = None

    @property
    def D(self) -> float:
        return self.fixed if self.fixed is not None else float(np.exp(self.p[-1]))

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The weights as ``ml.predict`` takes them."""
        wx, wt, b, w = self.p[: 4 * self.hidden].reshape(4, self.hidden)
        return [(np.stack([wx, wt]), b), (w[:, None], self.p[4 * self.hidden : 4 * self.hidden + 1])]

    def predict(self, rows: DataFrame, output: str = "prediction") -> DataFrame:
        """rows(x, t, ...) with the network's value."""
        return ml.predict(rows, ["x", "t"], self.layers(), output=output)


def start(hidden: int, D: float | None, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.normal(0, 2, 2 * hidden), rng.normal(0, 1, hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), [0.0, np.log(0.5)]])
    return Model(p, hidden, D)


def evaluate(model: Model, x: np.ndarray, t: np.ndarray, equation: bool, reaction: Reaction = none) -> tuple[np.ndarray, np.ndarray]:
    """What rows leave: u, or the equation's residual u_t - D u_xx - f(u), and its derivatives
    by p, one row each."""
    h = model.hidden
    wx, wt, b, w = model.p[: 4 * h].reshape(4, h)
    s = np.tanh(x[:, None] * wx + t[:, None] * wt + b)
    s1 = 1 - s * s
    u = s @ w + model.p[4 * h]
    one, zero = np.ones((len(x), 1)), np.zeros((len(x), 1))
    if not equation:
        back = w * s1
        return u, np.hstack([back * x[:, None], back * t[:, None], back, s, one, zero])
    s2 = -2 * s * s1
    s3 = -2 * (s1 * s1 + s * s2)
    D, (f, df) = model.D, reaction(u)
    u_xx = s2 @ (w * wx * wx)
    residual = s1 @ (w * wt) - D * u_xx - f
    # by the argument of tanh, then by what makes it
    back = w * (s2 * wt - D * s3 * wx * wx - df[:, None] * s1)
    by_wx = back * x[:, None] - 2 * D * w * wx * s2
    by_wt = back * t[:, None] + w * s1
    by_w = s1 * wt - D * s2 * wx * wx - df[:, None] * s
    by_D = zero if model.fixed is not None else (-D * u_xx)[:, None]
    return residual, np.hstack([by_wx, by_wt, back, by_w, -df[:, None], by_D])


def _sums(model: Model, scale: dict[str, float], reaction: Reaction):
    n = len(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal, slope, loss = np.zeros((n, n)), np.zeros(n), 0.0
        for batch in batches:
            x, t, u = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "t", "u"))
            for name, by in scale.items():
                at = pc.fill_null(pc.equal(batch.column("kind"), name), False).to_numpy(zero_copy_only=False)
                if at.any():
                    value, jac = evaluate(model, x[at], t[at], name == "pde", reaction)
                    r = value if name == "pde" else value - u[at]
                    normal += by * (jac.T @ jac)
                    slope += by * (jac.T @ r)
                    loss += by * float(r @ r)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[loss], slope, normal.ravel()])], pa.list_(pa.float64()))], ["sums"])

    return run


def sums(points: DataFrame, model: Model, scale: dict[str, float], reaction: Reaction = none) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss, its half gradient and the normal matrix over all points, in one scan."""
    n = len(model.p)
    parts = points.select("kind", "x", "t", "u").mapInArrow(_sums(model, scale, reaction), "sums array<double>")
    rows = parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()  # 1 + n + n * n
    flat = np.zeros(1 + n + n * n)
    for r in rows:
        flat[r["at"]] = r.v
    return float(flat[0]), flat[1 : n + 1], flat[n + 1 :].reshape(n, n)


def usable(points: DataFrame) -> DataFrame:
    return points.where(F.col("kind").isin(list(KINDS)) & F.col("x").isNotNull() & F.col("t").isNotNull() & ((F.col("kind") == "pde") | F.col("u").isNotNull()))


def train(points: DataFrame, D: float | None, hidden: int = 12, rounds: int = 40, weights: dict[str, float] | None = None, reaction: Reaction = none, model: Model | None = None, tolerance: float = 1e-9) -> tuple[Model, list[float]]:
    """The model and its loss after every accepted step; training ends at the tolerance, after
    ``rounds`` scans or when no step helps any more."""
    now = model or start(hidden, D)
    if len(now.p) > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights")
    rows = usable(points)
    counts = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    scale = {k: ({"bc": 10.0, "ic": 10.0} | (weights or {})).get(k, 1.0) / counts[k] for k in KINDS if counts.get(k)}
    loss, slope, normal = sums(rows, now, scale, reaction)
    losses, damping = [loss], 1.0
    for _ in range(rounds if scale else 0):
        step = np.linalg.solve(normal + damping * (np.diag(np.diag(normal)) + 1e-2 * np.eye(len(slope))), -slope)
        trial = Model(now.p + step, now.hidden, now.fixed)
        got = sums(rows, trial, scale, reaction)
        if np.isfinite(got[0]) and got[0] < loss:
            now, (loss, slope, normal), damping = trial, got, max(damping / 3, 1e-12)
            losses.append(loss)
            if loss < tolerance:
                break
        else:
            damping *= 4
            if damping > 1e8:
                break
    return now, losses


def residuals(points: DataFrame, model: Model, reaction: Reaction = none) -> DataFrame:
    """points with ``residual``: how far each place is from the equation."""
    schema = points.withColumn("residual", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, t = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "t"))
            value, _ = evaluate(model, x, t, True, reaction)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, "residual"])

    return points.mapInArrow(run, schema)


def train_adaptive(points: DataFrame, pool: DataFrame, n: int, D: float | None, cycles: int = 2, reaction: Reaction = none, **how) -> tuple[Model, list[float]]:
    """Training in cycles: after each, ``n`` places of pool(x, t), drawn with odds that follow
    their residuals, join the points."""
    model, losses = train(points, D, reaction=reaction, **how)
    for k in range(cycles):
        far = residuals(pool.select(F.lit(0).alias("_k"), "x", "t"), model, reaction)
        drawn = ml.residual_sample(far, "_k", "residual", n, seed=k)
        points = iterate.keep(points.select("kind", "x", "t", "u").union(drawn.select(F.lit("pde"), "x", "t", F.lit(None).cast("double"))))
        model, more = train(points, D, reaction=reaction, model=model, **how)
        losses += more
    return model, losses


def hybrid(grid: DataFrame, model: Model, t_coarse: float, t_end: float, dx: float, steps: int, bc: str = "dirichlet") -> DataFrame:
    """(run, i, v) at t_end: the network's field at t_coarse on grid(run, i, x), refined from
    there by explicit steps."""
    if steps < 1 or t_end <= t_coarse:
        raise ValueError("the refinement needs at least one step forward")
    field = model.predict(grid.withColumn("t", F.lit(float(t_coarse))), "v")
    return iterate.diffuse_runs(field.select("run", "i", "v"), model.D, dx, (t_end - t_coarse) / steps, steps, bc)
