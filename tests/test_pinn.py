"""Small physics networks: derivatives against differences, errors against exact solutions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.operators import pinn

D = 0.1


def exact(x, t):
    return math.exp(-D * math.pi**2 * t) * math.sin(math.pi * x)


def points(spark, n=150, seed=0, data=0):
    rng = np.random.default_rng(seed)
    rows = [("pde", *map(float, rng.random(2)), None) for _ in range(n)]
    rows += [("ic", float(x), 0.0, exact(x, 0)) for x in rng.random(40)]
    rows += [("bc", float(k % 2), float(t), 0.0) for k, t in enumerate(rng.random(40))]
    rows += [("data", float(x), float(t), exact(x, t)) for x, t in rng.random((data, 2))]
    return spark.createDataFrame(rows + [("bc", None, 0.5, 0.0), ("ic", 0.5, 0.0, None), ("odd", 0.1, 0.1, 9.0)], pinn.POINTS).repartition(3)


def worst(spark, model):
    grid = spark.createDataFrame([(i / 10, j / 10, exact(i / 10, j / 10)) for i in range(11) for j in range(11)], "x double, t double, want double")
    return model.predict(grid).agg(F.max(F.abs(F.col("prediction") - F.col("want")))).first()[0]


@pytest.mark.parametrize("equation", [False, True])
def test_derivatives_by_the_weights(equation):
    model = pinn.start(5, None, 3)
    reaction = lambda u: (u * (1 - u), 1 - 2 * u)
    x, t = np.random.default_rng(1).random((2, 7))
    value, jac = pinn.evaluate(model, x, t, equation, reaction)
    for k in range(len(model.p)):
        moved = [pinn.Model(model.p + e * np.eye(len(model.p))[k], 5) for e in (1e-6, -1e-6)]
        difference = (pinn.evaluate(moved[0], x, t, equation, reaction)[0] - pinn.evaluate(moved[1], x, t, equation, reaction)[0]) / 2e-6
        np.testing.assert_allclose(jac[:, k], difference, atol=1e-6)
    if equation:
        u = lambda a, b: pinn.evaluate(model, a, b, False)[0]
        h = 1e-4
        u_t, u_xx = (u(x, t + h) - u(x, t - h)) / (2 * h), (u(x + h, t) - 2 * u(x, t) + u(x - h, t)) / h**2
        np.testing.assert_allclose(value, u_t - model.D * u_xx - reaction(u(x, t))[0], atol=1e-5)


def test_training_meets_the_exact_solution(spark):
    model, losses = pinn.train(points(spark), D, hidden=10, rounds=45)
    assert losses == sorted(losses, reverse=True) and losses[-1] < 1e-2 and worst(spark, model) < 2e-2
    grid = spark.range(1, 20).select(F.lit(1).alias("run"), (F.col("id") - 1).alias("i"), (F.col("id") / 20).alias("x"))
    refined = {r.i: r.v for r in pinn.hybrid(grid, model, 0.5, 1.0, 1 / 20, 80).collect()}
    assert max(abs(v - exact((i + 1) / 20, 1.0)) for i, v in refined.items()) < 2e-2
    with pytest.raises(ValueError):
        pinn.hybrid(grid, model, 1.0, 0.5, 0.05, 10)


def test_the_inverse_problem_finds_the_diffusivity(spark):
    model, _ = pinn.train(points(spark, data=150), None, hidden=10, rounds=45)
    assert model.D == pytest.approx(D, rel=0.1)


def test_adaptive_points(spark):
    pool = spark.range(400).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("t"))
    model, losses = pinn.train_adaptive(points(spark, 30), pool, 40, D, cycles=1, hidden=8, rounds=15)
    assert np.isfinite(losses).all() and worst(spark, model) < 0.15
    none, losses = pinn.train(points(spark).where("x > 5"), D, hidden=4, rounds=3)
    assert losses == [0.0] and len(none.p) == 18
