"""Planes stepped by tiles against the same steps on one dense array."""

import numpy as np
import pytest

from fieldlab.operators import iterate, tiles


def rows(spark, u, v, run=0):
    cells = [(run, i, j, float(u[i, j]), float(v[i, j])) for i in range(u.shape[0]) for j in range(u.shape[1]) if not np.isnan(u[i, j])]
    return spark.createDataFrame(cells, "run int, i long, j long, u double, v double")


def dense(df, shape, name):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.i, r.j])
        out[r.i, r.j] = r[name]
    return out


def fields(shape, seed=0):
    rng = np.random.default_rng(seed)
    return rng.random(shape), rng.random(shape)


@pytest.mark.parametrize("tile,halo,steps", [(5, 1, 3), (5, 3, 7), (8, 8, 9), (64, 4, 5)])
def test_periodic_planes(spark, tile, halo, steps):
    u, v = fields((13, 18))
    out = tiles.react_diffuse(rows(spark, u, v), "gray_scott", (0.2, 0.1), (0.04, 0.06), 0.1, steps, (1.0, 1.5), tile=tile, halo=halo, shape=(13, 18), keep_every=2)
    wu, wv = iterate.react_diffuse(u, v, "gray_scott", 0.2, 0.1, 0.04, 0.06, 0.1, steps, (1.0, 1.5))
    np.testing.assert_allclose(dense(out, u.shape, "u"), wu, rtol=1e-12)
    np.testing.assert_allclose(dense(out, u.shape, "v"), wv, rtol=1e-12)


@pytest.mark.parametrize("splitting", ["godunov", "strang"])
def test_splittings(spark, splitting):
    u, v = fields((9, 9), 1)
    out = tiles.react_diffuse(rows(spark, u, v), "brusselator", (0.2, 0.1), (1.0, 3.0), 0.01, 5, splitting=splitting, tile=4, halo=4, shape=(9, 9))
    wu, _ = iterate.react_diffuse(u, v, "brusselator", 0.2, 0.1, 1.0, 3.0, 0.01, 5, (1.0, 1.0), splitting=splitting)
    np.testing.assert_allclose(dense(out, u.shape, "u"), wu, rtol=1e-12)


@pytest.mark.parametrize("bc", ["dirichlet", "neumann"])
def test_holes_and_ragged_edges(spark, bc):
    u, v = fields((14, 11), 2)
    u[5:7, 4] = np.nan
    u[10:, 8:] = np.nan
    out = tiles.diffuse(rows(spark, u, u), 0.2, 0.5, 6, bc=bc, value=0.7, source=0.1, tile=4, halo=2)
    want = u.copy()
    for _ in range(6):
        want = want + 0.5 * (0.2 * tiles.laplacian(want, (1.0, 1.0), bc, 0.7) + 0.1)
    np.testing.assert_allclose(dense(out, u.shape, "v"), want, rtol=1e-12)


def test_dense_laplacian_agrees():
    u, _ = fields((7, 6), 3)
    np.testing.assert_allclose(tiles.laplacian(u, (1.0, 2.0), "dirichlet", 0.4), iterate.lap_2d(u, 1.0, 2.0, "dirichlet", 0.4))
    np.testing.assert_allclose(tiles.laplacian(u, (1.0, 2.0), "neumann"), iterate.lap_2d(u, 1.0, 2.0, "neumann"))


def test_shuffles_are_steps_over_halo(spark):
    u, v = fields((10, 10), 4)
    for steps, halo, shuffles in ((2, 2, 1), (3, 2, 2), (8, 2, 4)):
        out = tiles.diffuse(rows(spark, u, v), 0.2, 0.5, steps, tile=8, halo=halo, keep_every=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles


def test_several_runs_no_cells_and_errors(spark):
    u, v = fields((6, 6), 5)
    both = rows(spark, u, v).union(rows(spark, 2 * u, v, 1))
    out = tiles.diffuse(both.withColumn("v", both.u), 0.2, 0.5, 3, value=0.0, tile=4, halo=1)
    one, two = (dense(out.where(f"run = {k}"), u.shape, "v") for k in (0, 1))
    np.testing.assert_allclose(2 * one, two)
    assert tiles.diffuse(rows(spark, u, v).where("i > 99"), 0.2, 0.5, 3).count() == 0
    assert tiles.diffuse(rows(spark, u, v), 0.2, 0.5, 0).count() == 36
    with pytest.raises(ValueError, match="unstable"):
        tiles.diffuse(both, 1.0, 1.0, 1)
    with pytest.raises(ValueError, match="shape"):
        tiles.react_diffuse(both, "gray_scott", (0.1, 0.1), (0.0, 0.0), 0.1, 1)
    with pytest.raises(ValueError, match="halo"):
        tiles.diffuse(both, 0.1, 0.1, 1, tile=4, halo=5)
    custom = tiles.react_diffuse(rows(spark, u, v), lambda a, b, k: (k * a, 0 * b), (0.0, 0.0), (1.0,), 0.5, 1, bc="neumann")
    np.testing.assert_allclose(dense(custom, u.shape, "u"), 1.5 * u)
