"""Operators against small cases worked out by hand or with numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.operators import config, iterate, linalg, mesh, ml, norms, partition, patterns, reactions


def field(spark, **runs):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in runs.items() for i, v in enumerate(vs)], "run string, i long, v double")


CASES = {
    "varying": ([0.5, 1, 1.5, 1, 0.5], (0.9, 0.14, 1, 0.071429, 0, 1, 4.75, 1.05492)),
    "amp": ([0.2, 0.8, 0.5, 1.2, 0.3], (0.6, 0.132, 1, -0.643939, 0, 0.72265, 2.46, 1.609438)),
    "noisy": ([1, 0.5, 1.5, 0.3, 1.2, 0.8], (0.883333, 0.164722, 1.2, -1.034401, 0, 0.410557, 5.67, 1.791759)),
    "asymmetric": ([1, 2, 3, 4, 5], (3, 2, 4, 0.5, 0, 0.34062, 55, 1.609438)),
}


def test_pattern_metrics(spark):
    out = {r.run: r for r in patterns.analyze(field(spark, **{k: v for k, (v, _) in CASES.items()}, one=[2.0], flat=[1, 1, 1])).collect()}
    for k, (_, want) in CASES.items():
        r = out[k]
        assert (r["mean"], r.variance, r.amplitude, r.correlation, r.wavelength, r.symmetry, r.energy, r.entropy) == pytest.approx(want, abs=2e-6)
    assert (out["one"].correlation, out["one"].symmetry, out["one"].entropy) == (0, 1, 0) and out["flat"].pattern == "UNIFORM"


def test_wavelength_is_twice_the_period(spark):
    rows = field(spark, stripes=[0.5 + 0.5 * math.sin(2 * math.pi * (i + 0.01) / 10) for i in range(100)])
    assert patterns.dominant_wavelength(rows).first().wavelength == 20


def test_stability(spark):
    a = field(spark, p=[1, 2, 3, 2, 1], q=[1, 2])
    b = field(spark, p=[1.001, 2, 2.999, 2.001, 0.999], q=[1, 2, 3])
    assert {r.run: r.stable for r in patterns.stable(a, b, 0.01).collect()} == {"p": True, "q": False}
    row = norms.flags(field(spark, n=[1, float("nan")]), ["run"], "v", 0, 10).first()
    assert row.has_nan and not row.in_bounds and row.diverging


def catalog(spark):
    stoich = spark.createDataFrame([("f", "A", "R", 1.0), ("f", "B", "P", 1.0), ("g", "B", "R", 1.0), ("g", "C", "P", 1.0)], "rxn string, species string, side string, coeff double")
    rx = spark.createDataFrame([("f", 1e10, 0.0, 5e4, 0.0, 0.0, 0.0, False), ("g", 5e9, 0.0, 4e4, 0.0, 0.0, 0.0, False)], "rxn string, a_f double, b_f double, e_f double, a_r double, b_r double, e_r double, reversible boolean")
    species = spark.createDataFrame([("A", 10.0, "gas"), ("B", 5.0, "gas"), ("C", 1.0, "solid")], "species string, conc double, phase string")
    return stoich, rx, species


def test_reactions(spark):
    stoich, rx, species = catalog(spark)
    rates = reactions.rates_of_progress(stoich, rx, species, 1000.0)
    got = {r.species: r.rate for r in reactions.production_rates(stoich, rates).collect()}
    assert got == {"A": pytest.approx(-244440785.9849524), "B": pytest.approx(40980830.1587691), "C": pytest.approx(203459955.8261833)}
    with pytest.raises(Exception, match="no concentration"):
        reactions.rates_of_progress(stoich, rx, species.where("species <> 'A'"), 1000.0).collect()
    assert {r.species for r in reactions.pure(stoich, "R").collect()} == {"A"}
    assert {r.equation for r in reactions.equations(stoich, rx, F.col("species")).collect()} == {"A => B", "B => C"}
    reach = reactions.reachable(reactions.network_edges(stoich), spark.createDataFrame([("A",)], "src string"), 5)
    assert {(r.dst, r.hops) for r in reach.collect()} == {("A", 0), ("B", 1), ("C", 2)}
    with pytest.raises(Exception, match="exists"):
        reactions.add_unique(species, species, "species").collect()
    assert reactions.add_unique(species.limit(0), species, "species").count() == 3


def test_reachable_without_bound(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(7)] + [(7, 3), (20, 0)], "src int, dst int")
    found = {(r.src, r.dst): r.hops for r in reactions.reachable(edges, spark.createDataFrame([(0,), (5,)], "src int")).collect()}
    assert found == {(0, k): k for k in range(8)} | {(5, 5): 0, (5, 6): 1, (5, 7): 2, (5, 3): 3, (5, 4): 4}


def test_hydrogen_rates(spark):
    stoich = spark.createDataFrame([("r", "H2", "R", 1.0), ("r", "O2", "R", 1.0), ("r", "OH", "P", 2.0)], "rxn string, species string, side string, coeff double")
    rx = spark.createDataFrame([("r", 1e13, 0.0, 2e5, 1e12, 0.0, 5e4, True)], "rxn string, a_f double, b_f double, e_f double, a_r double, b_r double, e_r double, reversible boolean")
    conc = spark.createDataFrame([("H2", 10.0), ("O2", 5.0), ("OH", 0.1)], "species string, conc double")
    r = reactions.rates_of_progress(stoich, rx, conc, 1500.0).first()
    assert (r.forward, r.reverse, r.net) == (pytest.approx(54212544.91863613), pytest.approx(181460643.92463243), pytest.approx(-127248099.0059963))


def coo(spark, dense):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(dense) for j, v in enumerate(row) if v], "i long, j long, v double")


def vec(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")


def test_linear_algebra(spark):
    a = coo(spark, [[2, -1, 0], [-1, 2, -1], [0, -1, 2]])
    assert {r.i: r.y for r in linalg.spmv(a, vec(spark, [1, 2, 3])).collect()} == {0: 0.0, 1: 0.0, 2: 4.0}
    assert linalg.asymmetry(a).first().worst == 0 and linalg.well_posed(a, 3).first().posed
    dense = np.array([[4, 1, 0], [2, 5, 1], [0, 1, 3]], float)
    b = [1.0, 2.0, 3.0]
    want = np.linalg.solve(dense, b)
    for solve, n in ((linalg.jacobi, 40), (linalg.bicgstab, 10)):
        got = {r.i: r.x for r in solve(coo(spark, dense), vec(spark, b), n).collect()}
        assert [got[k] for k in range(3)] == pytest.approx(want, abs=1e-6)
    fixed, rhs = linalg.dirichlet(a, vec(spark, [0, 0, 0]), 0, 7.0)
    assert {(r.i, r.j) for r in fixed.collect()} == {(0, 0), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)} and rhs.where("i = 0").first().x == 7
    assert {(r.i, r.j): r.v for r in linalg.matmul(a, a).collect()}[(0, 0)] == 5
    assert linalg.put(a, 0, 2, 9.0).where("i = 0 and j = 2").first().v == 9


def test_ode_and_controller():
    for method, tolerance in (("euler", 0.01), ("rk2", 1e-4), ("rk4", 1e-6)):
        _, y = iterate.integrate(lambda _, c: -0.1 * c, np.array([1.0]), 0, 10, 0.1, method)[-1]
        assert y[0] == pytest.approx(math.exp(-1), abs=tolerance)
    saved = iterate.integrate(lambda _, c: -c, np.array([1.0]), 0, 1, 0.3, save_every=0.3)
    assert [t for t, _ in saved] == pytest.approx([0, 0.3, 0.6, 0.9, 1.0])
    f = iterate.mechanism_rhs(np.array([[1.0, 0]]), np.array([[0, 1.0]]), np.array([2.0]), np.array([0.0]))
    _, y = iterate.integrate(f, np.array([1.0, 0.0]), 0, 2, 0.01)[-1]
    assert y.sum() == pytest.approx(1) and y[0] == pytest.approx(math.exp(-4), rel=1e-6)
    jac = iterate.jacobian(f, np.array([1.0, 0.5]))
    assert jac == pytest.approx(np.array([[-2, 0], [2, 0]]), abs=1e-5) and iterate.stiffness(np.diag([-1.0, 5000.0])) == 5000
    c = iterate.StepController(0.1, "elementary", order=1)
    assert c.step(0.5) and c.dt == pytest.approx(0.1 * 0.9 * 2**0.5) and not c.step(4.0)
    with pytest.raises(RuntimeError):
        for _ in range(20):
            c.step(4.0)
    theta = iterate.steady_coverage(lambda t: 1 - 2 * t, np.array([0.9]), 1e-2)
    assert theta[0] == pytest.approx(0.5, abs=1e-6)


def test_diffusion_keeps_mass_and_follows_the_exact_solution(spark):
    n, dx, D = 100, 0.01, 1.0
    x = (np.arange(n) + 0.5) * dx
    u0 = np.exp(-((x - 0.5) ** 2) / (2 * 0.1**2))
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(u0)], "run long, i long, v double")
    t = 5e-4
    s = math.sqrt(2 * D * t + 0.01)
    exact = 0.1 / s * np.exp(-((x - 0.5) ** 2) / (2 * s * s))
    for method, dt in (("explicit", 4e-5), ("implicit", 1e-5), ("crank_nicolson", 1e-4)):
        out = iterate.diffuse_runs(rows, D, dx, dt, round(t / dt), method=method).orderBy("i").toPandas().v.to_numpy()
        assert out.sum() == pytest.approx(u0.sum(), rel=1e-9) and np.abs(out - exact).max() < 2e-3
    with pytest.raises(ValueError, match="unstable"):
        iterate.diffuse_runs(rows, D, dx, 1e-3, 1)
    flat = iterate.implicit_step(np.ones(7), 3.0, 1.0, "periodic", 0, 0, 1.0)
    assert flat == pytest.approx(np.ones(7))


def test_splittings_agree_for_small_steps():
    rng = np.random.default_rng(0)
    u, v = 1 + 0.1 * rng.random(50), 3 + 0.1 * rng.random(50)
    ends = [iterate.react_diffuse(u, v, "brusselator", 0.1, 0.2, 1.0, 3.0, 1e-4, 200, (1.0,), splitting=k)[0] for k in ("none", "godunov", "strang")]
    assert ends[0] == pytest.approx(ends[1], abs=1e-4) and ends[0] == pytest.approx(ends[2], abs=1e-4)
    w, _ = iterate.react_diffuse(np.ones((6, 5)), np.zeros((6, 5)), "gray_scott", 1, 1, 0.04, 0.06, 0.1, 3, (1.0, 1.0))
    assert w == pytest.approx(np.ones((6, 5)))


def test_iterate_stops(spark):
    out = iterate.iterate(spark.createDataFrame([(1.0,)], "v double"), lambda d: d.select((F.col("v") * 2).alias("v")), 50, every=4, until=lambda d: d.first().v > 100)
    assert out.first().v == 256


def tetra(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0), (2, 1.0, 0.0, 0.0, 0), (3, 0.0, 1.0, 0.0, 0), (4, 0.0, 0.0, 1.0, 0)], "id long, x double, y double, z double, tag int")
    elements = spark.createDataFrame([(1, "triangle", [1, 2, 3], 1), (2, "tet", [1, 2, 3, 4], 1), (3, "line", [1, 2], 2), (4, "triangle", [1, 2], 2), (5, "line", [1, 9], 3)], "id long, type string, node_ids array<long>, tag int")
    return nodes, elements


def test_mesh(spark):
    nodes, elements = tetra(spark)
    got = {r.id: r.measure for r in mesh.measure(mesh.corners(elements, nodes)).collect()}
    assert got == {1: 0.5, 2: pytest.approx(1 / 6), 3: 1.0, 4: 0.0}
    assert {r.id: r.valid for r in mesh.valid(elements).collect()} == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert [(r.id, r.node) for r in mesh.dangling(elements, nodes).collect()] == [(5, 9)]
    r = mesh.normal(mesh.corners(elements.where("id = 1"), nodes)).first()
    assert (r.nx, r.ny, r.nz) == (0, 0, 1)
    el, nd = mesh.refine(elements.where("id = 1"), nodes)
    assert el.count() == 4 and nd.count() == 7 and mesh.measure(mesh.corners(el, nd)).agg(F.sum("measure")).first()[0] == pytest.approx(0.5)
    nd, el = mesh.rectangle(spark, 10, 10)
    assert (nd.count(), el.count()) == (121, 100)
    hexa = spark.createDataFrame([(9, "hex", list(range(8)), 0)], elements.schema)
    box = spark.createDataFrame([(k, float(k & 1), 2.0 * (k >> 1 & 1), 3.0 * (k >> 2)) for k in range(8)], "id long, x double, y double, z double")
    assert mesh.measure(mesh.corners(hexa, box)).first().measure == 6.0


def test_adaptive_cells(spark):
    cells = spark.createDataFrame([(k, (k % 8 + 0.5) / 8, (k // 8 + 0.5) / 8, 1 / 8 - 1e-9, 1, 1.0 if k == 27 else 0.0) for k in range(64)], "id long, x double, y double, size double, level int, v double")
    marked = mesh.mark(mesh.gradient_error(cells))
    refined = {r.id for r in marked.where("mark = 'refine'").collect()}
    assert 27 in refined and refined <= {18, 19, 20, 26, 27, 28, 34, 35, 36}
    out = mesh.adapt(marked)
    area = out.agg(F.sum(F.col("size") * F.col("size"))).first()[0]
    assert area == pytest.approx(1.0, rel=1e-6)


def test_config(spark):
    base = config.to_rows(spark, {"solver.type": "magic", "solver.max_iterations": 0, "time.dt": 0.1})
    found = {(r.key, r.problem) for r in config.validate(base, config.schema_rows(spark, "solver", "mesh", "time")).collect()}
    assert found == {("solver.type", "rule"), ("solver.max_iterations", "rule"), ("mesh.filename", "missing")}
    assert config.validate(config.preset(spark, "accurate"), config.schema_rows(spark, "solver", "time")).count() == 0
    soft = {r.key: r.value for r in config.preset(spark, "fast", base).collect()}
    hard = {r.key: r.value for r in config.preset(spark, "fast", base, overwrite=True).collect()}
    assert soft["solver.type"] == "magic" and hard["solver.type"] == "explicit" and soft["time.cfl"] == "0.9"
    assert config.conflicts(spark.createDataFrame([(1, "u", True), (1, "u", True), (2, "u", True), (2, "u", False)], "tag int, field string, enabled boolean")).count() == 1
    assert config.document(config.schema_rows(spark, "mesh")).count() == 3


def test_defaults_of_many_configurations(spark):
    rows = spark.createDataFrame([(7, "time.cfl", "double", "0.9"), (8, "mine", "string", "x"), (8, "time.t_final", "double", None)], "cfg int, key string, type string, value string")
    found = {(r.cfg, r.key): r.value for r in config.defaults(rows, config.schema_rows(spark, "time"), ["cfg"]).collect()}
    assert found == {(7, "time.cfl"): "0.9", (7, "time.t_final"): "1.0", (7, "time.output_interval"): "10", (8, "mine"): "x", (8, "time.cfl"): "0.5", (8, "time.t_final"): None, (8, "time.output_interval"): "10"}


def test_partitions(spark):
    assert partition.process_grid(12) == (2, 2, 3) and partition.process_grid(22) == (2, 11, 1) and partition.cube_root_grid(8) == (2, 2, 2)
    rows = spark.range(23).select(partition.owner("id", 23, 4).alias("o")).groupBy("o").count().orderBy("o").collect()
    assert [r["count"] for r in rows] == [6, 6, 6, 5]


def test_network_and_sampling(spark):
    rows = spark.createDataFrame([(k, float(k), 1.0 if k == 7 else 0.0) for k in range(10)], "id long, x double, residual double")
    out = ml.predict(rows, ["x"], [(np.array([[2.0]]), np.array([1.0]))])
    assert {r.id: r.prediction for r in out.collect()}[3] == 7.0
    assert ml.predict(rows.limit(0), ["x"], [(np.array([[2.0]]), np.array([1.0]))]).count() == 0
    picked = ml.residual_sample(rows.withColumn("k", F.lit(1)), "k", "residual", 1).collect()
    assert [r.id for r in picked] == [7]


def test_reactor_and_plane(spark):
    from fieldlab.operators import coupled

    cells = spark.createDataFrame([(k, 1.0, 500.0 + k) for k in range(5)], "cell long, c double, T double")
    for splitting in ("sequential", "strang"):
        out = coupled.reactor(cells, "cell", "c", "T", 1e6, 6e4, -100.0, 10.0, 1e-3, 200, splitting).toPandas()
        start = 500.0 + out.cell
        assert ((out["T"] - start) - 10 * (1 - out.c)).abs().max() < 1e-9 and out.c.between(0, 1).all()
    plane = spark.createDataFrame([(0, i, j, 1.0 if (i, j) == (3, 3) else 0.0, 300.0, 0.0, 0.0) for i in range(7) for j in range(7)], "run int, i int, j int, c double, T double, ux double, uy double")
    stats = coupled.plane_stats(coupled.plane_step(plane, 0.1, 1.0, 1.0, 0.5, 0.1, 0.0, 0.0, 0.0), 1.0, 1.0).first()
    assert stats.total == pytest.approx(1.0) and stats.t_max == pytest.approx(300.0)


def test_interpolation(spark):
    from fieldlab.operators import coupled

    points = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 3.0)], "x double, y double, v double")
    grid = spark.createDataFrame([(0.0, 0.0), (0.5, 0.0), (5.0, 5.0)], "x double, y double")
    assert {(r.x, r.y): r.v for r in coupled.interpolate(points, grid, 1.5).collect()} == {(0.0, 0.0): 1.0, (0.5, 0.0): pytest.approx(2.0), (5.0, 5.0): None}


def test_strategies(spark):
    from fieldlab.operators import solve

    a, b = linalg.poisson_1d(spark, 6)
    good = solve.solve(a, b, solve.Options("cg", 1e-9, 20))
    assert good.converged and solve.Options("nope", -1, 0).problems()
    again = solve.retry(a, b, solve.Options("jacobi", 1e-9, 2), attempts=2)
    assert again.attempts == 2 and not again.converged
    seen = []
    state = solve.time_steps(spark.createDataFrame([(0.0,)], "v double"), lambda d, t, h: seen.append(h) or d.select((F.col("v") + h).alias("v")), 0.0, 1.0, 0.3)
    assert state.first().v == pytest.approx(1.0) and seen == pytest.approx([0.3, 0.3, 0.3, 0.1])
    scaler = solve.LossScaler(8.0, 2)
    assert [scaler.update(x) for x in (True, False, False)] == [4.0, 4.0, 8.0] and solve.choose_method(0.4) == "explicit"
    with pytest.raises(ValueError):
        solve.register("cg", linalg.jacobi)
