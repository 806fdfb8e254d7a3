"""Compressed rows, blocked products, Jacobians, reachability, attributes, own rules,
trajectories and initial conditions on small cases with known answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.functions import initial
from fieldlab.operators import attributes, config, iterate, linalg, trajectory
from fieldlab.operators import reactions as rx


def coo(spark, entries):
    return spark.createDataFrame(entries, "run int, i long, j long, v double")


# ---------------------------------------------------------------------- matrices


def test_csr_keeps_repeats_and_deals_a_hot_row(spark):
    rng = random.Random(1)
    entries = [(r, rng.choice([0, 0, 3, 900, 901]), rng.randrange(40), float(rng.randrange(3))) for r in (1, 2) for _ in range(200)]
    got, pointers = linalg.csr(coo(spark, entries), ["run"], block=8)
    for run in (1, 2):
        want = sorted((i, j, v) for r, i, j, v in entries if r == run)
        rows = sorted((r.pos, (r.i, r.j, r.v)) for r in got.where(f"run = {run}").collect())
        assert [p for p, _ in rows] == list(range(200)) and [e for _, e in rows] == want
        starts = {r.i: (r.start, r.stop) for r in pointers.where(f"run = {run}").collect()}
        assert all([e[0] for e in want[a:b]] == [i] * (b - a) for i, (a, b) in starts.items()) and sum(b - a for a, b in starts.values()) == 200
    assert linalg.csr(coo(spark, []), ["run"])[0].count() == 0


@pytest.mark.parametrize("size", [1, 4, 64])
def test_blocked_product(spark, size):
    rng = np.random.default_rng(2)
    entries = [(r, int(i), int(j), float(rng.integers(-2, 3))) for r in (1, 2) for i, j in rng.integers(0, 11, (45, 2))]
    a = coo(spark, entries)
    got = {(r.run, r.i, r.j): r.v for r in linalg.matmul_blocked(a, linalg.transpose(a), ["run"], size).collect()}
    want = {(r.run, r.i, r.j): r.v for r in linalg.matmul(a, linalg.transpose(a), ["run"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert linalg.matmul_blocked(a.drop("run"), a.drop("run"), None, size).columns == ["i", "j", "v"]
    assert linalg.matmul_blocked(a.where("run > 5"), a, ["run"], size).count() == 0


# ---------------------------------------------------------------------- networks


def mechanism(spark, conc):
    stoich = spark.createDataFrame([("f", "A", "R", 2.0), ("f", "B", "R", 1.0), ("f", "C", "P", 1.0), ("g", "C", "R", 1.0), ("g", "A", "P", 1.0), ("g", "D", "P", 2.0)], "rxn string, species string, side string, coeff double")
    reactions = spark.createDataFrame([("f", 3.0, 0.0, 0.0, 2.0, 0.0, 0.0, True), ("g", 5.0, 0.0, 0.0, 7.0, 0.0, 0.0, False)], "rxn string, a_f double, b_f double, e_f double, a_r double, b_r double, e_r double, reversible boolean")
    return stoich, reactions, spark.createDataFrame(sorted(conc.items()), "species string, conc double")


@pytest.mark.parametrize("conc", [{"A": 0.5, "B": 2.0, "C": 1.5, "D": 0.1}, {"A": 0.5, "B": 0.0, "C": 1.5}, {"A": 0.0, "B": 2.0, "C": 0.0, "D": 1.0}])
def test_jacobian(spark, conc):
    stoich, reactions, species = mechanism(spark, conc)
    got = {(r.species, r.wrt): r.value for r in rx.jacobian(stoich, reactions, species, 300.0, 1e-7).collect()}
    names = "ABCD"
    nu_r, nu_p = np.array([[2, 1, 0, 0], [0, 0, 1, 0]]), np.array([[0, 0, 1, 0], [1, 0, 0, 2]])
    f = iterate.mechanism_rhs(nu_r, nu_p, np.array([3.0, 5.0]), np.array([2.0, 0.0]))
    dense = iterate.jacobian(f, np.array([conc.get(n, 0.0) for n in names]), 1e-7)
    for a, one in enumerate(names):
        for b, other in enumerate(names):
            assert got.get((one, other), 0.0) == pytest.approx(dense[a, b], abs=2e-5)
    d = [abs(dense[k, k]) for k in range(4) if abs(dense[k, k]) > 1e-6]
    row = rx.stiffness(rx.jacobian(stoich, reactions, species, 300.0, 1e-7)).first()
    assert row.stiffness == pytest.approx(max(d) / min(d), rel=1e-3) and row.stiff == (max(d) / min(d) > 1000)


def test_stiffness_without_a_diagonal(spark):
    none = spark.createDataFrame([("A", "B", 3.0), ("B", "B", 0.0)], "species string, wrt string, value double")
    row = rx.stiffness(none).first()
    assert row.stiffness == 0 and not row.stiff


def test_reachable_from_many_sources(spark):
    rng = random.Random(4)
    edges = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(330)})
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    sources = list(range(0, 400, 2))
    want = {}
    for s in sources:
        hops, front = {s: 0}, [s]
        while front:
            front = [b for b in dict.fromkeys(b for a in front for b in out.get(a, [])) if b not in hops]
            hops |= dict.fromkeys(front, max(hops.values()) + 1)
        want |= {(s, d): h for d, h in hops.items()}
    graph = spark.createDataFrame(edges, "src long, dst long")
    asked = spark.createDataFrame([(s,) for s in sources + sources[:5]], "src long")
    assert {(r.src, r.dst): r.hops for r in rx.reachable(graph, asked).collect()} == want
    assert {(r.src, r.dst): r.hops for r in rx.reachable(graph, asked, depth=2).collect()} == {k: h for k, h in want.items() if h <= 2}
    named = graph.select(F.concat(F.lit("s"), "src").alias("src"), F.concat(F.lit("s"), "dst").alias("dst"))
    assert rx.reachable(named, named.where("src = 's0'").select("src")).count() == sum(s == 0 for s, _ in want) * (0 in out)


def test_unknown_references_and_one_sided_species(spark):
    stoich, _, species = mechanism(spark, {"A": 1.0, "C": 1.0})
    assert sorted((r.rxn, r.species, r.side) for r in rx.unknown_references(stoich, species).collect()) == [("f", "B", "R"), ("g", "D", "P")]
    assert {r.species for r in rx.pure(stoich, "R").collect()} == {"B"} and {r.species for r in rx.pure(stoich, "P").collect()} == {"D"}


# -------------------------------------------------------- attributes and settings


def test_attribute_maps(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "b": "x", "n": None}), (2, {}), (3, None)], "id int, m map<string,string>")
    get = rows.select("id", attributes.get("m", "a", 7).alias("a"), attributes.get("m", "b", 0.5).alias("b"), attributes.get("m", "n", "none").alias("n"), attributes.has("m", "n").alias("has")).collect()
    assert [tuple(r)[1:] for r in get] == [(1, 0.5, "none", True), (7, 0.5, "none", False), (7, 0.5, "none", False)]
    spelled = lambda c: [r[0] for r in rows.select(attributes.spell(c)).collect()]
    assert spelled(attributes.put("m", "a", 2)) == ["a=2;b=x;n=", "a=2", "a=2"]
    assert spelled(attributes.remove("m", "a", "n")) == ["b=x", "", ""]
    other = F.create_map(F.lit("b"), F.lit("y"))
    assert spelled(attributes.merge("m", other)) == ["a=1;b=y;n=", "b=y", "b=y"]
    log = spark.createDataFrame([(1, "a", "1", 1), (1, "a", "2", 5), (1, "b", "3", 2)], "id int, k string, v string, at int")
    assert attributes.collect(log, ["id"], "k", "v", "at").first().attributes == {"a": "2", "b": "3"}


def test_own_rules(spark):
    schema = config.schema_rows(spark, "time")
    values = config.to_rows(spark, {"time.dt": 0.5, "time.cfl": 2.0, "name": "run 1"})
    own = {"time.dt": lambda v: v.try_cast("double") < 0.1, "time.cfl": lambda v: v.try_cast("double") > 0, "name": lambda v: ~v.contains(" "), "absent": lambda v: F.lit(False)}
    assert {(r.key, r.problem) for r in config.validate(values, schema, predicates=own).collect()} == {("time.dt", "custom"), ("time.cfl", "rule"), ("name", "custom")}
    assert {r.key for r in config.validate(values, schema).collect()} == {"time.cfl"}
    assert len(config.PRESETS) == 8 and config.preset(spark, "transport").where("key = 'output.save_fluxes' and value = 'true'").count() == 1


# ------------------------------------------------- trajectories, initial conditions


def decay(t, y, p):
    return -p * y


def test_trajectories(spark):
    cells = spark.createDataFrame([(1, [1.0, 2.0], [0.5, 3.0]), (2, [0.0, 1.0], [1.0, 1.0])], "cell int, y array<double>, p array<double>")
    table = trajectory.steps(decay, clamp=False)
    rows = cells.lateralJoin(table(F.col("y").outer(), F.col("p").outer(), F.lit(1.0), F.lit(0.3))).orderBy("cell", "step").collect()
    for cell in (1, 2):
        mine = [r for r in rows if r.cell == cell]
        assert [round(r.t, 9) for r in mine] == [0, 0.3, 0.6, 0.9, 1.0] and mine[-1].h == pytest.approx(0.1)
        want = iterate.integrate(lambda t, y, p=np.array(mine[0].p): -p * y, np.array(mine[0].y), 0.0, 1.0, 0.3)
        assert mine[-1].state == pytest.approx(want[-1][1].tolist())
    saved = cells.lateralJoin(trajectory.steps(decay, save_every=0.5)(F.col("y").outer(), F.col("p").outer(), F.lit(1.2), F.lit(0.1))).where("cell = 1").orderBy("step").collect()
    assert [round(r.t, 9) for r in saved] == [0, 0.5, 1.0, 1.2]


@pytest.mark.parametrize("kind", ["elementary", "pi", "pid"])
def test_controlled_trajectories(spark, kind):
    cells = spark.createDataFrame([(1, [1.0], [40.0])], "cell int, y array<double>, p array<double>")
    rows = cells.lateralJoin(trajectory.controlled(decay, kind)(F.col("y").outer(), F.col("p").outer(), F.lit(0.5), F.lit(0.5))).orderBy("attempt").collect()
    assert not rows[0].accepted and rows[0].t == 0 and rows[0].state == [1.0]
    assert rows[-1].accepted and rows[-1].t == pytest.approx(0.5) and rows[-1].state[0] == pytest.approx(np.exp(-20), abs=1e-4)
    good = [r for r in rows if r.accepted]
    assert all(r.error <= 1 for r in good) and sum(r.h for r in good) == pytest.approx(0.5)
    one = [r for r in good if r.t <= 0.05][-1]
    assert one.state[0] == pytest.approx(np.exp(-40 * one.t), rel=2e-2)


def test_initial_conditions(spark):
    grid = spark.range(12).select((F.col("id") % 4).alias("i"), F.floor(F.col("id") / 4).alias("j"))
    made = {"g": initial.gaussian(1, 1, 0.5, 3), "s": initial.step(1.5, 0, 9), "q": initial.square(1, 3, 5, 0), "n": initial.noise(initial.step(0, 0, 1), 0.1, 3), "own": lambda x, y: x - y}
    rows = {(r.i, r.j): r for r in initial.apply(grid, made).collect()}
    assert rows[(1, 1)].g == 3 and rows[(2, 1)].g == pytest.approx(3 * np.exp(-2)) and (rows[(1, 0)].s, rows[(2, 0)].s) == (0, 9)
    assert {k for k, r in rows.items() if r.q == 5} == {(1, 1), (1, 2), (2, 1), (2, 2)} and rows[(3, 1)].own == 2
    noise = [r.n for r in rows.values()]
    assert all(0.9 <= x < 1.1 for x in noise) and len(set(noise)) > 8
    assert noise == [r.n for r in initial.apply(grid, made).collect()]
    assert initial.apply(grid.drop("j"), {"u": initial.sine(1, 1)}, (0.5, 1.0)).where("u <> 0").count() == 0
