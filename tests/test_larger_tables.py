"""Faults that showed on larger tables or odd rows."""

import re
import time
from datetime import datetime, timedelta
from pathlib import Path

import duckdb

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab import plans
from fieldlab.operators import linalg, mesh, patterns, reactions, trajectory
from fieldlab.plans import bindings, planes
from fieldlab.session import parts
from fieldlab.sources import files


def test_stream_controller_with_errors_of_zero_equals_its_sql(spark, tmp_path):
    values = [0.0, 60.0, 90.0, 0.0, 0.0, 200.0, 75.0, 120.0]
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=k), k % 2, "view", v) for k, v in enumerate(values * 2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = plans.QUERIES["stream_controller"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.event_id, r.accepted, r.dt) for r in got) == sorted(con.sql(plans.ORACLES["stream_controller"]).fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_broadcast(spark):
    cells = spark.range(400).selectExpr("id", "(id % 20 + 0.5D) / 20 as x", "(id div 20 + 0.5D) / 20 as y", "1 / 20D as size", "cast(id % 3 as int) as level", "cast(id * id % 7 as double) as v")
    errors = mesh.gradient_error(cells)
    assert "BroadcastHashJoin" not in plan(errors)
    rows = [r.asDict() for r in cells.collect()]
    for r in errors.collect():
        near = [(abs(r.v - o["v"]) / d) for o in rows if 0 < (d := ((r.x - o["x"]) ** 2 + (r.y - o["y"]) ** 2) ** 0.5) < 2 * r["size"]]
        assert abs(r.error - max(near)) < 1e-9


def rhs(t, y, p):
    return np.array([y[1], -p[0] * y[0]]) if len(y) == 2 else -p * y + 0 * t


def test_batches_of_cells_give_the_rows_of_single_cells(spark):
    cells = spark.createDataFrame([(k, [1.0 + k / 9, 0.5] if k % 3 else [2.0 + k], [float(k % 7)]) for k in range(60)], "cell long, y array<double>, p array<double>").coalesce(1)
    given = F.col("y").outer(), F.col("p").outer(), F.lit(1.2), F.lit(0.5)
    single = lambda f: cells.lateralJoin(f(*given)).drop("y", "p")
    both = [(single(trajectory.steps(rhs, save_every=m, clamp=False)), trajectory.stepped(cells, "y", "p", rhs, 1.2, 0.5, save_every=m, clamp=False), "step") for m in (None, 0.7)]
    both += [(single(trajectory.controlled(rhs, kind)), trajectory.adapted(cells, "y", "p", rhs, 1.2, 0.5, kind), "attempt") for kind in ("pi", "pid", "elementary")]
    for a, b, n in both:
        a, b = a.orderBy("cell", n).collect(), b.orderBy("cell", n).collect()
        assert len(a) == len(b) > 60 and set(a[0].asDict()) == set(b[0].asDict())
        for x, y in zip(a, b, strict=True):
            for c in x.asDict():
                assert y[c] == pytest.approx(x[c], rel=1e-9, abs=1e-12)


def test_trajectories_of_one_small_file_are_dealt_to_all_cores(spark):
    used = trajectory.stepped(spark.createDataFrame([(k, [1.0], [1.0]) for k in range(400)], "cell long, y array<double>, p array<double>").coalesce(1), "y", "p", rhs, 1.0, 0.5)
    assert used.groupBy(F.spark_partition_id()).count().count() == 4


def test_closure_joins_nodes_that_reach_each_other(spark, monkeypatch):
    monkeypatch.setattr(reactions, "GROUP_CHUNK", 2)
    ring = [(k, (k + 1) % 5) for k in range(5)]
    pairs = [*ring, (3, 100), (100, 101), (101, 102), (102, 101), (200, 3), (300, 301), (4, 4)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    sources = spark.createDataFrame([(0,), (2,), (100,), (102,), (200,), (301,), (999,)], "src long")
    groups = {r.node: r.comp for r in reactions.strong_groups(edges, hops=8).collect()}
    assert {groups[k] for k in range(5)} == {0} and groups[101] == groups[102] == 101
    assert [groups[k] for k in (100, 200, 300, 301)] == [100, 200, 300, 301]
    expected = {(r.src, r.dst) for r in reactions.reachable(edges, sources).collect()}
    got = [(r.src, r.dst) for r in reactions.closure(edges, sources).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and (999, 999) in expected


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_closure_leaves_nothing_on_disk_but_what_its_pairs_read(spark):
    edges = spark.range(4000).selectExpr("id * 7919 % 300 as src", "id * id % 311 as dst")
    sources = spark.range(0, 300, 10).selectExpr("id as src")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    states = lambda: {p.name for p in Path(shared, "fieldlab").glob("state-*")}
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    had, files, conf = states(), shuffled(), spark.conf.get(FREE)
    pairs = reactions.closure(edges, sources)
    assert states() - had == {Path(f).parent.name for f in pairs.inputFiles()}
    ends = time.monotonic() + 20
    while shuffled() - files and time.monotonic() < ends:
        time.sleep(0.2)
    assert not shuffled() - files and spark.conf.get(FREE) == conf
    assert {(r.src, r.dst) for r in pairs.collect()} == {(r.src, r.dst) for r in reactions.reachable(edges, sources).collect()}


def test_a_hop_deletes_what_the_last_one_wrote(spark):
    line = spark.range(12).selectExpr("id as src", "id + 1 as dst")
    states = lambda: {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), "fieldlab").glob("state-*")}
    had = states()
    pairs = reactions.closure(line, spark.createDataFrame([(0,), (7,)], "src long"))
    assert len(states() - had) == 4
    assert sorted((r.src, r.dst) for r in pairs.collect()) == [(0, k) for k in range(13)] + [(7, k) for k in range(7, 13)]


def test_csv_parts_follow_the_data_and_stay_in_order(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        files.write_csv(spark.range(900, 0, -1).selectExpr("id", "id / 3D as v"), f"{tmp_path}/out", ["id"], parts=None)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    parts = sorted(tmp_path.glob("out/part-*"))
    ids = [int(x.split(",")[0]) for p in parts for x in p.read_text().splitlines()[1:]]
    assert len(parts) == 9 and ids == list(range(1, 901))


def test_products_of_a_solver_leave_the_matrix_where_it_lies(spark):
    matrix = spark.range(3000).selectExpr("id % 300 as i", "id * id % 301 as j", "id % 5 + 0.5D as v").groupBy("i", "j").agg(F.sum("v").alias("v"))
    x = spark.range(290).selectExpr("id as i", "id % 7 - 2D as x")
    before = spark.conf.get(linalg.PART_OF_KEYS)
    with linalg.Standing(matrix, 300) as a:
        rows = a.keep(x)
        y = rows.join(a.times(rows), "i", "left")
        assert plan(y).count("Bucketed: true") == 3 and "BroadcastHashJoin" not in plan(a.times(rows))
        got = {r.i: r.y for r in y.collect()}
    assert spark.conf.get(linalg.PART_OF_KEYS) == before and not [t for t in spark.catalog.listTables() if t.name.startswith("standing")]
    want = {r.i: r.y for r in linalg.spmv(matrix, x).collect()}
    assert all(got[i] == pytest.approx(want.get(i)) for i in range(290))


def test_jacobi_stops_at_its_tolerance_and_takes_odd_rows(spark):
    rng = np.random.default_rng(3)
    full = rng.random((12, 12)) + 13 * np.eye(12)
    matrix = spark.createDataFrame([(i, j, float(full[i, j])) for i in range(12) for j in range(12)], "i long, j long, v double")
    b = spark.createDataFrame([(i, float(i)) for i in range(13)], "i long, x double")  # row 12 has no entries
    solved = {r.i: r.x for r in linalg.jacobi(matrix, b.where("i < 12"), 200, 1e-9).collect()}
    np.testing.assert_allclose([solved[i] for i in range(12)], np.linalg.solve(full, np.arange(12.0)), atol=1e-9)
    assert {r.i for r in linalg.jacobi(matrix, b, 2).collect()} == set(range(12))
    assert {r.i: r.x for r in linalg.jacobi(matrix, b, 0).collect()} == {i: 0.0 for i in range(13)}


def test_products_are_dealt_by_the_size_of_the_data(spark):
    assert [parts(spark, k) for k in (0, 10_000_000)] == [4, 40]
    a = spark.range(500).selectExpr("id % 3 as run", "id % 20 as i", "id * 7 % 19 as j", "id % 5 + 0.5D as v").groupBy("run", "i", "j").agg(F.sum("v").alias("v"))
    product = linalg.matmul(a, a, ["run"], 7)
    assert "(run#" in plan(product) and re.search(r"hashpartitioning\(run#\d+L, i#\d+L, j#\d+L, 7\), REPARTITION_BY_NUM", plan(product))
    rows = lambda df: sorted((r.run, r.i, r.j, round(r.v, 9)) for r in df.collect())
    assert rows(product) == rows(linalg.matmul(a, a, ["run"]))


def test_jacobian_is_dealt_by_the_size_of_the_data(spark):
    stoich = spark.range(90).selectExpr("id div 4 as rxn", "id * 7 % 11 as species", "if(id % 3 = 0, 'R', 'P') as side", "1.0D + id % 2 as coeff")
    given = spark.range(23).selectExpr("id as rxn", "2D as a_f", "0D as b_f", "0D as e_f", "1D as a_r", "0D as b_r", "0D as e_r", "id % 2 = 0 as reversible"), spark.range(10).selectExpr("id as species", "id / 4D as conc"), 300.0
    dealt = reactions.jacobian(stoich, *given, n=7)
    assert set(re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan(dealt))) == {"7"}
    rows = lambda df: {(r.species, r.wrt): r.value for r in df.collect()}
    a, b = rows(dealt), rows(reactions.jacobian(stoich, *given))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_metrics_of_a_field_stay_on_the_partitions_of_its_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bindings, "parts", lambda *_: 9)
    spark.range(60).selectExpr("id % 4 as l_suppkey", "id as l_orderkey", "cast(1 as int) as l_linenumber", "id as l_partkey", "id * 7 % 5 + 0D as l_quantity", "1D as l_extendedprice", "timestamp'2024-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = patterns.analyze(bindings.field(spark, str(tmp_path)).select("run", "i", "v"))
    assert set(re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan(got))) == {"9"} and got.count() == 4


def test_training_points_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(planes.pinn, "train", lambda points, *_, **how: (seen.append(points), (planes.pinn.start(how["hidden"], 0.1), []))[1])
    spark.range(400).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    planes.network_training(spark, str(tmp_path))
    files = seen[0].select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) == 4 and {r["count"] for r in files} == {300}
