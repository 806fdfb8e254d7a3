"""Queries on matrices, meshes, configurations and partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import config as cf
from ..operators import iterate, linalg, mesh, ml, partition
from ..session import parts, table
from .bindings import ELEMENTS, FIELD, GRID2, MATRIX, NODES, elements, field, grid2, matrix, nodes
from .registry import query, rounded

VEC = "vec AS (SELECT DISTINCT run, j AS i, (j * 7 % 13) / 13.0 AS x FROM matrix)"


def _vector(m: DataFrame) -> DataFrame:
    return m.select("run", F.col("j").alias("i")).distinct().withColumn("x", F.col("i") * 7 % 13 / 13.0)


@query(f"WITH {MATRIX}, {VEC} SELECT m.run, m.i, round(sum(v * x), 8) AS y FROM matrix m JOIN vec ON m.run = vec.run AND m.j = vec.i GROUP BY 1, 2")
def sparse_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13."""
    m = matrix(spark, sf_dir)
    return rounded(linalg.spmv(m, _vector(m), ["run"]), 8)


@query(f"WITH {MATRIX}, {VEC}, y AS (SELECT m.run, m.i, sum(v * x) AS y FROM matrix m JOIN vec ON m.run = vec.run AND m.j = vec.i GROUP BY 1, 2) SELECT coalesce(vec.run, y.run) AS run, round(sqrt(sum((coalesce(x, 0) - coalesce(y, 0)) ** 2)), 6) AS residual FROM vec FULL JOIN y ON vec.run = y.run AND vec.i = y.i GROUP BY 1")
def linear_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    m = matrix(spark, sf_dir)
    x = _vector(m)
    return rounded(linalg.residual(m, x, x, ["run"]))


@query(f"WITH {MATRIX} SELECT coalesce(a.run, b.run) AS run, round(max(abs(coalesce(a.v, 0) - coalesce(b.v, 0))), 8) AS worst FROM matrix a FULL JOIN matrix b ON a.run = b.run AND a.i = b.j AND a.j = b.i GROUP BY 1")
def matrix_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    return rounded(linalg.asymmetry(matrix(spark, sf_dir), ["run"]), 8)


@query(f"WITH {MATRIX} SELECT run, j AS i, i AS j, round(v, 8) AS v FROM matrix")
def matrix_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of rows is the reader's."""
    return rounded(linalg.transpose(matrix(spark, sf_dir)).select("run", "i", "j", "v"), 8)


@query(f"WITH {MATRIX} SELECT a.run, a.i, b.j, round(sum(a.v * b.v), 8) AS v FROM matrix a JOIN matrix b ON a.run = b.run AND a.j = b.i GROUP BY 1, 2, 3")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6."""
    m = matrix(spark, sf_dir)
    return rounded(linalg.matmul(m, m, ["run"], parts(spark, table(spark, sf_dir, "lineitem").count())), 8)


@query(f"WITH {MATRIX} SELECT a.run, a.i, b.j, round(sum(a.v * b.v), 8) AS v FROM matrix a JOIN matrix b ON a.run = b.run AND a.j = b.i GROUP BY 1, 2, 3")
def matrix_product_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6 by dense blocks of 25 squared."""
    m = matrix(spark, sf_dir)
    return rounded(linalg.matmul_blocked(m, m, ["run"], 25), 8)


SYSTEM = """big AS (SELECT max(p_partkey) AS n FROM part),
off AS (SELECT l_partkey AS i, (l_partkey * 7 + l_suppkey) % n + 1 AS j, sum(l_discount) AS v FROM lineitem, big WHERE (l_partkey * 7 + l_suppkey) % n + 1 <> l_partkey GROUP BY 1, 2),
dia AS (SELECT p_partkey AS i, 1 + p_size / 10.0 + coalesce(sum(v), 0) AS d FROM part LEFT JOIN off ON i = p_partkey GROUP BY p_partkey, p_size),
rhs AS (SELECT p_partkey AS i, p_retailprice / 1000 AS b FROM part)"""


def _system(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One sparse system over all parts, diagonally dominant and not symmetric, and a right
    side."""
    part = table(spark, sf_dir, "part")
    big = part.agg(F.max("p_partkey").alias("n"))
    lines = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(big))  # one row
    off = lines.select(F.col("l_partkey").alias("i"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("n") + 1).alias("j"), F.col("l_discount").alias("v")).where("i <> j").groupBy("i", "j").agg(F.sum("v").alias("v"))
    sums = off.groupBy("i").agg(F.sum("v").alias("s"))
    diagonal = part.select(F.col("p_partkey").alias("i"), (1 + F.col("p_size") / 10.0).alias("d")).join(sums, "i", "left").select("i", F.col("i").alias("j"), (F.col("d") + F.coalesce("s", F.lit(0.0))).alias("v"))
    return iterate.keep(off.unionByName(diagonal)), part.select(F.col("p_partkey").alias("i"), (F.col("p_retailprice") / 1000).alias("x"))


def _sweep(source: str) -> str:
    return f"SELECT r.i, (b - coalesce(y, 0)) / d AS x FROM rhs r JOIN dia USING (i) LEFT JOIN (SELECT off.i, sum(v * x) AS y FROM off JOIN {source} s ON off.j = s.i GROUP BY off.i) p USING (i)"


@query(f"WITH {SYSTEM}, x0 AS (SELECT i, 0.0::DOUBLE AS x FROM rhs), x1 AS ({_sweep('x0')}), x2 AS ({_sweep('x1')}), x3 AS ({_sweep('x2')}) SELECT i, round(x, 9) AS x FROM x3")
def jacobi_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three Jacobi sweeps on one system over all parts."""
    a, b = _system(spark, sf_dir)
    return rounded(linalg.jacobi(a, b, 3), 9)


@query("SELECT p_partkey AS i, (p_partkey * 5 % 17) / 8.0 AS x FROM part")
def bicgstab_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A general system over all parts whose right side comes from a known solution."""
    a, b = _system(spark, sf_dir)
    known = b.select("i", (F.col("i") * 5 % 17 / 8.0).alias("x"))
    side = iterate.keep(known.select("i").join(linalg.spmv(a, known).withColumnRenamed("y", "x"), "i"))
    return rounded(linalg.bicgstab(a, side, 40, 1e-11), 6)


ENTRIES = "entries AS (SELECT l_suppkey AS run, l_orderkey % 50 AS i, l_partkey % 50 AS j, l_discount AS v FROM lineitem), placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY i, j, v) - 1 AS pos FROM entries)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices' entries before repeated ones are summed."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_orderkey") % 50).alias("i"), (F.col("l_partkey") % 50).alias("j"), F.col("l_discount").alias("v"))


@query(f"WITH {ENTRIES} SELECT run, pos, i, j, v FROM placed")
def csr_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in row and column order, repeated ones kept."""
    return linalg.csr(_entries(spark, sf_dir), ["run"], 16)[0]


@query(f"WITH {ENTRIES} SELECT run, i, min(pos) AS start, max(pos) + 1 AS stop FROM placed GROUP BY 1, 2")
def csr_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row's entries begin and end."""
    return linalg.csr(_entries(spark, sf_dir), ["run"], 16)[1]


@query(f"WITH {MATRIX} SELECT run, count(DISTINCT i) = 50 AND min(i) >= 0 AND max(i) < 50 AND min(j) >= 0 AND max(j) < 50 AS posed FROM matrix GROUP BY run")
def matrix_well_posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3."""
    return linalg.well_posed(matrix(spark, sf_dir), 50, ["run"])


@query("SELECT i, j, CASE WHEN i = j THEN 2.0 ELSE -1.0 END * 441 AS v FROM range(20) a(i), range(20) b(j) WHERE abs(i - j) <= 1")
def poisson_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I22."""
    rows, _ = linalg.poisson_1d(spark, 20)
    return rows.select("i", "j", F.round("v", 6).alias("v"))


@query("SELECT i, round((i + 1) / 21.0 * (1 - (i + 1) / 21.0) / 2, 8) AS x FROM range(20) a(i)")
def poisson_conjugate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second-difference system's exact solution is a parabola."""
    a, b = linalg.poisson_1d(spark, 20)
    return rounded(linalg.conjugate_gradient(a, b, 25, 1e-13), 8)


@query(f"WITH {ELEMENTS} SELECT id, type, CAST(CASE type WHEN 'line' THEN 1 WHEN 'tet' THEN 3 ELSE 2 END AS INT) AS dimension, CAST(CASE type WHEN 'line' THEN 3 WHEN 'triangle' THEN 5 WHEN 'quad' THEN 9 ELSE 10 END AS INT) AS vtk, CAST(CASE type WHEN 'line' THEN 1 WHEN 'triangle' THEN 2 WHEN 'quad' THEN 3 ELSE 4 END AS INT) AS gmsh, true AS valid FROM elements")
def element_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MS9, IO3, IO21, M61."""
    k = F.col("type")
    return mesh.valid(elements(spark, sf_dir)).select("id", "type", mesh.dimension(k).alias("dimension"), mesh.vtk_code(k).alias("vtk"), mesh.gmsh_code(k).alias("gmsh"), "valid")


CORNERS = f"{NODES}, {ELEMENTS}, ex AS (SELECT id, type, unnest(node_ids) AS node, generate_subscripts(node_ids, 1) AS pos FROM elements), co AS (SELECT e.id, e.type, " + ", ".join(f"max(n.{a}) FILTER (pos = {k + 1}) AS {a}{k}" for k in range(4) for a in "xyz") + ", count(*) AS found FROM ex e JOIN nodes n ON e.node = n.id GROUP BY e.id, e.type), c AS (SELECT co.* FROM co JOIN elements e ON co.id = e.id WHERE found = len(node_ids))"


def _area(a, b, c):
    return f"0.5 * sqrt(((y{b} - y{a}) * (z{c} - z{a}) - (z{b} - z{a}) * (y{c} - y{a})) ** 2 + ((z{b} - z{a}) * (x{c} - x{a}) - (x{b} - x{a}) * (z{c} - z{a})) ** 2 + ((x{b} - x{a}) * (y{c} - y{a}) - (y{b} - y{a}) * (x{c} - x{a})) ** 2)"


def _dist(a, b):
    return f"sqrt((x{b} - x{a}) ** 2 + (y{b} - y{a}) ** 2 + (z{b} - z{a}) ** 2)"


DET = "((x1 - x0) * ((y2 - y0) * (z3 - z0) - (z2 - z0) * (y3 - y0)) + (y1 - y0) * ((z2 - z0) * (x3 - x0) - (x2 - x0) * (z3 - z0)) + (z1 - z0) * ((x2 - x0) * (y3 - y0) - (y2 - y0) * (x3 - x0)))"
MEASURE = f"CASE type WHEN 'line' THEN {_dist(0, 1)} WHEN 'triangle' THEN {_area(0, 1, 2)} WHEN 'quad' THEN {_area(0, 1, 2)} + {_area(0, 2, 3)} ELSE abs({DET}) / 6 END"


@query(f"WITH {CORNERS} SELECT id, type, round({MEASURE}, 11) AS measure, round(CASE type WHEN 'line' THEN (x0 + x1) / 2 WHEN 'triangle' THEN (x0 + x1 + x2) / 3 ELSE (x0 + x1 + x2 + x3) / 4 END, 11) AS cx FROM c")
def element_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, MS2, MS3, MS4."""
    rows = mesh.centroid(mesh.measure(mesh.corners(elements(spark, sf_dir), nodes(spark, sf_dir))))
    return rounded(rows.select("id", "type", "measure", "cx"), 11)


def _angle(p, q, o):
    return f"(acos(least(greatest(({p} * {p} + {q} * {q} - {o} * {o}) / (2 * {p} * {q}), -1), 1)) * 180 / pi())"


TRI = f"t AS (SELECT *, {_dist(0, 1)} AS l1, {_dist(1, 2)} AS l2, {_dist(2, 0)} AS l3 FROM c WHERE type = 'triangle'), a AS (SELECT *, {_angle('l1', 'l3', 'l2')} AS a1, {_angle('l1', 'l2', 'l3')} AS a2, {_angle('l2', 'l3', 'l1')} AS a3, (l1 + l2 + l3) / 2 AS s FROM t), q AS (SELECT id, greatest(l1, l2, l3) / least(l1, l2, l3) AS aspect, sqrt(greatest(0, s * (s - l1) * (s - l2) * (s - l3))) AS volume, greatest(abs(a1 - 60), abs(a2 - 60), abs(a3 - 60)) / 60 AS skewness, least(a1, a2, a3) AS min_angle, greatest(a1, a2, a3) AS max_angle FROM a)"


@query(f"WITH {CORNERS}, {TRI} SELECT id, round(aspect, 6) AS aspect, round(volume, 6) AS volume, round(skewness, 6) AS skewness, round(min_angle, 6) AS min_angle, round(max_angle, 6) AS max_angle FROM q")
def triangle_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MS5 for triangles."""
    rows = mesh.quality(mesh.corners(elements(spark, sf_dir).where("type = 'triangle'"), nodes(spark, sf_dir)))
    return rounded(rows.select("id", "aspect", "volume", "skewness", "min_angle", "max_angle"))


EDGE6 = [_dist(a, b) for a, b in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))]


@query(f"WITH {CORNERS}, t AS (SELECT id, greatest({', '.join(EDGE6)}) / least({', '.join(EDGE6)}) AS aspect, abs({DET}) / 6 AS volume, (({' + '.join(EDGE6)}) / 6) ** 3 / (6 * sqrt(2)) AS ideal FROM c WHERE type = 'tet') SELECT id, round(aspect, 6) AS aspect, round(volume, 6) AS volume, round(abs(volume - ideal) / ideal, 6) AS skewness FROM t")
def tetrahedron_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MS5 for tetrahedra."""
    rows = mesh.quality(mesh.corners(elements(spark, sf_dir).where("type = 'tet'"), nodes(spark, sf_dir)))
    return rounded(rows.select("id", "aspect", "volume", "skewness"))


@query(f"WITH {CORNERS}, {TRI}, r AS (SELECT count(*) FILTER (volume < 1e-12) AS degenerate, count(*) FILTER (volume >= 1e-12) AS n, min(aspect) AS min_aspect, max(aspect) AS max_aspect, avg(aspect) AS avg_aspect, min(skewness) AS min_skewness, max(skewness) AS max_skewness, avg(skewness) AS avg_skewness, min(min_angle) AS min_angle, max(max_angle) AS max_angle FROM q) SELECT degenerate, n, round(min_aspect, 6) AS min_aspect, round(max_aspect, 6) AS max_aspect, round(avg_aspect, 6) AS avg_aspect, round(min_skewness, 6) AS min_skewness, round(max_skewness, 6) AS max_skewness, round(avg_skewness, 6) AS avg_skewness, round(min_angle, 6) AS min_angle, round(max_angle, 6) AS max_angle, round((greatest(0, 100 - (avg_aspect - 1) * 20) + greatest(0, 100 - avg_skewness * 100) + CASE WHEN min_angle > 20 AND max_angle < 140 THEN 100 ELSE 50 END) / 3, 6) AS score FROM r")
def mesh_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 over the triangles."""
    rows = mesh.quality(mesh.corners(elements(spark, sf_dir).where("type = 'triangle'"), nodes(spark, sf_dir)))
    return rounded(mesh.quality_report(rows))


@query(f"WITH {CORNERS}, {TRI} SELECT count(*) FILTER (skewness > 0.6) AS n, count(*) AS total FROM q")
def refine_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    rows = mesh.quality(mesh.corners(elements(spark, sf_dir).where("type = 'triangle'"), nodes(spark, sf_dir)))
    return rows.agg(F.count_if(F.col("skewness") > 0.6).alias("n"), F.count("*").alias("total"))


@query(f"WITH {CORNERS}, m AS (SELECT type, {MEASURE} AS m FROM c) SELECT count(*) AS n, count(*) FILTER (type = 'line') AS n_line, count(*) FILTER (type = 'triangle') AS n_triangle, count(*) FILTER (type = 'quad') AS n_quad, count(*) FILTER (type = 'tet') AS n_tet, round(min(m) FILTER (m > 0), 8) AS min_measure, round(max(m) FILTER (m > 0), 8) AS max_measure, round(avg(m) FILTER (m > 0), 8) AS avg_measure FROM m")
def mesh_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    out = mesh.statistics(mesh.measure(mesh.corners(elements(spark, sf_dir), nodes(spark, sf_dir))))
    return rounded(out.select("n", "n_line", "n_triangle", "n_quad", "n_tet", "min_measure", "max_measure", "avg_measure"), 8)


@query(f"WITH {NODES} SELECT " + ", ".join(f"round(min({a}), 8) AS min_{a}, round(max({a}), 8) AS max_{a}, round(avg({a}), 8) AS mean_{a}" for a in "xyz") + " FROM nodes")
def mesh_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return rounded(mesh.bounding_box(nodes(spark, sf_dir)), 8)


@query(f"WITH {ELEMENTS}, ex AS (SELECT id, unnest(node_ids) AS node FROM elements) SELECT DISTINCT a.node, b.node AS other FROM ex a JOIN ex b ON a.id = b.id WHERE a.node <> b.node")
def node_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    return mesh.neighbours(elements(spark, sf_dir))


@query(f"WITH {NODES}, {ELEMENTS}, ex AS (SELECT id, unnest(node_ids) AS node FROM elements), nb AS (SELECT DISTINCT a.node, b.node AS other FROM ex a JOIN ex b ON a.id = b.id WHERE a.node <> b.node), m AS (SELECT node AS id, avg(x) AS mx, avg(y) AS my FROM nb JOIN nodes n ON nb.other = n.id GROUP BY node) SELECT n.id, round(x + 0.5 * (coalesce(mx, x) - x), 11) AS x, round(y + 0.5 * (coalesce(my, y) - y), 11) AS y FROM nodes n LEFT JOIN m ON n.id = m.id")
def laplacian_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MS8, written back."""
    return rounded(mesh.smooth(elements(spark, sf_dir), nodes(spark, sf_dir)).select("id", "x", "y"), 11)


@query(f"""WITH {CORNERS}, t AS (SELECT * FROM elements WHERE type = 'triangle'), e AS (SELECT DISTINCT least(node_ids[k], node_ids[k % 3 + 1]) AS a, greatest(node_ids[k], node_ids[k % 3 + 1]) AS b FROM t, range(1, 4) r(k))
SELECT (SELECT 4 * count(*) FROM t) AS n_elements, (SELECT count(*) FROM nodes) + (SELECT count(*) FROM e) AS n_nodes, (SELECT round(sum({MEASURE}), 6) FROM c WHERE type = 'triangle') AS area""")
def uniform_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MS7: four children a triangle, one midpoint an edge, the area kept."""
    el, nd = mesh.refine(elements(spark, sf_dir), nodes(spark, sf_dir))
    area = mesh.measure(mesh.corners(el, nd)).agg(F.count("*").alias("n_elements"), F.round(F.sum("measure"), 6).alias("area"))
    return area.crossJoin(nd.agg(F.count("*").alias("n_nodes"))).select("n_elements", "n_nodes", "area")


@query("SELECT (SELECT count(*) FROM range(11 * 11)) AS n_nodes, (SELECT count(*) FROM range(100)) AS n_elements, 2.0 AS area")
def rectangle_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MS1."""
    nd, el = mesh.rectangle(spark, 10, 10, 2.0, 1.0)
    return mesh.measure(mesh.corners(el, nd)).agg(F.count("*").alias("n_elements"), F.round(F.sum("measure"), 9).alias("area")).crossJoin(nd.agg(F.count("*").alias("n_nodes"))).select("n_nodes", "n_elements", "area")


PARTS = f"{ELEMENTS}, parts AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY id) - 1) / ceil((SELECT count(*) FROM elements) / 8.0)) AS INT) AS part FROM elements)"


@query(f"WITH {PARTS} SELECT id, part FROM parts")
def mesh_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MS10."""
    rows = elements(spark, sf_dir)
    return mesh.decompose(rows, 8, rows.count()).select("id", "part")


@query(f"WITH {PARTS}, n AS (SELECT DISTINCT part, unnest(node_ids) AS node FROM parts) SELECT a.part AS a, b.part AS b, count(*) AS shared FROM n a JOIN n b ON a.node = b.node WHERE a.part < b.part GROUP BY 1, 2")
def subdomain_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, S1, S2."""
    rows = elements(spark, sf_dir)
    return mesh.overlaps(mesh.decompose(rows, 8, rows.count()))


@query(f"WITH {ELEMENTS} SELECT id, type FROM elements WHERE type = 'triangle' AND tag = 3")
def elements_by_type_and_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    return elements(spark, sf_dir).where("type = 'triangle' and tag = 3").select("id", "type")


CELLS = "cells AS (SELECT p_partkey AS id, (p_partkey % 40 + 0.5) / 40 AS x, (p_partkey // 40 + 0.5) / 40 AS y, 1 / 40.0 AS size, CAST(p_partkey % 3 AS INT) AS level, p_retailprice / 1000 AS v FROM part)"
ERR = "err AS (SELECT c.id, c.level, coalesce(max(abs(c.v - o.v) / sqrt((c.x - o.x) ** 2 + (c.y - o.y) ** 2)), 0) AS error FROM cells c LEFT JOIN cells o ON o.id <> c.id AND abs(c.x - o.x) <= 2 * c.size AND abs(c.y - o.y) <= 2 * c.size AND sqrt((c.x - o.x) ** 2 + (c.y - o.y) ** 2) < 2 * c.size - 1e-9 GROUP BY c.id, c.level)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), ((k % 40 + 0.5) / 40).alias("x"), ((F.expr("p_partkey div 40") + 0.5) / 40).alias("y"), F.lit(1 / 40.0 - 1e-11).alias("size"), (k % 3).cast("int").alias("level"), (F.col("p_retailprice") / 1000).alias("v"))


@query(f"WITH {CELLS}, {ERR} SELECT id, round(error, 4) AS error, CASE WHEN error > 0.75 * max(error) OVER () AND level < 3 THEN 'refine' WHEN error < 0.1 * max(error) OVER () AND level > 0 THEN 'coarsen' ELSE 'keep' END AS mark FROM err")
def mesh_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join by squares, then marks."""
    errors = iterate.keep(mesh.gradient_error(_cells(spark, sf_dir)))  # read twice: for the largest one, then to mark
    return rounded(mesh.mark(errors).select("id", "error", "mark"), 4)


@query(f"WITH {CELLS} SELECT id, round(exp(-((x - 0.5) ** 2 + (y - 0.5) ** 2) / 0.02), 8) AS gaussian, round(exp(-((x - 0.3) ** 2 + (y - 0.3) ** 2) / 0.01) + 0.5 * exp(-((x - 0.7) ** 2 + (y - 0.6) ** 2) / 0.01), 8) AS pulses FROM cells")
def adaptive_test_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M56."""
    bump = lambda cx, cy, w: F.exp(-((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)) / w)
    return rounded(_cells(spark, sf_dir).select("id", bump(0.5, 0.5, 0.02).alias("gaussian"), (bump(0.3, 0.3, 0.01) + 0.5 * bump(0.7, 0.6, 0.01)).alias("pulses")), 8)


CONF = "conf AS (SELECT user_id AS cfg, CASE event_type WHEN 'view' THEN 'solver.type' WHEN 'click' THEN 'solver.tolerance' WHEN 'purchase' THEN 'solver.max_iterations' WHEN 'signup' THEN 'time.dt' ELSE 'time.cfl' END AS key, CASE event_type WHEN 'view' THEN 'string' WHEN 'purchase' THEN 'int' ELSE 'double' END AS type, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'magic' ELSE 'implicit' END WHEN 'purchase' THEN CAST(event_id * 300 AS VARCHAR) WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'abc' ELSE '0.' || CAST(event_id AS VARCHAR) END WHEN 'signup' THEN CAST(event_id % 3 - 1 AS VARCHAR) ELSE CAST(event_id % 3 AS VARCHAR) END AS value, event_id FROM events)"
LATEST = "one AS (SELECT * FROM conf QUALIFY row_number() OVER (PARTITION BY cfg, key ORDER BY event_id DESC) = 1)"
HALVES = "half AS (SELECT conf.*, event_id > (SELECT max(event_id) // 2 FROM conf) AS late FROM conf), last AS (SELECT * FROM half QUALIFY row_number() OVER (PARTITION BY cfg, key, late ORDER BY event_id DESC) = 1)"


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cfg, key, type, value, event_id): every setting that a user ever made."""
    e, i = F.col("event_type"), F.col("event_id")
    key = F.when(e == "view", "solver.type").when(e == "click", "solver.tolerance").when(e == "purchase", "solver.max_iterations").when(e == "signup", "time.dt").otherwise("time.cfl")
    kind = F.when(e == "view", "string").when(e == "purchase", "int").otherwise("double")
    value = F.when(e == "view", F.when(i % 4 == 0, "magic").otherwise("implicit")).when(e == "purchase", (i * 300).cast("string")).when(e == "click", F.when(i % 5 == 0, "abc").otherwise(F.concat(F.lit("0."), i.cast("string")))).when(e == "signup", (i % 3 - 1).cast("string")).otherwise((i % 3).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cfg"), key.alias("key"), kind.alias("type"), value.alias("value"), "event_id")


def _newest(rows: DataFrame) -> DataFrame:
    """The last value of every key of every configuration."""
    return rows.groupBy("cfg", "key").agg(F.max_by(F.struct("type", "value"), "event_id").alias("b")).select("cfg", "key", "b.*")


@query(f"WITH {CONF}, {HALVES} SELECT coalesce(o.cfg, n.cfg) AS cfg, coalesce(o.key, n.key) AS key, CASE WHEN o.type IS NULL THEN 'added' WHEN n.type IS NULL THEN 'removed' WHEN o.type = n.type AND o.value = n.value THEN 'unchanged' ELSE 'modified' END AS change, o.value AS old_value, n.value AS new_value FROM (SELECT * FROM last WHERE NOT late) o FULL JOIN (SELECT * FROM last WHERE late) n ON o.cfg = n.cfg AND o.key = n.key")
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first half of all events left, against the second half."""
    rows = _settings(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.expr("max(event_id) div 2").alias("middle"))))  # one row
    return cf.diff(_newest(rows.where("event_id <= middle")), _newest(rows.where("event_id > middle")), ["cfg"])


@query(f"""WITH {CONF}, {LATEST}, s(key, type, required, rule) AS (VALUES ('solver.type', 'string', true, 'enum'), ('solver.tolerance', 'double', false, 'positive'), ('solver.max_iterations', 'int', false, 'range'), ('solver.preconditioner', 'string', false, 'enum'), ('time.dt', 'double', true, 'positive'), ('time.t_final', 'double', false, 'positive'), ('time.output_interval', 'int', false, 'range'), ('time.cfl', 'double', false, 'unit')),
w AS (SELECT c.cfg, s.*, o.value FROM (SELECT DISTINCT cfg FROM one) c CROSS JOIN s LEFT JOIN one o ON o.cfg = c.cfg AND o.key = s.key),
p AS (SELECT cfg, key, CASE WHEN value IS NULL THEN CASE WHEN required THEN 'missing' END WHEN (type = 'double' AND try_cast(value AS DOUBLE) IS NULL) OR (type = 'int' AND try_cast(value AS BIGINT) IS NULL) THEN 'type' WHEN (rule = 'enum' AND value NOT IN ('explicit', 'implicit', 'petsc', 'ngsolve')) OR (rule = 'positive' AND NOT try_cast(value AS DOUBLE) > 0) OR (rule = 'range' AND NOT try_cast(value AS DOUBLE) BETWEEN 1 AND 1000000) OR (rule = 'unit' AND NOT try_cast(value AS DOUBLE) BETWEEN 0 AND 1) THEN 'rule' END AS problem FROM w)
SELECT cfg, key, problem FROM p WHERE problem IS NOT NULL""")
def config_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence, type, then rule."""
    return cf.validate(_newest(_settings(spark, sf_dir)), cf.schema_rows(spark, "solver", "time"), ["cfg"])


@query(f"""WITH {CONF}, {LATEST} SELECT cfg, key, CASE WHEN key = 'solver.tolerance' AND try_cast(value AS DOUBLE) IS NULL THEN 'type' ELSE 'custom' END AS problem FROM one
WHERE (key = 'solver.tolerance' AND (try_cast(value AS DOUBLE) IS NULL OR NOT try_cast(value AS DOUBLE) < 0.5)) OR (key = 'solver.max_iterations' AND try_cast(value AS BIGINT) % 1000 <> 0)""")
def config_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.15: own predicates beside a schema's rules, also of a key that it lacks."""
    schema = spark.createDataFrame([("solver.tolerance", "double", False, None, None, None, None, None)], cf.SCHEMA)
    own = {"solver.tolerance": lambda v: v.try_cast("double") < 0.5, "solver.max_iterations": lambda v: v.try_cast("bigint") % 1000 == 0}
    return cf.validate(_newest(_settings(spark, sf_dir)), schema, ["cfg"], own)


@query(f"""WITH {CONF}, {LATEST} SELECT cfg, count(*) AS n, coalesce(try_cast(max(value) FILTER (key = 'solver.tolerance') AS DOUBLE), -1.0) AS tolerance, coalesce(max(value) FILTER (key = 'solver.type'), 'explicit') AS solver, count(*) FILTER (key = 'time.dt') > 0 AS has_dt,
coalesce(string_agg(key || '=' || value, ';' ORDER BY key) FILTER (starts_with(key, 'solver.')) || ';', '') || 'time.cfl=0.5' AS merged FROM one GROUP BY cfg""")
def attribute_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as one map a user; get with a default, has, remove, set and merge."""
    from ..operators import attributes as at

    rows = at.collect(_settings(spark, sf_dir), ["cfg"], "key", "value", "event_id")
    merged = at.merge(at.remove("attributes", "time.dt", "time.cfl"), at.put(F.lit(None).cast("map<string,string>"), "time.cfl", 0.5))
    return rows.select("cfg", F.size("attributes").cast("long").alias("n"), at.get("attributes", "solver.tolerance", -1.0).alias("tolerance"), at.get("attributes", "solver.type", "explicit").alias("solver"), at.has("attributes", "time.dt").alias("has_dt"), at.spell(merged).alias("merged"))


@query(f"WITH {CONF}, {LATEST}, d AS (SELECT cfg, v.key, v.value FROM (SELECT DISTINCT cfg FROM one) CROSS JOIN (VALUES ('solver.tolerance', '1.0E-6'), ('solver.max_iterations', '1000'), ('solver.preconditioner', 'jacobi'), ('time.t_final', '1.0'), ('time.output_interval', '10'), ('time.cfl', '0.5')) v(key, value)) SELECT coalesce(n.cfg, d.cfg) AS cfg, coalesce(n.key, d.key) AS key, coalesce(n.value, d.value) AS value FROM d FULL JOIN one n ON n.cfg = d.cfg AND n.key = d.key")
def config_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults under every configuration."""
    newest = _newest(_settings(spark, sf_dir))
    return cf.defaults(newest, cf.schema_rows(spark, "solver", "time"), ["cfg"]).select("cfg", "key", "value")


@query(f"WITH {CONF}, {LATEST} SELECT cfg, substr(key, 8) AS key, value FROM one WHERE starts_with(key, 'solver.')")
def config_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, T6."""
    return cf.with_prefix(_newest(_settings(spark, sf_dir)), "solver.", strip=True).select("cfg", "key", "value")


@query("SELECT tag, field, count(*) AS n FROM (SELECT user_id AS tag, event_type AS field, value > 20 AS enabled FROM events) WHERE enabled GROUP BY 1, 2 HAVING count(*) > 1")
def boundary_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27, F7."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("tag"), F.col("event_type").alias("field"), (F.col("value") > 20).alias("enabled"))
    return cf.conflicts(rows)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26, F8."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def timing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28, A31."""
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.select("event_type", "n", F.round("total", 4).alias("total"), "least", "most", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT r AS rank, r * (1000003 // 7) + least(r, 1000003 % 7) AS start, 1000003 // 7 + CASE WHEN r < 1000003 % 7 THEN 1 ELSE 0 END AS size FROM range(7) t(r)")
def block_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    start, size = partition.block_bounds(1000003, 7, "rank")
    return spark.range(7).select(F.col("id").alias("rank")).select("rank", start.alias("start"), size.alias("size"))


@query("SELECT * FROM (VALUES (1, 1, 1, 1, 6000), (6, 2, 3, 1, 3666), (8, 2, 2, 2, 3000), (12, 2, 2, 3, 2666), (22, 2, 11, 1, 3181), (210, 14, 3, 5, 1209)) t(n, x, y, z, ratio)")
def process_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P10."""
    rows = [(n, *partition.process_grid(n)) for n in (1, 6, 8, 12, 22, 210)]
    return spark.createDataFrame(rows, "n int, x int, y int, z int").withColumn("ratio", partition.surface_ratio("x", "y", "z"))


LOADS = "loads AS (SELECT s_nationkey AS grp, s_suppkey AS rank, 100 + s_suppkey % 17 AS work, abs(s_acctbal) + 1 AS secs FROM supplier)"


def _loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("rank"), (100 + F.col("s_suppkey") % 17).alias("work"), (F.abs("s_acctbal") + 1).alias("secs"))


@query(f"WITH {LOADS} SELECT grp, round(min(secs), 6) AS least, round(max(secs), 6) AS greatest, round(avg(secs), 6) AS mean, round(max(secs) / avg(secs), 6) AS imbalance FROM loads GROUP BY grp")
def load_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    return rounded(partition.load_stats(_loads(spark, sf_dir), ["grp"], "secs"))


@query(f"WITH {LOADS}, w AS (SELECT *, floor(sum(work) OVER g * (work / secs) / sum(work / secs) OVER g) AS t, rank = max(rank) OVER g AS l, sum(work) OVER g AS total FROM loads WINDOW g AS (PARTITION BY grp)) SELECT grp, rank, CAST(CASE WHEN l THEN total - sum(CASE WHEN l THEN 0 ELSE t END) OVER (PARTITION BY grp) ELSE t END AS BIGINT) AS target FROM w")
def load_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    return partition.rebalance(_loads(spark, sf_dir), "grp", "rank", "work", "secs").select("grp", "rank", "target")


@query(f"WITH {LOADS}, s AS (SELECT *, floor(100000 * work / sum(work) OVER (PARTITION BY grp)) AS s FROM loads), p AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY grp ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, rank = min(rank) OVER (PARTITION BY grp) AS f, rank = max(rank) OVER (PARTITION BY grp) AS l FROM s) SELECT grp, rank, CAST(start AS BIGINT) AS start, CAST(CASE WHEN l THEN 100000 ELSE start + s END AS BIGINT) AS stop, CAST(CASE WHEN f THEN 0 ELSE 2 END AS INT) AS halo_left, CAST(CASE WHEN l THEN 0 ELSE 2 END AS INT) AS halo_right FROM p")
def weighted_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    return partition.weighted_split(_loads(spark, sf_dir), "grp", "rank", "work", 100_000, 2).select("grp", "rank", "start", "stop", "halo_left", "halo_right")


@query(f"WITH {LOADS} SELECT grp, arg_min(rank, struct_pack(a := secs, b := rank)) AS rank, min(secs) AS secs FROM loads GROUP BY grp")
def least_loaded_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4."""
    return partition.least_loaded(_loads(spark, sf_dir), "grp", "rank", "secs")


@query(f"WITH {LOADS}, g AS (SELECT grp, a, b, sum(abs(work - (a * 10 + b))) AS o FROM loads, range(8, 13) x(a), range(0, 10) y(b) GROUP BY 1, 2, 3) SELECT grp, arg_min(a, struct_pack(o := o, a := a, b := b)) AS a, arg_min(b, struct_pack(o := o, a := a, b := b)) AS b, CAST(min(o) AS BIGINT) AS objective FROM g GROUP BY grp")
def parameter_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the best of fifty parameter pairs a group."""
    grid = F.explode(F.sequence(F.lit(8).cast("long"), F.lit(12).cast("long")))
    rows = _loads(spark, sf_dir).select("grp", "work", grid.alias("a")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("b"))
    points = rows.groupBy("grp", "a", "b").agg(F.sum(F.abs(F.col("work") - (F.col("a") * 10 + F.col("b")))).alias("o"))
    return partition.grid_search(points, F.col("o"), ["a", "b"], "grp")


@query(f"WITH {FIELD}, d AS (SELECT run, i, w, lead(v) OVER g - 2 * v + lag(v) OVER g AS xx FROM field WINDOW g AS (PARTITION BY run ORDER BY i)) SELECT run, round(regr_slope(0.3 * xx + w, xx), 8) AS \"D\", round(regr_r2(0.3 * xx + w, xx), 8) AS r2 FROM d WHERE xx IS NOT NULL GROUP BY run")
def inverse_diffusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML5, ML2: a diffusivity from noisy data by least squares."""
    from ..operators import stencils

    rows = stencils.laplacian(field(spark, sf_dir), 1, 1.0).where("lap is not null").withColumn("ut", 0.3 * F.col("lap") + F.col("w"))
    return rounded(ml.fit_diffusivity(rows, "run", "ut", "lap"), 8)


@query("SELECT p_partkey AS id, round(0.5 * tanh(0.3 * p_size / 50 - 0.2 * (p_retailprice / 1000) + 0.1) - 0.25 * tanh(0.7 * (p_retailprice / 1000)) + 0.05, 9) AS prediction FROM part")
def network_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML6, ML1: a forward pass a batch."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    layers = [(np.array([[0.3, 0.0], [-0.2, 0.7]]), np.array([0.1, 0.0])), (np.array([[0.5], [-0.25]]), np.array([0.05]))]
    return rounded(ml.predict(rows, ["x", "y"], layers).select("id", "prediction"), 9)


@query(f"WITH {FIELD}, a AS (SELECT run, i, v + 0.1 * coalesce(lead(v) OVER g - 2 * v + lag(v) OVER g, CASE WHEN lag(v) OVER g IS NULL THEN lead(v) OVER g - v ELSE lag(v) OVER g - v END, 0) AS v FROM field WINDOW g AS (PARTITION BY run ORDER BY i)) SELECT run, i, round(v + 0.1 * coalesce(lead(v) OVER g - 2 * v + lag(v) OVER g, CASE WHEN lag(v) OVER g IS NULL THEN lead(v) OVER g - v ELSE lag(v) OVER g - v END, 0), 8) AS v FROM a WINDOW g AS (PARTITION BY run ORDER BY i)")
def diffusion_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two explicit steps with Neumann ends, a run a group."""
    return rounded(iterate.diffuse_runs(field(spark, sf_dir), 0.1, 1.0, 1.0, 2).select("run", "i", "v"), 8)


@query()
def diffusion_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five Crank-Nicolson steps (rows only; tests hold them against dense algebra)."""
    return rounded(iterate.diffuse_runs(field(spark, sf_dir), 0.4, 1.0, 2.0, 5, "dirichlet", method="crank_nicolson"), 8)


@query(f"""WITH {FIELD}, f AS (SELECT run, i, v / 50 AS u, w / 12 AS v FROM field),
n AS (SELECT *, coalesce(lead(u) OVER g, first_value(u) OVER h) + coalesce(lag(u) OVER g, last_value(u) OVER h) - 2 * u AS lu, coalesce(lead(v) OVER g, first_value(v) OVER h) + coalesce(lag(v) OVER g, last_value(v) OVER h) - 2 * v AS lv FROM f WINDOW g AS (PARTITION BY run ORDER BY i), h AS (PARTITION BY run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT run, i, round(u + 0.1 * (0.2 * lu - u * v * v + 0.04 * (1 - u)), 7) AS u, round(v + 0.1 * (0.1 * lv + u * v * v - 0.1 * v), 7) AS v FROM n""")
def gray_scott_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One periodic Gray-Scott step."""
    rows = field(spark, sf_dir).select("run", "i", (F.col("v") / 50).alias("u"), (F.col("w") / 12).alias("v"))
    return rounded(iterate.react_runs(rows, "gray_scott", 0.2, 0.1, 0.04, 0.06, 0.1, 1, 1.0), 7)


AROUND = "WINDOW g AS (PARTITION BY run ORDER BY i), h AS (PARTITION BY run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _strang(source: str, steps: int, dt: float) -> str:
    """CTEs of Brusselator steps: half a step of diffusion, a step of reaction, and the other half."""
    lap = lambda c: f"(coalesce(lead({c}) OVER g, first_value({c}) OVER h) - 2 * {c} + coalesce(lag({c}) OVER g, last_value({c}) OVER h))"
    half = lambda name: f"SELECT run, i, u + {dt} / 2 * 0.1 * {lap('u')} AS u, v + {dt} / 2 * 0.2 * {lap('v')} AS v FROM {name} {AROUND}"
    out, now = [], source
    for k in range(steps):
        out += [f"a{k} AS ({half(now)})", f"b{k} AS (SELECT run, i, u + {dt} * (1.0 - 4.0 * u + u * u * v) AS u, v + {dt} * (3.0 * u - u * u * v) AS v FROM a{k})", f"c{k} AS ({half(f'b{k}')})"]
        now = f"c{k}"
    return ", ".join(out) + f" SELECT run, i, round(u, 8) AS u, round(v, 8) AS v FROM {now}"


@query(f"WITH {FIELD}, f AS (SELECT run, i, 1 + v / 500 AS u, 3 + w / 120 AS v FROM field), {_strang('f', 10, 0.01)}")
def reaction_diffusion_strang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten Strang-split Brusselator steps, periodic."""
    rows = field(spark, sf_dir).select("run", "i", (1 + F.col("v") / 500).alias("u"), (3 + F.col("w") / 120).alias("v"))
    return rounded(iterate.react_runs(rows, "brusselator", 0.1, 0.2, 1.0, 3.0, 0.01, 10, 1.0, splitting="strang"), 8)


@query(f"WITH {FIELD}, s AS (SELECT run, CAST(i // 100 AS INT) AS slab, i, v, false AS ghost FROM field UNION ALL SELECT run, CAST((i - 1) // 100 AS INT), i, v, true FROM field WHERE i % 100 = 0 AND i > 0 UNION ALL SELECT run, CAST((i + 1) // 100 AS INT), i, v, true FROM field WHERE i % 100 = 99) SELECT run, i, v, slab, ghost FROM s")
def halo_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slabs of a hundred positions with one ghost row a side."""
    return partition.halo_rows(field(spark, sf_dir).select("run", "i", "v"), "slab", "i", 100).select("run", "i", "v", "slab", "ghost")


@query(f"WITH {FIELD} SELECT run, i, round(2.5 * v + w, 9) AS axpy, round(v - w, 9) AS difference, 3.0 * v AS scaled FROM field")
def vector_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M55, M52."""
    return rounded(field(spark, sf_dir).select("run", "i", (2.5 * F.col("v") + F.col("w")).alias("axpy"), (F.col("v") - F.col("w")).alias("difference"), (3.0 * F.col("v")).alias("scaled")), 9)


@query("WITH g AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT user_id, date_trunc('week', ts) AS week, max(value) FILTER (r % 3 = 0) AS a, max(value) FILTER (r % 3 = 1) AS b, max(value) FILTER (r % 3 = 2) AS c FROM g GROUP BY 1, 2")
def time_series_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO12, M62: long rows to one column a species."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("s", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.row_number().over(w) % 3 + 1).cast("int")))
    return rows.groupBy("user_id", F.date_trunc("week", "ts").alias("week")).pivot("s", ["a", "b", "c"]).agg(F.max("value"))


@query("WITH c AS (SELECT p_partkey AS cell, p_retailprice / 1000 AS c, 450 + p_size * 2.0 AS t FROM part), s AS (SELECT cell, t, c, 0.01 * 1e5 * exp(-50000 / (8.314 * t)) * c AS u FROM c) SELECT cell, round(c - u, 8) AS c, round(t + 100 * u / 10, 8) AS \"T\" FROM s")
def reactor_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One coupled thermal-chemical step, a batch of cells at a time."""
    from ..operators import coupled

    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), (F.col("p_retailprice") / 1000).alias("c"), (450 + F.col("p_size") * 2.0).alias("T"))
    return rounded(coupled.reactor(cells, "cell", "c", "T", 1e5, 5e4, -100.0, 10.0, 0.01, 1), 8)


LINES = "WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j)"
SPREAD = "{c} + 0.01 * {d} * coalesce((lead({c}) OVER x - 2 * {c} + lag({c}) OVER x) / 0.01 + (lead({c}) OVER y - 2 * {c} + lag({c}) OVER y) / 0.04, 0) AS {c}"


@query(f"""WITH {GRID2}, p AS (SELECT i, j, ux, uy, v AS c, 300 + i * 2.0 AS t FROM grid2),
r AS (SELECT *, least(c, 0.01 * 1e3 * exp(-3e4 / (8.314 * t)) * c) AS used FROM p), q AS (SELECT i, j, ux, uy, c - used AS c, t + 5 * used AS t FROM r),
s AS (SELECT i, j, ux, uy, {SPREAD.format(c='t', d='2e-2')}, {SPREAD.format(c='c', d='1e-2')} FROM q {LINES}),
n AS (SELECT *, lag(c) OVER x AS l, lead(c) OVER x AS r, lag(c) OVER y AS d, lead(c) OVER y AS u FROM s {LINES})
SELECT i, j, round(CASE WHEN l IS NULL OR r IS NULL OR d IS NULL OR u IS NULL THEN c ELSE c - 0.01 * (ux * (CASE WHEN ux > 0 THEN c - l ELSE r - c END) / 0.1 + uy * (CASE WHEN uy > 0 THEN c - d ELSE u - c END) / 0.2) END, 8) AS c, round(t, 8) AS "T" FROM n""")
def multiphysics_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chemistry, heat, diffusion, advection on a plane."""
    from ..operators import coupled
    plane = grid2(spark, sf_dir).withColumnRenamed("v", "c").withColumn("T", 300 + F.col("i") * 2.0)
    return rounded(coupled.plane_step(plane, 0.01, 0.1, 0.2, 1e-2, 2e-2, 1e3, 3e4, 5.0).select("i", "j", "c", "T"), 8)
