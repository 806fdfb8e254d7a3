"""Queries on large planes, many steps by tiles, and on networks that learn an equation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pinn, tiles
from ..operators.iterate import keep
from ..session import spread, table
from .bindings import PLANE, plane
from .registry import query, rounded


def _step(source: str, sums: str, beyond: str) -> str:
    """SQL of one explicit step: neighbours by exact place, ``beyond`` where one is missing."""
    near = " ".join(f"LEFT JOIN {source} {n} ON {n}.i = c.i + ({a}) AND {n}.j = c.j + ({b})" for n, a, b in (("e", 1, 0), ("w", -1, 0), ("n", 0, 1), ("s", 0, -1)))
    lap = lambda c: f"((coalesce(e.{c}, {beyond.format(c=c)}) - 2 * c.{c} + coalesce(w.{c}, {beyond.format(c=c)})) / 0.25 + (coalesce(n.{c}, {beyond.format(c=c)}) - 2 * c.{c} + coalesce(s.{c}, {beyond.format(c=c)})) / 0.16)"
    return f"SELECT c.i, c.j, {sums.format(lu=lap('u'), lv=lap('v'))} FROM {source} c {near}"


HEAT = "c.v + 0.05 * (0.6 * {lv} + 0.02) AS v, c.u"
GRAY_SCOTT = "c.u + 0.1 * (0.2 * {lu} + (-c.u * c.v * c.v + 0.04 * (1 - c.u))) AS u, c.v + 0.1 * (0.1 * {lv} + (c.u * c.v * c.v - (0.04 + 0.06) * c.v)) AS v"
BRUSSELATOR = "c.u + 0.01 * (0.2 * {lu} + (1.0 - (3.0 + 1) * c.u + c.u * c.u * c.v)) AS u, c.v + 0.01 * (0.1 * {lv} + (3.0 * c.u - c.u * c.u * c.v)) AS v"


@query(f"WITH {PLANE}, a AS ({_step('plane', HEAT, '0.3')}), b AS ({_step('a', HEAT, '0.3')}), d AS ({_step('b', HEAT, '0.3')}) SELECT i, j, round(v, 8) AS v FROM d")
def diffusion_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three explicit steps with a source on one plane, Dirichlet edges, two steps a
    shuffle."""
    out = tiles.diffuse(plane(spark, sf_dir), 0.6, 0.05, 3, (0.5, 0.4), "dirichlet", 0.3, 0.02, halo=2)
    return rounded(out.select("i", "j", "v"), 8)


@query(f"WITH {PLANE}, a AS ({_step('plane', GRAY_SCOTT, '0.5')}), b AS ({_step('a', GRAY_SCOTT, '0.5')}) SELECT i, j, round(u, 8) AS u, round(v, 8) AS v FROM b")
def gray_scott_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of two species on one plane, Dirichlet edges, in one shuffle."""
    out = tiles.react_diffuse(plane(spark, sf_dir), "gray_scott", (0.2, 0.1), (0.04, 0.06), 0.1, 2, (0.5, 0.4), "dirichlet", (0.5, 0.5))
    return rounded(out.select("i", "j", "u", "v"), 8)


@query(f"WITH {PLANE}, a AS ({_step('plane', BRUSSELATOR, 'c.{c}')}), b AS ({_step('a', BRUSSELATOR, 'c.{c}')}) SELECT i, j, round(u, 8) AS u, round(v, 8) AS v FROM b")
def brusselator_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Brusselator steps without flux over the edges."""
    out = tiles.react_diffuse(plane(spark, sf_dir), "brusselator", (0.2, 0.1), (1.0, 3.0), 0.01, 2, (0.5, 0.4), "neumann")
    return rounded(out.select("i", "j", "u", "v"), 8)


@query("SELECT p_partkey AS id, round((p_partkey * 37 % 1009) / 1009.0, 6) AS x, round((p_partkey * 61 % 997) / 997.0, 6) AS t, true AS within FROM part")
def network_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML1, ML2, I27: a network trained on the equation at a place for every part, and on
    boundary and initial values beside it; within 0.02 of the exact solution at every place."""
    place = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 1009 / 1009.0).alias("x"), (F.col("p_partkey") * 61 % 997 / 997.0).alias("t"))
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    rows = [place.select(F.lit("pde").alias("kind"), "x", "t", none.alias("u")), place.select(F.lit("ic"), "x", zero, F.sin(F.pi() * F.col("x"))), place.select(F.lit("bc"), (F.col("id") % 2).cast("double"), "t", zero)]
    points = keep(spread(rows[0].union(rows[1]).union(rows[2])))
    model, _ = pinn.train(points, 0.1, hidden=10, rounds=45, tolerance=1e-6)
    exact = F.exp(-0.1 * F.pi() * F.pi() * F.col("t")) * F.sin(F.pi() * F.col("x"))
    out = model.predict(place)
    return rounded(out.select("id", "x", "t", (F.abs(F.col("prediction") - exact) < 0.02).alias("within")))
