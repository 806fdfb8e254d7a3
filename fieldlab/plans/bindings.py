"""The driver's tables in the roles of the domain, and the same as DuckDB CTEs.

=============  =====================================================================
field          lineitem: run = supplier, position by row number, value = quantity
history        events: key = user, time = ts, value
species        part: molecular weight, formation enthalpy, heat capacity from columns
reactions      orders: rate-law parameters from the total price
stoichiometry  lineitem: reaction = order, species = part, side by flag
plane          lineitem: one grid of all runs, i = run, j = position in the run
grid           part: a square grid by key, value = retail price
matrix         lineitem: rows and columns by keys, value = discount
mesh           customer: triangles on a jittered grid of nodes
=============  =====================================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import parts, table

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]

FIELD = "field AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS i, l_quantity AS v, l_extendedprice / 1e4 AS w FROM lineitem)"


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, i, v, w): quantities, and prices / 1e4 as a second value."""
    w = Window.partitionBy("l_suppkey").orderBy(*ORDER)
    lines = table(spark, sf_dir, "lineitem")
    return lines.repartition(parts(spark, lines.count()), "l_suppkey").select(F.col("l_suppkey").alias("run"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("l_quantity").alias("v"), (F.col("l_extendedprice") / 1e4).alias("w"))


PLANE = f"{FIELD}, plane AS (SELECT 0 AS run, run AS i, i AS j, v / 50 AS u, w / 12 AS v FROM field)"


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, i, j, u, v): a plane of all suppliers by their positions, ragged on one side."""
    return field(spark, sf_dir).select(F.lit(0).alias("run"), F.col("run").alias("i"), F.col("i").alias("j"), (F.col("v") / 50).alias("u"), (F.col("w") / 12).alias("v"))


STOICH = "stoich AS (SELECT l_orderkey AS rxn, l_partkey AS species, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'P' END AS side, CAST(max(l_linenumber) AS DOUBLE) / 4 AS coeff FROM lineitem GROUP BY 1, 2, 3)"
PAIRED = "paired AS (SELECT l_orderkey AS rxn, l_partkey || '/' || l_suppkey AS species, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'P' END AS side, CAST(max(l_linenumber) AS DOUBLE) / 4 AS coeff FROM lineitem GROUP BY 1, 2, 3)"
SPECIES = "species AS (SELECT p_partkey AS species, 0.002 + p_size * 0.001 AS mw, (p_retailprice - 1000) * 10 AS h_form, 500 + p_size * 10.0 AS cp, 0.01 * p_size AS k_th, (p_partkey * 37 % 101) / 50.0 AS conc, CASE p_size % 4 WHEN 0 THEN 'solid' WHEN 1 THEN 'liquid' ELSE 'gas' END AS phase FROM part)"
REACTIONS = "reactions AS (SELECT o_orderkey AS rxn, 1e6 * (1 + o_orderkey % 7) AS a_f, (o_orderkey % 3) * 0.5 AS b_f, 20000 + o_totalprice / 10 AS e_f, 5e5 AS a_r, 0.0 AS b_r, 30000 + o_totalprice / 20 AS e_r, o_orderkey % 2 = 0 AS reversible FROM orders)"


def stoichiometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rxn, species, side, coeff): side R or P."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.repartition(parts(spark, lines.count()), "l_orderkey")
    return rows.groupBy(F.col("l_orderkey").alias("rxn"), F.col("l_partkey").alias("species"), F.when(F.col("l_returnflag") == "R", "R").otherwise("P").alias("side")).agg((F.max("l_linenumber").cast("double") / 4).alias("coeff"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stoichiometry with a species for each part of each supplier, many of one side only."""
    rows = table(spark, sf_dir, "lineitem")
    name = F.concat_ws("/", "l_partkey", "l_suppkey").alias("species")
    return rows.groupBy(F.col("l_orderkey").alias("rxn"), name, F.when(F.col("l_returnflag") == "R", "R").otherwise("P").alias("side")).agg((F.max("l_linenumber").cast("double") / 4).alias("coeff"))


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    phase = F.when(F.col("p_size") % 4 == 0, "solid").when(F.col("p_size") % 4 == 1, "liquid").otherwise("gas")
    return rows.select(F.col("p_partkey").alias("species"), (0.002 + F.col("p_size") * 0.001).alias("mw"), ((F.col("p_retailprice") - 1000) * 10).alias("h_form"), (500 + F.col("p_size") * 10.0).alias("cp"), (0.01 * F.col("p_size")).alias("k_th"), (F.col("p_partkey") * 37 % 101 / 50.0).alias("conc"), phase.alias("phase"))


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(k.alias("rxn"), (1e6 * (1 + k % 7)).alias("a_f"), (k % 3 * 0.5).alias("b_f"), (20000 + price / 10).alias("e_f"), F.lit(5e5).alias("a_r"), F.lit(0.0).alias("b_r"), (30000 + price / 20).alias("e_r"), (k % 2 == 0).alias("reversible"))


GRID2 = "grid2 AS (SELECT 0 AS run, p_partkey % 40 AS i, p_partkey // 40 AS j, p_retailprice / 1000 AS v, ((p_partkey * 31) % 17 - 8) / 8.0 AS ux, ((p_partkey * 13) % 11 - 5) / 5.0 AS uy FROM part)"


def grid2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, i, j, v, ux, uy): 40 columns; the last row may be short."""
    return table(spark, sf_dir, "part").select(F.lit(0).alias("run"), (F.col("p_partkey") % 40).alias("i"), F.expr("p_partkey div 40").alias("j"), (F.col("p_retailprice") / 1000).alias("v"), ((F.col("p_partkey") * 31 % 17 - 8) / 8.0).alias("ux"), ((F.col("p_partkey") * 13 % 11 - 5) / 5.0).alias("uy"))


GRID3 = "grid3 AS (SELECT p_partkey // 1000 AS run, p_partkey % 10 AS i, p_partkey // 10 % 10 AS j, p_partkey // 100 % 10 AS k, p_retailprice / 1000 AS v FROM part)"


def grid3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, i, j, k, v): cubes of ten, the last one as far as the table goes."""
    return table(spark, sf_dir, "part").select(F.expr("p_partkey div 1000").alias("run"), (F.col("p_partkey") % 10).alias("i"), F.expr("p_partkey div 10 % 10").alias("j"), F.expr("p_partkey div 100 % 10").alias("k"), (F.col("p_retailprice") / 1000).alias("v"))


MATRIX = "matrix AS (SELECT l_suppkey AS run, l_orderkey % 50 AS i, l_partkey % 50 AS j, sum(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3)"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, i, j, v): one sparse 50 x 50 matrix a supplier, repeated entries summed."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_suppkey").alias("run"), (F.col("l_orderkey") % 50).alias("i"), (F.col("l_partkey") % 50).alias("j"), F.col("l_discount").alias("v"))
    return rows.repartition(parts(spark, lines.count()), "run", "i", "j").groupBy("run", "i", "j").agg(F.sum("v").alias("v"))


NODES = "nodes AS (SELECT c_custkey AS id, c_custkey % 30 + c_acctbal / 1e5 AS x, c_custkey // 30 + c_nationkey / 100.0 AS y, c_acctbal / 1e4 AS z, c_nationkey AS tag FROM customer)"
ELEMENTS = "elements AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'triangle' WHEN 1 THEN 'quad' WHEN 2 THEN 'tet' ELSE 'line' END AS type, CASE c_custkey % 4 WHEN 0 THEN [c_custkey, c_custkey + 1, c_custkey + 30] WHEN 1 THEN [c_custkey, c_custkey + 1, c_custkey + 31, c_custkey + 30] WHEN 2 THEN [c_custkey, c_custkey + 1, c_custkey + 30, c_custkey + 31] ELSE [c_custkey, c_custkey + 1] END AS node_ids, c_nationkey AS tag FROM customer WHERE c_custkey % 30 < 29 AND c_custkey + 31 < (SELECT max(c_custkey) FROM customer))"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z, tag)."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k % 30 + F.col("c_acctbal") / 1e5).alias("x"), (F.expr("c_custkey div 30") + F.col("c_nationkey") / 100.0).alias("y"), (F.col("c_acctbal") / 1e4).alias("z"), F.col("c_nationkey").alias("tag"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, node_ids, tag): triangles, quads, tetrahedra and lines."""
    k = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    last = customer.agg(F.max("c_custkey").alias("last"))
    rows = customer.join(F.broadcast(last), k + 31 < F.col("last")).where(k % 30 < 29)
    kind = F.when(k % 4 == 0, "triangle").when(k % 4 == 1, "quad").when(k % 4 == 2, "tet").otherwise("line")
    ids = F.when(k % 4 == 0, F.array(k, k + 1, k + 30)).when(k % 4 == 1, F.array(k, k + 1, k + 31, k + 30)).when(k % 4 == 2, F.array(k, k + 1, k + 30, k + 31)).otherwise(F.array(k, k + 1))
    return rows.select(k.alias("id"), kind.alias("type"), ids.alias("node_ids"), F.col("c_nationkey").alias("tag"))
