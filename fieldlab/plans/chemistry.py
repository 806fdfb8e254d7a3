"""Queries on species, reactions, networks and scalar formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boundary, kinetics, models, surface, text, thermo, units, vectors
from ..functions import transport as tr
from ..operators import iterate, trajectory
from ..operators import reactions as rx
from ..session import parts, table
from .bindings import PAIRED, REACTIONS, SPECIES, STOICH, paired, reactions, species, stoichiometry
from .registry import query, rounded

P = "p AS (SELECT p_partkey AS id, 300 + p_size * 20.0 AS t, p_retailprice / 1000 AS a, p_size / 10.0 AS b FROM part)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, a, b): temperatures and two coefficients."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (300 + F.col("p_size") * 20.0).alias("t"), (F.col("p_retailprice") / 1000).alias("a"), (F.col("p_size") / 10.0).alias("b"))


NASA = "(CASE WHEN t <= 800 THEN a ELSE b END)"


@query(f"""WITH {P}, c AS (SELECT id, t, CASE WHEN t <= 800 THEN [a, 1e-3, 1e-6, 1e-9, 1e-12, -1000.0, 4.0] ELSE [b, 2e-3, -1e-6, 2e-10, -1e-14, -900.0, 5.0] END AS k FROM p),
v AS (SELECT id, 8.314 * (k[1] + k[2] * t + k[3] * t ** 2 + k[4] * t ** 3 + k[5] * t ** 4) AS cp, 8.314 * t * (k[1] + k[2] * t / 2 + k[3] * t ** 2 / 3 + k[4] * t ** 3 / 4 + k[5] * t ** 4 / 5 + k[6] / t) AS h, 8.314 * (k[1] * ln(t) + k[2] * t + k[3] * t ** 2 / 2 + k[4] * t ** 3 / 3 + k[5] * t ** 4 / 4 + k[7]) AS s, t FROM c)
SELECT id, round(cp, 6) AS cp, round(h, 4) AS h, round(s, 6) AS s, round(h - t * s, 4) AS g FROM v""")
def nasa_polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M4."""
    rows = points(spark, sf_dir).withColumns({"low": F.array(F.col("a"), *map(F.lit, (1e-3, 1e-6, 1e-9, 1e-12, -1000.0, 4.0))), "high": F.array(F.col("b"), *map(F.lit, (2e-3, -1e-6, 2e-10, -1e-14, -900.0, 5.0)))})
    return rounded(rows.select("id", *(thermo.nasa7(k, "t", 200.0, 800.0, 3000.0, "low", "high").alias(k) for k in ("cp", "h", "s", "g"))), h=4, g=4)


@query(f"""WITH {P}, x AS (SELECT id, t, a, t / sqrt((80 + b) * 107.4) AS r, (3 + b / 10 + 3.46) / 2 AS s, 2 / (1 / ((0.002 + b / 100) * 1000.0) + 1 / 32.0) AS m FROM p)
SELECT id, round(1e4 * 0.00266 * t ** 1.5 / (101325 * a * 1e-5 * s * s * (1.16145 / r ** 0.14874 + 0.52487 / exp(0.7732 * r)) * sqrt(m)) * 1e-4, 8) AS d FROM x""")
def binary_diffusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 (times 1e4)."""
    d = thermo.binary_diffusivity("t", 101325 * F.col("a"), 0.002 + F.col("b") / 100, 3 + F.col("b") / 10, 80 + F.col("b"), 0.032, 3.46, 107.4)
    return rounded(points(spark, sf_dir).select("id", (1e4 * d).alias("d")), 8)


@query(f"WITH {P} SELECT id, round(log10(1e10 * t ** b * exp(-(20000 + a * 1e4) / (8.314 * t))), 6) AS log_k, round(1000 * a * 0.1 / (1000 * (4000 + b)), 10) AS d_t FROM p")
def arrhenius_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M11."""
    k = kinetics.arrhenius(1e10, "b", 20000 + F.col("a") * 1e4, "t")
    return rounded(points(spark, sf_dir).select("id", F.log10(k).alias("log_k"), thermo.temperature_change(1000 * F.col("a"), 1000.0, 4000 + F.col("b"), 0.1).alias("d_t")), 6, d_t=10)


@query(f"WITH {REACTIONS}, c AS (SELECT unnest([300.0, 400.0, 500.0, 1000.0]) AS t) SELECT rxn, t, round(log10(a_f * t ** b_f * exp(-e_f / (8.314 * t))), 6) AS log_kf, round(log10(a_r * exp(-e_r / (8.314 * t))), 6) AS log_kr FROM reactions, c")
def batched_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: every reaction at every temperature of a short list."""
    rows = reactions(spark, sf_dir).withColumn("t", F.explode(F.array(*map(F.lit, (300.0, 400.0, 500.0, 1000.0)))))
    return rounded(rows.select("rxn", "t", F.log10(kinetics.arrhenius("a_f", "b_f", "e_f", "t")).alias("log_kf"), F.log10(kinetics.arrhenius("a_r", "b_r", "e_r", "t")).alias("log_kr")))


ROP = f"""{STOICH}, {SPECIES}, {REACTIONS},
sides AS (SELECT rxn, product(CASE WHEN side = 'R' THEN conc ** coeff END) AS r, product(CASE WHEN side = 'P' THEN conc ** coeff END) AS p FROM (SELECT s.rxn, s.side, s.coeff, coalesce(c.conc, 0) AS conc FROM stoich s LEFT JOIN species c USING (species)) GROUP BY rxn),
rop AS (SELECT rxn, a_f * 900.0 ** b_f * exp(-e_f / (8.314 * 900)) * coalesce(r, 1) AS forward, CASE WHEN reversible THEN a_r * 900.0 ** b_r * exp(-e_r / (8.314 * 900)) * coalesce(p, 1) ELSE 0 END AS reverse FROM reactions JOIN sides USING (rxn)),
net AS (SELECT rxn, species, sum(CASE WHEN side = 'P' THEN coeff ELSE -coeff END) AS nu FROM stoich GROUP BY 1, 2)"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rx.rates_of_progress(stoichiometry(spark, sf_dir), reactions(spark, sf_dir), species(spark, sf_dir), 900.0, on_missing="zero")


def _scaled(c: str):
    return F.signum(c) * F.log1p(F.abs(F.col(c)))


SCALE = "round(sign({c}) * ln(1 + abs({c})), 6) AS {n}"


@query(f"WITH {ROP} SELECT rxn, {SCALE.format(c='forward', n='forward')}, {SCALE.format(c='reverse', n='reverse')}, {SCALE.format(c='(forward - reverse)', n='net')} FROM rop")
def rates_of_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, A9, M8, on a signed log scale."""
    rows = _rates(spark, sf_dir)
    return rounded(rows.select("rxn", *(_scaled(c).alias(c) for c in ("forward", "reverse", "net"))))


@query(f"WITH {STOICH} SELECT rxn, species, sum(CASE WHEN side = 'P' THEN coeff ELSE -coeff END) AS nu FROM stoich GROUP BY 1, 2")
def net_stoichiometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9."""
    return rx.net_stoichiometry(stoichiometry(spark, sf_dir))


@query(f"WITH {ROP}, w AS (SELECT species, sum(nu * (forward - reverse)) AS w FROM net JOIN rop USING (rxn) GROUP BY species) SELECT species, {SCALE.format(c='w', n='rate')} FROM w")
def production_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, M10."""
    rows = rx.production_rates(stoichiometry(spark, sf_dir), _rates(spark, sf_dir))
    return rounded(rows.select("species", _scaled("rate").alias("rate")))


JAC = f"""{STOICH}, {SPECIES}, {REACTIONS},
net AS (SELECT rxn, species, sum(CASE WHEN side = 'P' THEN coeff ELSE -coeff END) AS nu FROM stoich GROUP BY 1, 2),
jt AS (SELECT rxn, s.species, side, coeff, coalesce(conc, 0) AS conc, coalesce(conc, 0) ** coeff AS term FROM stoich s LEFT JOIN species c ON s.species = c.species),
js AS (SELECT rxn, side, coalesce(product(term) FILTER (term <> 0), 1) AS rest, count(*) FILTER (term = 0) AS zeros FROM jt GROUP BY 1, 2),
jp AS (SELECT rxn, species AS wrt, sum((CASE WHEN side = 'R' THEN a_f * 900.0 ** b_f * exp(-e_f / (8.314 * 900)) WHEN reversible THEN -a_r * 900.0 ** b_r * exp(-e_r / (8.314 * 900)) ELSE 0 END)
  * (CASE WHEN conc > 0 THEN coeff * conc ** (coeff - 1) ELSE 1e-8 ** (coeff - 1) END) * (CASE WHEN zeros = 0 THEN rest / term WHEN zeros = 1 AND term = 0 THEN rest ELSE 0 END)) AS d
  FROM jt JOIN js USING (rxn, side) JOIN reactions USING (rxn) GROUP BY 1, 2),
jac AS (SELECT species, wrt, sum(nu * d) AS value FROM net JOIN jp USING (rxn) GROUP BY 1, 2)"""


@query(f"WITH {JAC} SELECT species, wrt, {SCALE.format(c='value', n='value')} FROM jac")
def rate_jacobian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse Jacobian of the rate law, on a signed log scale."""
    rows = rx.jacobian(stoichiometry(spark, sf_dir), reactions(spark, sf_dir), species(spark, sf_dir), 900.0, n=parts(spark, table(spark, sf_dir, "lineitem").count()))
    return rounded(rows.select("species", "wrt", _scaled("value").alias("value")))


@query(f"WITH {JAC}, d AS (SELECT phase, abs(value) AS d FROM jac JOIN species USING (species) WHERE species = wrt) SELECT phase, round(ln(coalesce(max(d) / min(d), 0)), 6) AS log_stiffness, coalesce(max(d) / min(d), 0) > 1000 AS stiff FROM d WHERE d > 1e-12 GROUP BY phase")
def stiffness_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: the spread of the Jacobian's diagonal, by phase."""
    known = species(spark, sf_dir)
    rows = rx.jacobian(stoichiometry(spark, sf_dir), reactions(spark, sf_dir), known, 900.0, n=parts(spark, table(spark, sf_dir, "lineitem").count()))
    return rounded(rx.stiffness(rows.join(known.select("species", "phase"), "species"), ["phase"]).select("phase", F.log("stiffness").alias("log_stiffness"), "stiff"))


@query(f"""WITH {ROP}, t AS (SELECT species, coalesce(sum(coeff * (forward - reverse)) FILTER (side = 'P'), 0) AS p, coalesce(sum(coeff * (forward - reverse)) FILTER (side = 'R'), 0) AS c, count(*) FILTER (side = 'P') AS n_p, count(*) FILTER (side = 'R') AS n_c, min(rxn) FILTER (side = 'P') AS first_p FROM stoich JOIN rop USING (rxn) GROUP BY species)
SELECT species, {SCALE.format(c='p', n='production')}, {SCALE.format(c='c', n='consumption')}, CAST(n_p AS INT) AS n_producing, CAST(n_c AS INT) AS n_consuming, first_p AS first_producing FROM t""")
def source_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production and consumption with reaction lists."""
    rows = rx.source_terms(stoichiometry(spark, sf_dir), _rates(spark, sf_dir))
    return rounded(rows.select("species", _scaled("production").alias("production"), _scaled("consumption").alias("consumption"), F.size("producing").alias("n_producing"), F.size("consuming").alias("n_consuming"), F.try_element_at("producing", F.lit(1)).alias("first_producing")))


@query(f"WITH {ROP}, h AS (SELECT n.rxn, sum(nu * h_form) AS dh FROM net n JOIN species USING (species) GROUP BY n.rxn) SELECT rxn, round(dh, 4) AS enthalpy, {SCALE.format(c='(-dh * (forward - reverse))', n='heat')} FROM h JOIN rop USING (rxn)")
def heat_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    rows = rx.heat_release(stoichiometry(spark, sf_dir), species(spark, sf_dir), _rates(spark, sf_dir))
    return rounded(rows.select("rxn", "enthalpy", _scaled("heat").alias("heat")), enthalpy=4)


@query(f"WITH {STOICH} SELECT species, CASE WHEN bool_or(side = 'R') AND bool_or(side = 'P') THEN 'intermediate' WHEN bool_or(side = 'R') THEN 'reactant' ELSE 'product' END AS role FROM stoich GROUP BY species")
def species_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, J5 as one aggregation."""
    return rx.roles(stoichiometry(spark, sf_dir))


@query(f"WITH {PAIRED} SELECT DISTINCT species FROM paired WHERE side = 'R' AND species NOT IN (SELECT species FROM paired WHERE side = 'P')")
def pure_reactants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join."""
    return rx.pure(paired(spark, sf_dir), "R")


@query(f"WITH {PAIRED} SELECT DISTINCT species FROM paired WHERE side = 'P' AND species NOT IN (SELECT species FROM paired WHERE side = 'R')")
def pure_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join."""
    return rx.pure(paired(spark, sf_dir), "P")


@query(f"WITH {STOICH} SELECT DISTINCT species FROM stoich WHERE side = 'R' AND species IN (SELECT species FROM stoich WHERE side = 'P')")
def intermediates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join."""
    return rx.intermediates(stoichiometry(spark, sf_dir))


@query(f"WITH {STOICH}, {SPECIES} SELECT rxn, species, side, coeff FROM stoich WHERE species NOT IN (SELECT species FROM species)")
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referential validation."""
    return rx.unknown_references(stoichiometry(spark, sf_dir), species(spark, sf_dir)).select("rxn", "species", "side", "coeff")


@query(f"WITH {STOICH}, {SPECIES}, d AS (SELECT DISTINCT rxn, species FROM stoich) SELECT rxn, count(*) FILTER (phase = 'gas') AS gas, count(*) FILTER (phase = 'liquid') AS liquid, count(*) FILTER (phase = 'solid') AS solid FROM d LEFT JOIN species USING (species) GROUP BY rxn")
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return rx.phase_counts(stoichiometry(spark, sf_dir), species(spark, sf_dir))


@query(f"WITH {STOICH} SELECT rxn, side FROM stoich WHERE species = 7")
def reactions_of_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """once for each side."""
    return rx.touching(stoichiometry(spark, sf_dir), 7)


@query(f"WITH {STOICH}, {REACTIONS} SELECT DISTINCT species FROM stoich JOIN reactions USING (rxn) WHERE a_f * 1200.0 ** b_f * exp(-e_f / (8.314 * 1200)) > 2e7")
def fast_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    return rx.fast_species(stoichiometry(spark, sf_dir), reactions(spark, sf_dir), 1200.0, 2e7)


@query(f"WITH {SPECIES} SELECT species, phase FROM species WHERE phase = 'gas'")
def species_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    return species(spark, sf_dir).where("phase = 'gas'").select("species", "phase")


@query(f"WITH {STOICH} SELECT DISTINCT species FROM stoich")
def all_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return rx.all_species(stoichiometry(spark, sf_dir))


EDGES = "edges AS (SELECT DISTINCT a.species AS src, b.species AS dst FROM t a JOIN t b ON a.rxn = b.rxn WHERE a.side = 'R' AND b.side = 'P' AND a.species <> b.species)"
ALL = "t AS (SELECT * FROM stoich)"


@query(f"WITH {STOICH}, {ALL}, {EDGES} SELECT src, dst FROM edges")
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1."""
    return rx.network_edges(stoichiometry(spark, sf_dir))


@query(f"WITH RECURSIVE {STOICH}, {ALL}, {EDGES}, reach(src, dst) AS (SELECT DISTINCT src, src FROM edges WHERE src % 50 = 0 UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src) SELECT src, dst FROM reach")
def network_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that has a pathway, however long, from the species whose id is divisible by 50
    (the query set; the operator takes any sources)."""
    with iterate.freed_shuffles(spark):
        edges = iterate.keep(rx.reaction_pairs(stoichiometry(spark, sf_dir)))
    pathways = rx.closure(edges, edges.where("src % 50 = 0").select("src"))
    iterate.discard(edges)
    return pathways


@query(f"""WITH {STOICH}, {REACTIONS}, t AS (SELECT * FROM stoich), {EDGES}, ro AS (SELECT species, bool_or(side = 'R') AS r, bool_or(side = 'P') AS p FROM stoich GROUP BY species)
SELECT (SELECT count(*) FROM ro) AS n_species, (SELECT count(*) FROM ro WHERE r AND NOT p) AS n_reactants, (SELECT count(*) FROM ro WHERE p AND NOT r) AS n_products, (SELECT count(*) FROM ro WHERE r AND p) AS n_intermediates, (SELECT count(*) FROM reactions) AS n_reactions, (SELECT count(*) FROM reactions WHERE reversible) AS n_reversible, (SELECT count(*) FROM edges) AS n_edges""")
def network_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return rx.network_stats(stoichiometry(spark, sf_dir), reactions(spark, sf_dir))


@query(f"""WITH {STOICH}, {REACTIONS}, t AS (SELECT rxn, side, lpad(CAST(species AS VARCHAR), 9, '0') AS name, coeff FROM stoich),
s AS (SELECT rxn, side, string_agg(CASE WHEN coeff = 1 THEN '' ELSE regexp_replace(printf('%.2f', coeff), '\\.?0+$', '') || ' ' END || 'X' || name, ' + ' ORDER BY name) AS e FROM t GROUP BY rxn, side)
SELECT r.rxn, coalesce(max(e) FILTER (side = 'R'), '') || CASE WHEN reversible THEN ' <=> ' ELSE ' => ' END || coalesce(max(e) FILTER (side = 'P'), '') AS equation FROM s JOIN reactions r USING (rxn) GROUP BY r.rxn, reversible""")
def reaction_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M58."""
    name = F.concat(F.lit("X"), F.lpad(F.col("species").cast("string"), 9, "0"))
    return rx.equations(stoichiometry(spark, sf_dir), reactions(spark, sf_dir), name)


@query("SELECT p_partkey AS id, 'C' || CASE WHEN p_size > 1 THEN CAST(p_size AS VARCHAR) ELSE '' END || 'H' || CAST(2 * p_size + 2 AS VARCHAR) || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '+' ELSE '-2' END AS formula, 3 * p_size + 2 AS atoms, CAST(2 * p_size + 2 AS INT) AS hydrogens, CAST(0 AS INT) AS nitrogens FROM part")
def chemical_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M57, A25, F2."""
    n = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("H"), 2 * n + 2, F.lit("C"), n).alias("m"), F.when(n % 3 == 0, 0).when(n % 3 == 1, 1).otherwise(-2).alias("q"))
    return rows.where(F.map_contains_key("m", F.lit("C"))).select("id", text.formula("m", "q").alias("formula"), text.atom_count("m").alias("atoms"), text.element_count("m", "H").alias("hydrogens"), text.element_count("m", "N").alias("nitrogens"))


@query("WITH y AS (SELECT l_orderkey AS cell, l_partkey, l_linenumber, l_quantity, l_suppkey, l_extendedprice, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS y, 0.002 + (l_partkey % 50) * 0.001 AS mw FROM lineitem), x AS (SELECT *, (y / mw) / sum(y / mw) OVER (PARTITION BY cell) AS x FROM y) SELECT cell, round(sum(x), 6) AS total, round(max(x), 8) AS largest, round(sum(x * mw), 12) AS mean_mw FROM x GROUP BY cell")
def mole_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.col("l_quantity") / F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))).alias("y"), (0.002 + F.col("l_partkey") % 50 * 0.001).alias("mw"))
    out = rx.mole_fractions(rows, "cell", "y", "mw")
    return rounded(out.groupBy("cell").agg(F.sum("x").alias("total"), F.max("x").alias("largest"), F.sum(F.col("x") * F.col("mw")).alias("mean_mw")), 6, largest=8, mean_mw=12)


@query("WITH y AS (SELECT l_orderkey AS cell, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS y, 500 + (l_partkey % 50) * 10.0 AS cp, (l_partkey % 50) * 0.01 AS k FROM lineitem) SELECT cell, round(sum(y * cp), 8) AS cp, round(sum(y * k), 11) AS conductivity FROM y GROUP BY cell")
def mixture_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.col("l_quantity") / F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))).alias("y"), (500 + F.col("l_partkey") % 50 * 10.0).alias("cp"), (F.col("l_partkey") % 50 * 0.01).alias("k"))
    return rounded(rows.groupBy("cell").agg(F.sum(F.col("y") * F.col("cp")).alias("cp"), F.sum(F.col("y") * F.col("k")).alias("conductivity")), 8, conductivity=11)


@query(f"WITH {P} SELECT id, round(1e9 * CASE id % 4 WHEN 0 THEN 1e-9 WHEN 1 THEN 1e-5 * exp(-(20000 * a) / (8.314 * t)) WHEN 2 THEN 1e-9 * t ** 1.5 / (1000 * a) ELSE 1e-9 * (1 + a * b + 0.5 * b * b) END, 6) AS d FROM p")
def diffusion_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14."""
    k = F.col("id") % 4
    model = F.when(k == 0, "constant").when(k == 1, "arrhenius").when(k == 2, "chapman_enskog").otherwise("concentration")
    p1 = F.when(k == 1, 20000 * F.col("a")).when(k == 2, 1000 * F.col("a")).otherwise(F.col("a"))
    d = tr.diffusivity(model, "t", "b", F.when(k == 1, 1e-5).otherwise(1e-9), p1, 0.5)
    return rounded(points(spark, sf_dir).select("id", (1e9 * d).alias("d")))


@query(f"WITH {P} SELECT id, round(-(2.0 * (a - 1)), 9) AS fx, round(-(2.0 * (b - 2)), 9) AS fy, round(sqrt(4 * (a - 1) * (a - 1) + 4 * (b - 2) * (b - 2)), 9) AS size, round(2.0 * (a - b), 9) AS source, round((a + b + 1) / 3, 9) AS mean_d, (abs(a - b) < 1e-12 AND abs(b - 1) < 1e-12) AS isotropic, round(-(a * (a - 1)), 9) AS ax FROM p")
def fick_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15, M16, M18."""
    a, b = F.col("a"), F.col("b")
    fx, fy = tr.fick_flux(2.0, a - 1, b - 2)
    return rounded(points(spark, sf_dir).select("id", fx.alias("fx"), fy.alias("fy"), tr.magnitude(fx, fy).alias("size"), (2.0 * (a - b)).alias("source"), tr.tensor_mean(a, b, 1.0).alias("mean_d"), tr.tensor_isotropic(a, b, 1.0).alias("isotropic"), tr.fick_flux([a], a - 1)[0].alias("ax")), 9)


@query(f"""WITH {P}, d AS (SELECT id, a, b, b - 2.5 AS v, CASE WHEN id % 9 = 0 THEN 0.0 ELSE a / 100 END AS d FROM p)
SELECT id, round(sqrt(a / 100 * 10), 6) AS length, CASE WHEN d <= 0 THEN 'Infinity'::DOUBLE ELSE round(b * 2 / d, 6) END AS peclet, CASE WHEN d <= 0 THEN 'Infinity'::DOUBLE ELSE round(0.001 / d, 6) END AS schmidt, round(a / 0.7, 6) AS turbulent, CASE WHEN v = 0 THEN 1.0 ELSE round(2 * d / abs(v), 6) END AS spacing, round(v * 0.01 / 0.1, 6) AS courant, CASE WHEN v < 1e-15 THEN 1e10 ELSE round(0.1 / v, 6) END AS max_dt,
CASE WHEN d <= 0 OR b * 2 / d > 10 THEN 'advection' WHEN b * 2 / d < 0.1 THEN 'diffusion' ELSE 'mixed' END AS regime, round(least(CASE WHEN d > 0 THEN 0.01 / (2 * d) ELSE 1e300 END, CASE WHEN b > 0 THEN 0.1 / b ELSE 1e300 END) * 0.9, 6) AS stable_dt, round(a / 100 * 0.01 * (1 / 0.01 + 1 / 0.04), 10) AS cfl2, CASE WHEN d <= 0 THEN 1e10 ELSE round(a * 2 / d, 6) END AS biot FROM d""")
def dimensionless_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17, M21, M23, M26-M29."""
    rows = points(spark, sf_dir).withColumns({"v": F.col("b") - 2.5, "d": F.when(F.col("id") % 9 == 0, 0.0).otherwise(F.col("a") / 100)})
    pe = tr.peclet("b", 2.0, "d")
    out = rows.select("id", tr.diffusion_length(F.col("a") / 100, 10.0).alias("length"), pe.alias("peclet"), tr.schmidt(0.001, "d").alias("schmidt"), tr.turbulent_diffusivity("a").alias("turbulent"), F.when(F.col("v") == 0, 1.0).otherwise(tr.optimal_spacing("v", "d")).alias("spacing"), tr.courant("v", 0.01, 0.1).alias("courant"), tr.max_advective_dt("v", 0.1).alias("max_dt"), tr.regime(pe).alias("regime"), tr.stable_dt(0.1, "d", "b").alias("stable_dt"), tr.diffusion_cfl(F.col("a") / 100, 0.01, 0.1, 0.2).alias("cfl2"), tr.biot("a", 2.0, "d").alias("biot"))
    return out.select(*(F.when(F.abs(c) == float("inf"), F.col(c)).otherwise(F.round(c, 10 if c == "cfl2" else 6)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(f"""WITH {P}, g AS (SELECT id, a, b, a - 1 AS gx, b - 2 AS gy, b - 1.5 AS l FROM p), s AS (SELECT *, a + 0.5 * 0.1 * 0.3 * l AS c1 FROM g), u AS (SELECT *, c1 - 0.1 * (2 * gx - 1 * gy) AS c2 FROM s)
SELECT id, round(2 * gx - gy, 9) AS advection, round(0.7 + 2 * gx - gy, 9) AS material, round(-(2 * gx - gy) + 0.3 * l + 0.25, 9) AS rhs, round(a - 0.1 * (2 * gx - gy), 9) AS adv_step, round(a + 0.1 * 0.3 * l, 9) AS diff_step, round(c2 + 0.5 * 0.1 * 0.3 * l, 9) AS strang FROM u""")
def transport_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M20, M22, M24."""
    v, g, lap = (2.0, -1.0), (F.col("a") - 1, F.col("b") - 2), F.col("b") - 1.5
    return rounded(points(spark, sf_dir).select("id", tr.advection_term(v, g).alias("advection"), tr.material_derivative(0.7, v, g).alias("material"), tr.adr_rhs(v, g, 0.3, lap, 0.25).alias("rhs"), tr.advection_step("a", 0.1, v, g).alias("adv_step"), tr.diffusion_step("a", 0.1, 0.3, lap).alias("diff_step"), tr.strang_step("a", 0.1, v, g, 0.3, lap).alias("strang")), 9)


@query(f"WITH {P} SELECT id, round(CASE id % 3 WHEN 0 THEN a WHEN 1 THEN -b / (a / 10) ELSE -2 * (a - 0.5) / (a / 10) END, 6) AS gradient, round(a - 0.01 * b * (a - 1) / 0.1, 9) AS outflow, round(-0.3 * (a - 1) + 2 * a, 9) AS flux FROM p")
def boundary_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M25, M26."""
    kind = F.when(F.col("id") % 3 == 0, "dirichlet").when(F.col("id") % 3 == 1, "neumann").otherwise("robin")
    return rounded(points(spark, sf_dir).select("id", tr.boundary_gradient(kind, "a", F.col("a") / 10, "a", "b", 2.0, 0.5).alias("gradient"), tr.convective_outflow("a", 1.0, "b", 0.01, 0.1).alias("outflow"), tr.total_flux("a", F.col("a") - 1, 0.3, 2.0).alias("flux")), 6, outflow=9, flux=9)


@query(f"""WITH {P}, m AS (SELECT id, a * 0.5 AS u, b * 0.2 AS v, a AS p, b AS q FROM p)
SELECT id, round(-u * v * v + 0.04 * (1 - u), 12) AS gs_u, round(u * v * v - 0.1 * v, 12) AS gs_v, round(p - (q + 1) * u + u * u * v, 12) AS br_u, round(q * u - u * u * v, 12) AS br_v, round(p - u + u * u * v, 12) AS sc_u, round(q - u * u * v, 12) AS sc_v, round(0.5 * (u - v) + p - u + u * u * v, 12) AS rhs FROM m""")
def reaction_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M31-M34."""
    rows = points(spark, sf_dir).select("id", (F.col("a") * 0.5).alias("u"), (F.col("b") * 0.2).alias("v"), F.col("a").alias("p"), F.col("b").alias("q"))
    gs, br, sc = models.gray_scott("u", "v", 0.04, 0.06), models.brusselator("u", "v", "p", "q"), models.schnakenberg("u", "v", "p", "q")
    return rounded(rows.select("id", *(c.alias(n) for n, c in zip(("gs_u", "gs_v", "br_u", "br_v", "sc_u", "sc_v"), (*gs, *br, *sc), strict=True)), models.rhs(0.5, F.col("u") - F.col("v"), sc[0]).alias("rhs")), 12)


@query(f"""WITH {P}, e AS (SELECT id, a / 10 AS p, b AS q, a / 10 + b AS u, b / ((a / 10 + b) * (a / 10 + b)) AS v FROM p),
j AS (SELECT id, u, v, -1 + 2 * u * v AS fu, u * u AS fv, -2 * u * v AS gu, -(u * u) AS gv, q > 1 + p * p AS osc FROM e), t AS (SELECT *, fu + gv AS tr, fu * gv - fv * gu AS det, 40 * fu + gv AS c FROM j), k AS (SELECT *, tr < 0 AND det > 0 AND c > 0 AND c * c - 160 * det > 0 AS forms FROM t)
SELECT id, round(u, 6) AS u, round(v, 6) AS v, round(tr, 6) AS trace, round(det, 6) AS determinant, 40.0::DOUBLE AS diffusion_ratio, tr < 0 AND det > 0 AS stable_without_diffusion, c > 0 AND c * c - 160 * det > 0 AS unstable_with_diffusion, forms AS can_form_patterns, round(CASE WHEN forms THEN sqrt(greatest(c, 0) / 80) ELSE 0 END, 6) AS critical_wavenumber, round(CASE WHEN forms THEN 2 * pi() / sqrt(greatest(c, 1e-300) / 80) ELSE 0 END, 6) AS wavelength, osc AS oscillatory FROM k""")
def turing_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M35, M36, M37 for the Schnakenberg model, M33's oscillation test."""
    rows = points(spark, sf_dir).select("id", (F.col("a") / 10).alias("p"), F.col("b").alias("q"))
    u, v = models.equilibrium("schnakenberg", "p", "q")
    t = models.turing(1.0, 40.0, *models.jacobian("schnakenberg", "p", "q"))
    return rounded(rows.select("id", u.alias("u"), v.alias("v"), *(c.alias(n) for n, c in t.items()), models.wavelength(t["critical_wavenumber"]).alias("wavelength"), models.oscillatory("p", "q").alias("oscillatory")))


@query(f"WITH {P}, k AS (SELECT id, id % 90 / 1000.0 AS f, 0.03 + p.id % 70 / 1500.0 AS k FROM p) SELECT id, CASE WHEN f < 0.03 AND k < 0.06 THEN 'Spots' WHEN f < 0.04 AND k > 0.06 THEN 'Stripes' WHEN f > 0.05 AND k < 0.065 THEN 'Spirals' WHEN f > 0.06 AND k > 0.06 THEN 'Chaos' ELSE 'Uniform' END AS regime FROM k")
def pattern_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M38."""
    return points(spark, sf_dir).select("id", models.regime_name(F.col("id") % 90 / 1000.0, 0.03 + F.col("id") % 70 / 1500.0).alias("regime"))


K_L = "0.5 / 1e13 * sqrt(2 * pi() * (0.02 / 6.022e23) * 1.380649e-23 * t) * exp(e / (8.314 * t))"


@query(f"""WITH {P}, s AS (SELECT id, t, a, b, 1000 * a AS pr, b / 6 AS th, 100000 + 2000 * b AS e FROM p), k AS (SELECT *, pr / sqrt(2 * pi() * (0.028 / 6.022e23) * 1.380649e-23 * t) / 1.5e19 AS z, {K_L} AS kl FROM s)
SELECT id, round(z, 4) AS collisions, round(0.8 * z * greatest(1 - th, 0) ** 1, 4) AS adsorption, round(log10(1e13 * exp(-e / (8.314 * t)) * th), 6) AS log_desorption, round(log10(kl), 6) AS log_k, round(kl * pr / (1 + kl * pr), 9) AS langmuir, round(log10(1 / kl), 6) AS log_half, round(50 * (pr / 3000) / ((1 - pr / 3000) * (1 + 49 * (pr / 3000))), 6) AS bet, round(0.5 * pr ** (1 / 2.0), 6) AS freundlich FROM k""")
def adsorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M39-M42."""
    rows = points(spark, sf_dir).withColumns({"pr": 1000 * F.col("a"), "th": F.col("b") / 6, "e": 100000 + 2000 * F.col("b")})
    kl = surface.langmuir_constant(0.5, 0.02, "e", "t")
    return rounded(rows.select("id", surface.collision_rate("pr", "t", 0.028, 1.5e19).alias("collisions"), surface.adsorption_rate("pr", "t", 0.028, 0.8, "th", 1.5e19).alias("adsorption"), F.log10(surface.desorption_rate("e", "t", "th")).alias("log_desorption"), F.log10(kl).alias("log_k"), surface.langmuir_coverage(kl, "pr").alias("langmuir"), F.log10(surface.langmuir_pressure(kl, 0.5)).alias("log_half"), surface.bet_coverage(50.0, "pr", 3000.0).alias("bet"), surface.freundlich(0.5, "pr", 2.0).alias("freundlich")), 6, collisions=4, adsorption=4, langmuir=9)


@query(f"""WITH {P}, k AS (SELECT id, b / 6 AS th, a, 1e6 * exp(-(30000 + 20000 * b / 6) / (8.314 * t)) AS k FROM p)
SELECT id, round(ln(k), 6) AS log_k, round(ln(1 + k * th ** 1 * 0.4 ** 1), 6) AS lh, round(ln(1 + k * 1000 * a * greatest(1 - th, 0) * greatest(1 - th, 0)), 6) AS dissociative, round(least(greatest(th * 1.3 - 0.1, 0), 1), 9) AS clamped, round(1e5 * th * 1.5e19 / 6.022e23, 6) AS concentration, th >= 1 - 1e-6 AS saturated FROM k""")
def surface_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M43, M44, M46."""
    th = F.col("b") / 6
    k = surface.rate_constant(1e6, 30000.0, "t", 20000.0, th)
    return rounded(points(spark, sf_dir).select("id", F.log(k).alias("log_k"), F.log(1 + k * th * 0.4).alias("lh"), F.log(1 + surface.dissociative_rate(k, 1000 * F.col("a"), th)).alias("dissociative"), surface.clamp_coverage(th * 1.3 - 0.1).alias("clamped"), (1e5 * surface.surface_concentration(th, 1.5e19)).alias("concentration"), surface.saturated(th).alias("saturated")), 6, clamped=9)


@query("SELECT l_orderkey AS cell, round(sum(l_discount * (1 + l_linenumber % 2)), 6) AS coverage, round(1 - sum(l_discount * (1 + l_linenumber % 2)), 6) AS vacant FROM lineitem GROUP BY 1")
def surface_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    total = F.sum(F.col("l_discount") * (1 + F.col("l_linenumber") % 2))
    return rounded(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(total.alias("coverage"), (1 - total).alias("vacant")))


@query("WITH s AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN value ELSE 0 END AS rate FROM events) SELECT user_id, arg_min(event_id, struct_pack(a := rate, b := event_id)) AS event_id, min(rate) AS tof FROM s GROUP BY user_id")
def rate_limiting_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps, clicks and views as rated mechanisms."""
    mechanism = F.when(F.col("event_type") == "click", "langmuir_hinshelwood").when(F.col("event_type") == "view", "associative").otherwise("dissociative")
    return rx.rate_limiting(table(spark, sf_dir, "events").withColumn("mechanism", mechanism), "user_id", "event_id", "value", "mechanism")


@query(f"""WITH {P}, q AS (SELECT id, a, b, id / 100.0 AS s FROM p) SELECT id, round(10 * sin(2 * pi() * 1.5 * s + 0), 6) AS sinusoid, round(CASE WHEN s <= 0 THEN 5 WHEN s >= 10 THEN 100 ELSE 5 + 95 * s / 10 END, 6) AS ramp, CASE WHEN s < 4 THEN 1.0 ELSE 2.0 END AS step, round(4 * 3.0 * (b / 6) * (1 - b / 6), 6) AS parabola, round(1000 * exp(-0.1 * s), 6) AS decay, round(2 + a * sin(2 * pi() * 0.5 * s + 0), 6) AS pulsating, round(7 * exp(-((a - 1) * (a - 1) + (b - 2) * (b - 2) + 0) / (2 * 0.5 * 0.5)), 6) AS gaussian, 2.0 AS alpha, 0.5 AS beta, round(2.0 * a, 9) AS gamma, b < 1e-10 AND 2.0 >= 1e-10 AS dirichlet_like FROM q""")
def boundary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M47, M48, M49."""
    s = F.col("id") / 100.0
    alpha, beta, gamma = boundary.robin("convection", 2.0, 0.5, "a")
    return rounded(points(spark, sf_dir).select("id", boundary.sinusoid(s, 10.0, 1.5).alias("sinusoid"), boundary.ramp(s, 5.0, 100.0, 10.0).alias("ramp"), boundary.step(s, 1.0, 2.0, 4.0).alias("step"), boundary.parabola("b", 3.0, 6.0).alias("parabola"), boundary.decay(s, 1000.0, 0.1).alias("decay"), boundary.pulsating(s, 2.0, "a", 0.5).alias("pulsating"), boundary.gaussian("a", "b", 0.0, 7.0, 1.0, 2.0, 0.0, 0.5).alias("gaussian"), alpha.alias("alpha"), beta.alias("beta"), gamma.alias("gamma"), boundary.dirichlet_like(alpha, "b").alias("dirichlet_like")), 6, gamma=9)


@query(f"""WITH {P}, q AS (SELECT id, a, b, id / 100.0 AS s FROM p) SELECT id, round(CASE id % 6 WHEN 0 THEN a WHEN 1 THEN a * sin(2 * pi() * 0.3 * s + 0) WHEN 2 THEN CASE WHEN s <= 0 THEN a WHEN s >= 5 THEN b ELSE a + (b - a) * s / 5 END WHEN 3 THEN CASE WHEN s < 7 THEN a ELSE b END WHEN 4 THEN 4 * a * (b / 6) * (1 - b / 6) ELSE a * exp(-0.2 * s) END, 6) AS value FROM q""")
def boundary_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of many kinds with parameter arrays."""
    k, a, b = F.col("id") % 6, F.col("a"), F.col("b")
    kind = F.element_at(F.array(*map(F.lit, ("constant", "sinusoid", "ramp", "step", "parabola", "decay"))), (k + 1).cast("int"))
    params = F.when(k == 1, F.array(a, F.lit(0.3))).when(k == 2, F.array(a, b, F.lit(5.0))).when(k == 3, F.array(a, b, F.lit(7.0))).when(k == 4, F.array(a, F.lit(6.0))).when(k == 5, F.array(a, F.lit(0.2))).otherwise(F.array(a))
    return rounded(points(spark, sf_dir).select("id", boundary.evaluate(kind, "b", F.col("id") / 100.0, params).alias("value")))


@query(f"WITH {P} SELECT id, round(a * 2 + b * 3 + 4, 6) AS dot, round(b * 1 - 2 * 3, 6) AS cx, round(sqrt(a * a + b * b + 4), 6) AS norm, round(a / sqrt(a * a + b * b + 4), 6) AS nx, round(a + 2, 6) AS sx, round((b - 3) / 2, 6) AS dy FROM p")
def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M51."""
    rows = points(spark, sf_dir).select("id", vectors.vector("a", "b", 2.0).alias("u"), vectors.vector(2.0, 3.0, 2.0).alias("v"), vectors.vector(0.0, 3.0, 1.0).alias("w"))
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    return rounded(rows.select("id", vectors.dot(u, v).alias("dot"), vectors.cross(u, w)["x"].alias("cx"), vectors.norm(u).alias("norm"), vectors.normalized(u)["x"].alias("nx"), vectors.add(u, v)["x"].alias("sx"), vectors.divide(vectors.subtract(u, v), 2.0)["y"].alias("dy")))


@query(f"WITH {P} SELECT id, round(a * 0.01, 9) AS metres, round(b * 60, 9) AS seconds, round(t + 273.15, 9) AS kelvin, round(a * 0.01 / (b * 60), 12) AS speed, round(a * 0.001 * 1.5 * 1.5, 12) AS joule, abs(a * 0.01 - a * 0.001) < 0.01 AS near FROM p")
def physical_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions are checked while this is built."""
    q = units.quantity
    length, time, mass = q("a", "cm"), q("b", "min"), q("a", "g")
    v = q(1.5, "m") / q(1.0, "s")
    energy = mass * v * v
    assert energy.dim == units.UNITS["J"][2]
    return rounded(points(spark, sf_dir).select("id", length.value.alias("metres"), time.value.alias("seconds"), q("t", "degC").value.alias("kelvin"), (length / time).value.alias("speed"), energy.value.alias("joule"), length.equals(q("a", "mm"), 0.01).alias("near")), 9, speed=12, joule=12)


@query("WITH k AS (SELECT event_id, regexp_extract(props, '\"([a-z_]+)\"', 1) AS key, regexp_extract(props, ': *([^}]*)', 1) AS raw FROM events) SELECT event_id, 'APP_' || upper(translate(key || '.x-y', '.-', '__')) AS env, CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN 'int' WHEN lower(raw) IN ('true', 'false', 'yes', 'no') THEN 'bool' ELSE 'string' END AS type, coalesce(try_cast(raw AS BIGINT), -1) AS n, CAST(len(string_split('1, 2,' || raw, ',')) AS INT) AS items FROM k")
def typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M59, M60, IO5."""
    rows = table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", '"([a-z_]+)"', 1).alias("key"), F.regexp_extract("props", ": *([^}]*)", 1).alias("raw"))
    return rows.select("event_id", text.key_to_env(F.concat("key", F.lit(".x-y")), "APP_").alias("env"), text.literal_type("raw").alias("type"), text.to_int("raw", -1).alias("n"), F.size(text.parse_array(F.concat(F.lit("[1, 2,"), "raw", F.lit("]")))).alias("items"))


DECAY = "(1 - 0.1 * k + 0.1 * k * 0.1 * k / 2 - (0.1 * k) ** 3 / 6 + (0.1 * k) ** 4 / 24)"


@query(f"WITH {P}, d AS (SELECT id, a, b AS k FROM p) SELECT id, round(a * {DECAY} ** 3, 9) AS y FROM d")
def ode_decay_rk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of RK4 for dy/dt = -k y, all cells of a batch at once."""
    return rounded(iterate.decay(points(spark, sf_dir), "id", "a", "b", 0.1, 3, "rk4"), 9)


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS cell, p_retailprice / 1000 AS y0, ln(1 + p_size) AS k FROM part), n AS (SELECT cell, y0, k, unnest(range(0, 8)) AS step FROM c)
SELECT cell, CAST(step AS INTEGER) AS step, round(CASE WHEN step = 7 THEN 2.0 ELSE step * 0.3 END, 9) AS t, round(y0 * (1 - k * 0.3 + (k * 0.3) ** 2 / 2 - (k * 0.3) ** 3 / 6 + (k * 0.3) ** 4 / 24) ** least(step, 6) * CASE WHEN step = 7 THEN 1 - k * 0.2 + (k * 0.2) ** 2 / 2 - (k * 0.2) ** 3 / 6 + (k * 0.2) ** 4 / 24 ELSE 1 END, 8) AS y FROM n""")
def rk4_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trajectory of every cell, all cells of a batch at once, the last step
    shortened."""
    rows = trajectory.stepped(_decaying(spark, sf_dir), "y0", "k", _decay, 2.0, 0.3, clamp=False)
    return rounded(rows.select("cell", "step", F.round("t", 9).alias("t"), F.element_at("state", 1).alias("y")), 8, t=9)


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS cell, p_retailprice / 1000 AS y0, ln(1 + p_size) AS k FROM part),
s(cell, k, n, t, y, dt, before, accepted) AS (
  SELECT cell, k, 0, CAST(0 AS DOUBLE), y0, CAST(0.5 AS DOUBLE), CAST(0 AS DOUBLE), 0 FROM c
  UNION ALL
  SELECT cell, k, n + 1, CASE WHEN err <= 1 THEN t + h ELSE t END, CASE WHEN err <= 1 THEN heun ELSE y END,
    least(1.0, greatest(1e-12, h * CASE WHEN err <= 1 THEN least(5.0, greatest(0.2, 0.9 * (1 / greatest(err, 1e-10)) ** 0.35 * (CASE WHEN before > 0 THEN greatest(err, 1e-10) / before ELSE 1 END) ** (-0.2))) ELSE 0.2 END)),
    CASE WHEN err <= 1 THEN err ELSE before END, accepted + CASE WHEN err <= 1 THEN 1 ELSE 0 END
  FROM (SELECT *, abs(heun - euler) / (1e-6 + 1e-2 * greatest(abs(y), abs(heun))) AS err FROM (SELECT *, y + h / 2 * (-k * y - k * euler) AS heun FROM (SELECT *, y + h * (-k * y) AS euler FROM (SELECT *, least(dt, 2.0 - t) AS h FROM s WHERE 2.0 - t > 2e-12)))))
SELECT cell, max(n) AS attempts, max(accepted) AS accepted, round(arg_max(y, n), 6) AS y FROM s GROUP BY cell""")
def controlled_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error-controlled trajectories with their accepted and rejected attempts."""
    rows = trajectory.adapted(_decaying(spark, sf_dir), "y0", "k", _decay, 2.0, 0.5, rel_tol=1e-2)
    out = rows.groupBy("cell").agg(F.max("attempt").alias("attempts"), F.count_if("accepted").cast("int").alias("accepted"), F.max_by(F.element_at("state", 1), "attempt").alias("y"))
    return rounded(out)


def _decay(t, y, p):
    return -p * y


def _decaying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, y0, k): a concentration that decays, and its rate, as arrays of one."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), F.array(F.col("p_retailprice") / 1000).alias("y0"), F.array(F.log(1 + F.col("p_size"))).alias("k"))
