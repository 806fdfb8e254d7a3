"""Queries on scalar fields: statistics, stencils, norms, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import initial
from ..functions import transport as tr
from ..operators import norms, patterns, stencils
from ..session import table
from .bindings import FIELD, GRID2, GRID3, field, grid2, grid3
from .registry import query, rounded

ACF_JOIN = """c AS (SELECT run, i, v - avg(v) OVER (PARTITION BY run) AS c, count(*) OVER (PARTITION BY run) AS n, var_pop(v) OVER (PARTITION BY run) AS variance FROM field),
acf AS (SELECT a.run, b.i - a.i AS lag, sum(a.c * b.c) / (max(a.n - (b.i - a.i)) * max(a.variance)) AS r FROM c a JOIN c b ON a.run = b.run AND b.i > a.i AND b.i - a.i < least(a.n // 4, 50) WHERE a.variance >= 1e-15 GROUP BY 1, 2),
peaks AS (SELECT run, lag, r, lag(r) OVER (PARTITION BY run ORDER BY lag) AS before, lead(r) OVER (PARTITION BY run ORDER BY lag) AS after FROM acf),
wave AS (SELECT f.run, coalesce(2.0 * min(p.lag), 0.0) AS wavelength FROM (SELECT DISTINCT run FROM field) f LEFT JOIN (SELECT * FROM peaks WHERE before < r AND r > after AND r > 0) p ON f.run = p.run GROUP BY f.run)"""

CORR = """nxt AS (SELECT run, v, v - avg(v) OVER (PARTITION BY run) AS c, i FROM field),
corr AS (SELECT run, CASE WHEN count(*) > 1 AND var_pop(v) >= 1e-15 THEN coalesce(sum(c * d), 0) / ((count(*) - 1) * var_pop(v)) ELSE 0.0 END AS correlation FROM (SELECT *, lead(c) OVER (PARTITION BY run ORDER BY i) AS d FROM nxt) GROUP BY run)"""

SYM = """sized AS (SELECT run, i, v, count(*) OVER (PARTITION BY run) AS n FROM field),
sym AS (SELECT s.run, CASE WHEN coalesce(max(m.norm), 0) < 1e-15 THEN 1.0 ELSE 1 - sqrt(max(m.diff) / max(m.norm)) END AS symmetry FROM sized s LEFT JOIN (SELECT a.run, sum((a.v - b.v) * (a.v - b.v)) AS diff, sum(a.v * a.v + b.v * b.v) AS norm FROM sized a JOIN sized b ON a.run = b.run AND b.i = a.n - 1 - a.i WHERE a.i < a.n // 2 GROUP BY a.run) m ON s.run = m.run GROUP BY s.run)"""

ENT = """lim AS (SELECT run, v, min(v) OVER (PARTITION BY run) AS lo, max(v) OVER (PARTITION BY run) AS hi FROM field),
bins AS (SELECT run, CASE WHEN hi - lo >= 1e-15 THEN floor((v - lo) / (hi - lo) * 19) ELSE 0 END AS bin, count(*) AS c FROM lim GROUP BY 1, 2),
ent AS (SELECT run, sum(-p * ln(p)) AS entropy FROM (SELECT run, c / sum(c) OVER (PARTITION BY run) AS p FROM bins) GROUP BY run)"""


@query(f"""WITH {FIELD}, basic AS (SELECT run, count(*) AS n, avg(v) AS mean, var_pop(v) AS variance, max(v) - min(v) AS amplitude, sum(v * v) AS energy FROM field GROUP BY run),
{CORR}, {ACF_JOIN}, {SYM}, {ENT}
SELECT run, n, round(mean, 6) AS mean, round(variance, 6) AS variance, round(amplitude, 6) AS amplitude, round(energy, 4) AS energy, round(correlation, 6) AS correlation, wavelength, round(symmetry, 6) AS symmetry, round(entropy, 6) AS entropy,
CASE WHEN variance < 1.0e-6 THEN 'UNIFORM' WHEN wavelength < 1.0e-6 AND variance > 0.01 THEN 'OSCILLATORY' WHEN amplitude > 0.5 AND correlation < 0.3 THEN 'SPOTS' WHEN wavelength > 0 AND correlation > 0.5 THEN 'STRIPES' WHEN symmetry > 0.8 AND correlation > 0.3 THEN 'HEXAGONS' WHEN correlation > 0.2 AND correlation < 0.5 THEN 'LABYRINTH' WHEN variance > 0.1 AND correlation < 0.2 THEN 'CHAOTIC' ELSE 'UNIFORM' END AS pattern
FROM basic JOIN corr USING (run) JOIN wave USING (run) JOIN sym USING (run) JOIN ent USING (run)""")
def pattern_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric and the class of each run."""
    return rounded(patterns.analyze(field(spark, sf_dir).select("run", "i", "v")), energy=4)


@query(f"WITH {FIELD} SELECT run, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(max(v) - min(v), 6) AS amplitude, round(sum(v * v), 4) AS energy, count(*) AS n FROM field GROUP BY run")
def field_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2."""
    return rounded(patterns.basics(field(spark, sf_dir)), energy=4)


@query(f"WITH {FIELD}, {CORR} SELECT run, round(correlation, 6) AS correlation FROM corr")
def field_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return rounded(patterns.correlation(field(spark, sf_dir)))


@query(f"WITH {FIELD}, {ENT} SELECT run, round(entropy, 6) AS entropy FROM ent")
def field_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return rounded(patterns.entropy(field(spark, sf_dir)))


@query(f"WITH {FIELD}, {SYM} SELECT run, round(symmetry, 6) AS symmetry FROM sym")
def field_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    return rounded(patterns.symmetry(field(spark, sf_dir)))


@query(f"WITH {FIELD}, {ACF_JOIN} SELECT run, CAST(lag AS INT) AS lag, round(r, 6) AS r FROM acf")
def field_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    acf = patterns.autocorrelation(field(spark, sf_dir))
    return rounded(acf.select("run", F.posexplode("acf").alias("lag", "r")).where("lag > 0 and r is not null"))


@query(f"WITH {FIELD}, {ACF_JOIN} SELECT run, wavelength FROM wave")
def field_wavelength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant wavelength."""
    return patterns.dominant_wavelength(field(spark, sf_dir))


@query(f"WITH {FIELD} SELECT run, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median FROM field GROUP BY run")
def summary_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return rounded(patterns.statistics(field(spark, sf_dir)))


@query(f"WITH {FIELD} SELECT run, i, round(abs(d) / 0.5, 6) AS gradient FROM (SELECT run, i, lead(v) OVER (PARTITION BY run ORDER BY i) - v AS d FROM field) WHERE d IS NOT NULL")
def gradient_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return rounded(patterns.gradient(field(spark, sf_dir), spacing=0.5))


@query(f"WITH {FIELD} SELECT run, max(abs(v - v * (1 + w / 1e4))) < 0.02 AS stable FROM field GROUP BY run")
def field_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    rows = field(spark, sf_dir)
    return patterns.stable(rows, rows.withColumn("v", F.col("v") * (1 + F.col("w") / 1e4)), 0.02)


@query(f"WITH {FIELD}, lim AS (SELECT run, v, min(v) OVER (PARTITION BY run) AS lo, max(v) OVER (PARTITION BY run) AS hi FROM field) SELECT run, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 30), 29) ELSE 0 END AS INT) AS bin, count(*) AS count FROM lim GROUP BY 1, 2")
def field_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 bins."""
    return patterns.histogram(field(spark, sf_dir), 30)


@query("SELECT CAST(event_type AS VARCHAR) AS event_type, date_trunc('day', ts) AS day, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(sum(value) * 0.25, 4) AS mass FROM events GROUP BY 1, 2")
def field_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, spread and total of a field over time."""
    out = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.sum("value") * 0.25).alias("mass"))
    return rounded(out, mass=4)


LAP = "(coalesce(lead(v) OVER g, {r}) - 2 * v + coalesce(lag(v) OVER g, {l})) / 0.01"


@query(f"WITH {FIELD} SELECT run, i, round((lead(v) OVER g - 2 * v + lag(v) OVER g) / 0.01, 6) AS lap FROM field WINDOW g AS (PARTITION BY run ORDER BY i)")
def laplacian_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null at the ends."""
    return rounded(stencils.laplacian(field(spark, sf_dir), 1, 0.1).select("run", "i", "lap"))


@query(f"WITH {FIELD} SELECT run, i, round({LAP.format(l='0.5', r='2.0')}, 6) AS dirichlet, round({LAP.format(l='v - 0.3 * 0.1', r='v + 0.7 * 0.1')}, 6) AS neumann, round({LAP.format(l='last_value(v) OVER h', r='first_value(v) OVER h')}, 6) AS periodic FROM field WINDOW g AS (PARTITION BY run ORDER BY i), h AS (PARTITION BY run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def laplacian_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ghost values by boundary condition."""
    out = field(spark, sf_dir)
    for name, how in (("dirichlet", {"left": 0.5, "right": 2.0}), ("neumann", {"left": 0.3, "right": 0.7}), ("periodic", {})):
        out = stencils.laplacian(out, 1, 0.1, name, **how).withColumnRenamed("lap", name)
    return rounded(out.select("run", "i", "dirichlet", "neumann", "periodic"))


@query(f"WITH {FIELD} SELECT run, i, round(v + 1e-3 * 0.2 * coalesce((lead(v) OVER g - 2 * v + lag(v) OVER g) / 0.01, 0), 6) AS v FROM field WINDOW g AS (PARTITION BY run ORDER BY i)")
def diffusion_step_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One explicit Euler step."""
    return rounded(stencils.diffusion_step(field(spark, sf_dir), 1e-3, 0.2, 1, 0.1).select("run", "i", "v"))


@query(f"WITH {GRID2} SELECT i, j, round(v + 1e-3 * 0.2 * coalesce((lead(v) OVER x - 2 * v + lag(v) OVER x) / 0.01 + (lead(v) OVER y - 2 * v + lag(v) OVER y) / 0.04, 0), 6) AS v FROM grid2 WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j)")
def diffusion_step_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-point step."""
    return rounded(stencils.diffusion_step(grid2(spark, sf_dir), 1e-3, 0.2, 2, (0.1, 0.2)).select("i", "j", "v"))


@query(f"WITH {GRID3} SELECT run, i, j, k, round(v + 1e-3 * 0.2 * coalesce((lead(v) OVER x - 2 * v + lag(v) OVER x) / 0.01 + (lead(v) OVER y - 2 * v + lag(v) OVER y) / 0.04 + (lead(v) OVER z - 2 * v + lag(v) OVER z) / 0.09, 0), 6) AS v FROM grid3 WINDOW x AS (PARTITION BY run, j, k ORDER BY i), y AS (PARTITION BY run, i, k ORDER BY j), z AS (PARTITION BY run, i, j ORDER BY k)")
def diffusion_step_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-point step."""
    return rounded(stencils.diffusion_step(grid3(spark, sf_dir), 1e-3, 0.2, 3, (0.1, 0.2, 0.3)).select("run", "i", "j", "k", "v"))


@query(f"""WITH {GRID2} SELECT i, j, round(coalesce(lead(v) OVER x, first_value(v) OVER hx) + coalesce(lag(v) OVER x, last_value(v) OVER hx) + coalesce(lead(v) OVER y, first_value(v) OVER hy) + coalesce(lag(v) OVER y, last_value(v) OVER hy) - 4 * v, 6) AS lap FROM grid2
WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j), hx AS (PARTITION BY j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), hy AS (PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def laplacian_periodic_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic five-point Laplacian, unit spacing."""
    return rounded(stencils.laplacian(grid2(spark, sf_dir), 2, 1.0, "periodic").select("i", "j", "lap"))


@query(f"""WITH {FIELD}, n AS (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM field),
b AS (SELECT run, i, v, i = 0 AS f, i = n - 1 AS l, lead(v) OVER g AS r, lag(v) OVER g AS p, max(CASE WHEN i = n - 2 THEN v END) OVER (PARTITION BY run) AS pl, max(CASE WHEN i = 1 THEN v END) OVER (PARTITION BY run) AS pr FROM n WINDOW g AS (PARTITION BY run ORDER BY i))
SELECT run, i, CASE WHEN f THEN 1.5 WHEN l THEN 2.5 ELSE v END AS dirichlet, CASE WHEN f THEN coalesce(r, v) WHEN l THEN coalesce(p, v) ELSE v END AS neumann, CASE WHEN f THEN coalesce(pl, v) WHEN l THEN coalesce(pr, v) ELSE v END AS periodic FROM b""")
def boundary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    rows = field(spark, sf_dir).select("run", "i", "v")
    out = rows.select("run", "i")
    for kind, how in (("dirichlet", {"left": 1.5, "right": 2.5}), ("neumann", {}), ("periodic", {})):
        out = out.join(stencils.apply_boundary(rows, kind, **how).withColumnRenamed("v", kind), ["run", "i"])
    return out


CONV = """f AS (SELECT run, i, v, w - 2 AS u FROM field),
n AS (SELECT *, lag(v) OVER g AS vl, lead(v) OVER g AS vr, lag(u) OVER g AS ul, lead(u) OVER g AS ur FROM f WINDOW g AS (PARTITION BY run ORDER BY i)),
t AS (SELECT *, coalesce(-((CASE WHEN (u + ur) / 2 > 0 THEN (u + ur) / 2 * v ELSE (u + ur) / 2 * vr END) - (CASE WHEN (ul + u) / 2 > 0 THEN (ul + u) / 2 * vl ELSE (ul + u) / 2 * v END)) / 0.1, 0) AS conv, coalesce(-((u + ur) / 2 * (0.5 * (v + vr)) - (ul + u) / 2 * (0.5 * (vl + v))) / 0.1, 0) AS central, coalesce((vr - 2 * v + vl) / 0.01, 0) AS lap FROM n)"""


@query(f"WITH {FIELD}, {CONV} SELECT run, i, round(conv, 9) AS upwind, round(central, 9) AS central FROM t")
def convective_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upwind and central face fluxes."""
    rows = field(spark, sf_dir).select("run", "i", "v", (F.col("w") - 2).alias("u"))
    out = stencils.convective_term(stencils.convective_term(rows, 0.1).withColumnRenamed("conv", "upwind"), 0.1, "central").withColumnRenamed("conv", "central")
    return rounded(out.select("run", "i", "upwind", "central"), 9)


@query(f"WITH {FIELD}, {CONV} SELECT run, i, round(conv + 0.05 * lap + 0.25, 6) AS adr FROM t")
def adr_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    rows = field(spark, sf_dir).select("run", "i", "v", (F.col("w") - 2).alias("u"))
    return rounded(stencils.adr_term(rows, 0.05, 0.25, 0.1).select("run", "i", "adr"))


@query(f"""WITH {GRID2}, n AS (SELECT *, lag(v) OVER x AS l, lead(v) OVER x AS r, lag(v) OVER y AS d, lead(v) OVER y AS u FROM grid2 WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j))
SELECT i, j, round(CASE WHEN l IS NULL OR r IS NULL OR d IS NULL OR u IS NULL THEN v ELSE v - 0.01 * (ux * (CASE WHEN ux > 0 THEN v - l ELSE r - v END) / 0.1 + uy * (CASE WHEN uy > 0 THEN v - d ELSE u - v END) / 0.2) END, 9) AS v FROM n""")
def upwind_advection_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9."""
    return rounded(stencils.advect_2d(grid2(spark, sf_dir), 0.01, 0.1, 0.2).select("i", "j", "v"), 9)


OSC = """d AS (SELECT user_id, value - lag(value) OVER g AS a, lead(value) OVER g - value AS b FROM {src} WINDOW g AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(CASE WHEN count(*) >= 3 THEN count(*) FILTER (a * b < 0) / (count(*) - 2) ELSE 0 END, 6) AS oscillation FROM d GROUP BY user_id"""


@query("WITH " + OSC.format(src="events"))
def oscillation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 over whole histories."""
    return rounded(stencils.oscillation_index(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id"))


@query("WITH h AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10), " + OSC.format(src="h"))
def oscillation_index_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 over the last ten instants."""
    return rounded(stencils.oscillation_index(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id", last=10))


@query("SELECT user_id, event_id FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 2 = 0")
def decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16."""
    return stencils.decimate(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query(f"WITH {FIELD} SELECT run, i, v FROM field WHERE i % 25 = 0")
def polling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15."""
    return stencils.every(field(spark, sf_dir), "i", 25).select("run", "i", "v")


@query(f"WITH {FIELD} SELECT run, round(sum(v), 4) AS sum, min(v) AS min, max(v) AS max, round(sum(abs(v)), 4) AS norm1, round(sqrt(sum(v * v)), 6) AS norm2, max(abs(v)) AS norm_inf, round(sum(v * w), 4) AS dot FROM field GROUP BY run")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, A18."""
    return rounded(norms.vector_norms(field(spark, sf_dir), ["run"], "v", "w"), sum=4, norm1=4, dot=4)


@query("SELECT l_returnflag AS flag, l_linenumber AS line, sum(l_linenumber) AS sum, round(ln(product(1 + l_discount / 1000)), 8) AS log_product, min(l_quantity) AS min, max(l_quantity) AS max, bool_and(l_tax < 0.08) AS all_low, bool_or(l_discount > 0.09) AS any_high, bit_and(l_partkey) AS bit_and, bit_or(l_partkey) AS bit_or FROM lineitem GROUP BY 1, 2")
def reduction_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight reductions."""
    rows = table(spark, sf_dir, "lineitem")
    out = rows.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line")).agg(F.sum("l_linenumber").alias("sum"), F.log(F.product(1 + F.col("l_discount") / 1000)).alias("log_product"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"), F.bool_and(F.col("l_tax") < 0.08).alias("all_low"), F.bool_or(F.col("l_discount") > 0.09).alias("any_high"), F.bit_and("l_partkey").alias("bit_and"), F.bit_or("l_partkey").alias("bit_or"))
    return rounded(out, log_product=8)


@query(f"WITH {FIELD} SELECT run, round(CASE WHEN sqrt(sum(w * w)) < 1e-12 THEN 0 ELSE sqrt(sum(v * v)) / sqrt(sum(w * w)) END, 6) AS growth FROM field GROUP BY run")
def growth_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return rounded(norms.growth_rate(field(spark, sf_dir), ["run"], "v", "w"))


@query(f"WITH {FIELD} SELECT run, round(0.004 / 1e-6, 6) AS absolute, round(0.004 / (1e-3 * greatest(sqrt(avg(w * w)), 1.0)), 6) AS relative, round(max(abs(w - v) / (1e-6 + 1e-3 * abs(w))), 4) AS mixed, round(sqrt(avg((abs(w - v) / (1e-6 + 1e-3 * greatest(abs(v), abs(w)))) * (abs(w - v) / (1e-6 + 1e-3 * greatest(abs(v), abs(w)))))), 6) AS scaled FROM field GROUP BY run")
def scaled_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return rounded(norms.scaled_errors(field(spark, sf_dir), ["run"], "v", "w", 0.004), mixed=4)


@query(f"WITH {FIELD} SELECT run, round(sqrt(sum((v - w) * (v - w))) / sqrt(sum(w * w)), 6) AS l2 FROM field GROUP BY run")
def relative_l2_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return rounded(norms.relative_l2(field(spark, sf_dir), ["run"], "v", "w"))


BAD = "f AS (SELECT run, i, CASE WHEN run % 7 = 0 AND i = 3 THEN CAST('NaN' AS DOUBLE) WHEN run % 11 = 0 AND i = 4 THEN CAST('Infinity' AS DOUBLE) WHEN run % 13 = 0 AND i = 5 THEN 1e11 ELSE v END AS v, w FROM field)"


def _with_bad_values(rows: DataFrame) -> DataFrame:
    run, i = F.col("run"), F.col("i")
    return rows.withColumn("v", F.when((run % 7 == 0) & (i == 3), F.lit(float("nan"))).when((run % 11 == 0) & (i == 4), F.lit(float("inf"))).when((run % 13 == 0) & (i == 5), F.lit(1e11)).otherwise(F.col("v")))


@query(f"WITH {FIELD}, {BAD} SELECT run, bool_or(isnan(v)) AS has_nan, bool_or(isinf(v)) AS has_inf, bool_and(isfinite(v) AND v BETWEEN 0 AND 60) AS in_bounds, bool_or(NOT isfinite(v) OR abs(v) > 1e10) AS diverging FROM f GROUP BY run")
def field_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, F12, F13."""
    return norms.flags(_with_bad_values(field(spark, sf_dir)), ["run"], "v", 0.0, 60.0)


@query(f"""WITH {FIELD}, {BAD},
m AS (SELECT run, bool_or(isnan(v)) AS n, bool_or(isinf(v)) AS f, NOT bool_and(isfinite(v) AND v BETWEEN 0 AND 60) AS o, max(w) / 10 * 0.1 / 0.1 AS cfl, sqrt(avg(v * v)) / 15 AS growth FROM f GROUP BY run),
d AS (SELECT run, v - lag(v) OVER g AS a, lead(v) OVER g - v AS b FROM f WINDOW g AS (PARTITION BY run ORDER BY i)),
s AS (SELECT run, CASE WHEN count(*) >= 3 THEN count(*) FILTER (a * b < 0) / (count(*) - 2) ELSE 0 END AS osc FROM d GROUP BY run),
c AS (SELECT *, CASE WHEN cfl > 1 THEN 'Unstable' WHEN cfl > 0.8 THEN 'Warning' WHEN o THEN 'Unstable' ELSE 'Stable' END AS c FROM m JOIN s USING (run)),
g AS (SELECT *, CASE WHEN growth > 2 THEN 'Unstable' WHEN growth > 1.6 AND c = 'Stable' THEN 'Warning' ELSE c END AS g FROM c)
SELECT run, CASE WHEN n OR f THEN 'Critical' WHEN osc > 0.5 AND g = 'Stable' THEN 'Warning' ELSE g END AS status FROM g""")
def stability_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitor's rules in their order."""
    rows = _with_bad_values(field(spark, sf_dir))
    m = norms.flags(rows, ["run"], "v", 0.0, 60.0).join(rows.groupBy("run").agg((F.max("w") / 10 * 0.1 / 0.1).alias("cfl"), (F.sqrt(F.avg(F.col("v") * F.col("v"))) / 15).alias("growth")), "run")
    m = m.join(stencils.oscillation_index(rows, "run", "i", "v"), "run")
    return m.select("run", norms.status(F.col("has_nan"), F.col("has_inf"), ~F.col("in_bounds"), F.col("cfl"), F.col("growth"), F.col("oscillation")).alias("status"))


@query(f"WITH {FIELD} SELECT run, count(*) FILTER (abs(v - w * 10) < 5) AS close, count(*) AS n FROM field GROUP BY run")
def tolerance_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    return field(spark, sf_dir).groupBy("run").agg(F.count_if(norms.close(F.col("v"), F.col("w") * 10, 5.0)).alias("close"), F.count("*").alias("n"))


@query(f"WITH {FIELD} SELECT run, i, round(CASE WHEN r <= 0 THEN 0 ELSE (r + abs(r)) / (1 + abs(r)) END, 6) AS phi FROM (SELECT run, i, (v - lag(v) OVER g) / (lead(v) OVER g - v + 0.37) AS r FROM field WINDOW g AS (PARTITION BY run ORDER BY i)) WHERE r IS NOT NULL")
def van_leer_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    w = Window.partitionBy("run").orderBy("i")
    rows = field(spark, sf_dir).select("run", "i", ((F.col("v") - F.lag("v").over(w)) / (F.lead("v").over(w) - F.col("v") + 0.37)).alias("r")).where("r is not null")
    return rounded(rows.select("run", "i", tr.van_leer("r").alias("phi")))


@query(f"WITH {GRID2} SELECT i, j, round(2 * exp(-((0.25 * i - 4) ** 2 + (0.5 * j - 3) ** 2) / (2 * 1.5 ** 2)), 9) AS u, CASE WHEN 0.25 * i < 5 THEN 1.0 ELSE 0.25 END AS v, round(sin(0.7 * (0.25 * i)) * sin(1.3 * (0.5 * j)), 9) AS w, round(0.25 * i * (0.5 * j) + 1, 9) AS own FROM grid2")
def initial_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.15: fields set by functions of the position, ready-made and own."""
    grid = grid2(spark, sf_dir).select("i", "j")
    conditions = {"u": initial.gaussian(4, 3, 1.5, 2.0), "v": initial.step(5.0, 1.0, 0.25), "w": initial.sine(0.7, 1.3), "own": lambda x, y: x * y + 1}
    return rounded(initial.apply(grid, conditions, (0.25, 0.5)), 9)
