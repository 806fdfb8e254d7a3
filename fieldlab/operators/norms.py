"""Norms, errors and stability of fields: partial and final aggregation, no ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == INF))


def vector_norms(rows: DataFrame, keys: list[str], x: str = "x", y: str | None = None) -> DataFrame:
    """sum, min, max, 1-, 2- and infinity-norm of x, and its dot product with y."""
    c = F.col(x)
    aggs = [F.sum(c).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(F.abs(c)).alias("norm1"), F.sqrt(F.sum(c * c)).alias("norm2"), F.max(F.abs(c)).alias("norm_inf")]
    if y:
        aggs.append(F.sum(c * F.col(y)).alias("dot"))
    return rows.groupBy(*keys).agg(*aggs)


def reductions(rows: DataFrame, keys: list[str], x: str, flag: str, bits: str) -> DataFrame:
    """The eight reduction operators: sum, product, min, max, logical and/or, bitwise and/or."""
    return rows.groupBy(*keys).agg(F.sum(x).alias("sum"), F.product(x).alias("product"), F.min(x).alias("min"), F.max(x).alias("max"), F.bool_and(flag).alias("all"), F.bool_or(flag).alias("any"), F.bit_and(bits).alias("bit_and"), F.bit_or(bits).alias("bit_or"))


def growth_rate(rows: DataFrame, keys: list[str], now: str, before: str) -> DataFrame:
    """|now| / |before|; 0 where the latter is below 1e-12."""
    out = rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col(now) * F.col(now))).alias("a"), F.sqrt(F.sum(F.col(before) * F.col(before))).alias("b"))
    return out.select(*keys, F.when(F.col("b") < 1e-12, F.lit(0.0)).otherwise(F.col("a") / F.when(F.col("b") >= 1e-12, F.col("b"))).alias("growth"))


def scaled_errors(rows: DataFrame, keys: list[str], old: str, new: str, estimate: float, abs_tol: float = 1e-6, rel_tol: float = 1e-3) -> DataFrame:
    """The four scaled error norms: absolute, relative, mixed (max) and scaled (rms)."""
    o, n = F.col(old), F.col(new)
    mixed = F.abs(n - o) / (abs_tol + rel_tol * F.abs(n))
    scaled = F.abs(n - o) / (abs_tol + rel_tol * F.greatest(F.abs(o), F.abs(n)))
    return rows.groupBy(*keys).agg(F.lit(estimate / abs_tol).alias("absolute"), (estimate / (rel_tol * F.greatest(F.sqrt(F.avg(n * n)), F.lit(1.0)))).alias("relative"), F.max(mixed).alias("mixed"), F.sqrt(F.avg(scaled * scaled)).alias("scaled"))


def relative_l2(rows: DataFrame, keys: list[str], value: str, reference: str) -> DataFrame:
    """|value - reference| / |reference|; the numerator alone where the latter is 0."""
    d, r = F.col(value) - F.col(reference), F.col(reference)
    out = rows.groupBy(*keys).agg(F.sqrt(F.sum(d * d)).alias("a"), F.sqrt(F.sum(r * r)).alias("b"))
    return out.select(*keys, F.when(F.col("b") > 0, F.col("a") / F.when(F.col("b") > 0, F.col("b"))).otherwise(F.col("a")).alias("l2"))


def flags(rows: DataFrame, keys: list[str], x: str, low: float, high: float, divergence: float = 1e10) -> DataFrame:
    """has_nan, has_inf, in_bounds and diverging per key."""
    c = F.col(x)
    return rows.groupBy(*keys).agg(F.bool_or(F.isnan(c)).alias("has_nan"), F.bool_or(F.abs(c) == INF).alias("has_inf"), F.bool_and(finite(c) & c.between(low, high)).alias("in_bounds"), F.bool_or(~finite(c) | (F.abs(c) > divergence)).alias("diverging"))


def status(has_nan: Column, has_inf: Column, out_of_bounds: Column, cfl: Column, growth: Column, oscillation: Column, max_cfl: float = 1.0, max_growth: float = 2.0, max_oscillation: float = 0.5) -> Column:
    """Stable, Warning, Unstable or Critical.  The rules apply in the monitor's order: a CFL
    number near its limit turns even an out-of-bounds state into a Warning."""
    after_bounds = F.when(out_of_bounds, "Unstable").otherwise("Stable")
    after_cfl = F.when(cfl > max_cfl, "Unstable").when(cfl > 0.8 * max_cfl, "Warning").otherwise(after_bounds)
    after_growth = F.when(growth > max_growth, "Unstable").when((growth > 0.8 * max_growth) & (after_cfl == "Stable"), "Warning").otherwise(after_cfl)
    after_all = F.when((oscillation > max_oscillation) & (after_growth == "Stable"), "Warning").otherwise(after_growth)
    return F.when(has_nan | has_inf, "Critical").otherwise(after_all)


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) < tolerance
