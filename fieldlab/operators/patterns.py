"""Statistics and classification of scalar fields (run, i, v).

``analyze`` shuffles a field once: windows partitioned by run and aggregations on keys that begin
with the run follow on the same partitions.  Lags are ``lead`` columns of one window and mirrored
values meet by their distance from the end, so nothing is joined with itself.
Empty runs don't exist as rows; a run with one value has variance, amplitude and
correlation 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LAG = 50


def _along(run: str) -> Window:
    return Window.partitionBy(run).orderBy("i")


def basics(field: DataFrame, run: str = "run") -> DataFrame:
    """n, mean, population variance, amplitude and energy (sum of squares) per run."""
    return field.groupBy(run).agg(F.count("v").alias("n"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("variance"), F.coalesce(F.max("v") - F.min("v"), F.lit(0.0)).alias("amplitude"), F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("energy"))


def statistics(field: DataFrame, run: str = "run") -> DataFrame:
    """min, max, mean, population standard deviation and median per run."""
    return field.groupBy(run).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.median("v").alias("median"))


def _centered(field: DataFrame, run: str) -> DataFrame:
    every = Window.partitionBy(run)
    return field.withColumn("c", F.col("v") - F.avg("v").over(every))


def correlation(field: DataFrame, run: str = "run") -> DataFrame:
    """Lag-1 correlation: sum c_i c_(i+1) / ((n - 1) var_pop); 0 where the variance is below
    1e-15.  It can leave [-1, 1]."""
    rows = _centered(field, run).withColumn("next", F.lead("c").over(_along(run)))
    out = rows.groupBy(run).agg(F.count("v").alias("n"), F.var_pop("v").alias("variance"), F.coalesce(F.sum(F.col("c") * F.col("next")), F.lit(0.0)).alias("s"))
    safe = F.when((F.col("variance") >= 1e-15) & (F.col("n") > 1), (F.col("n") - 1) * F.col("variance"))
    return out.select(run, F.coalesce(F.col("s") / safe, F.lit(0.0)).alias("correlation"))


def _lag_sums(field: DataFrame, run: str, max_lag: int, also: list[Column]) -> DataFrame:
    """n, variance and the sums s1.. of products of centred values by lag, and ``also``."""
    along = _along(run)
    rows = _centered(field, run).select("*", *(F.lead("c", k).over(along).alias(f"c{k}") for k in range(1, max_lag)))
    sums = [F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, max_lag)]
    return rows.groupBy(run).agg(F.count("v").alias("n"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("variance"), *sums, *also)


def _by_lag(k: int) -> Column:
    """The autocorrelation at a lag, null where the variance is below 1e-15."""
    return F.col(f"s{k}") / F.when((F.col("variance") >= 1e-15) & (F.col("n") > k), (F.col("n") - k) * F.col("variance"))


def _acf(max_lag: int) -> Column:
    lags = F.least(F.floor(F.col("n") / 4), F.lit(max_lag)).cast("int")
    return F.slice(F.array(F.lit(0.0), *(_by_lag(k) for k in range(1, max_lag))), F.lit(1), F.greatest(lags, F.lit(0)))


def _wavelength(spacing: float) -> Column:
    at = lambda k: F.element_at("acf", k + 1)
    lags = F.when(F.size("acf") >= 4, F.sequence(F.lit(2), F.size("acf") - 2)).otherwise(F.array().cast("array<int>"))
    peaks = F.filter(lags, lambda k: (at(k - 1) < at(k)) & (at(k) > at(k + 1)) & (at(k) > 0.0))
    found = F.when((F.col("n") >= 4) & (F.col("variance") >= 1e-15), 2.0 * F.try_element_at(peaks, F.lit(1)) * spacing)
    return F.coalesce(found, F.lit(0.0))


def autocorrelation(field: DataFrame, run: str = "run", max_lag: int = MAX_LAG) -> DataFrame:
    """(run, n, variance, acf): acf[k] for lags below min(n div 4, max_lag), acf[0] = 0."""
    return _lag_sums(field.select(run, "i", "v"), run, max_lag, []).select(run, "n", "variance", _acf(max_lag).alias("acf"))


def dominant_wavelength(field: DataFrame, run: str = "run", spacing: float = 1.0) -> DataFrame:
    """2 * lag * spacing at the first positive local peak of the autocorrelation, else 0."""
    return autocorrelation(field, run).select(run, _wavelength(spacing).alias("wavelength"))


def symmetry(field: DataFrame, run: str = "run") -> DataFrame:
    """1 - sqrt(sum (v_i - v_mirror)^2 / sum (v_i^2 + v_mirror^2)) over the first half; 1 for
    fewer than two values or a norm below 1e-15."""
    sized = field.select(run, "i", "v", F.count("v").over(Window.partitionBy(run)).alias("n"))
    pairs = sized.groupBy(run, F.least("i", F.col("n") - 1 - F.col("i")).alias("end")).agg(F.count("v").alias("c"), (F.max("v") - F.min("v")).alias("d"), F.sum(F.col("v") * F.col("v")).alias("e"))
    both = lambda x: F.sum(F.when(F.col("c") == 2, x))  # noqa: E731 - the middle of an odd run has no mirror
    sums = pairs.groupBy(run).agg(both(F.col("d") * F.col("d")).alias("diff"), both(F.col("e")).alias("norm"))
    value = F.when(F.col("norm") >= 1e-15, 1.0 - F.sqrt(F.col("diff") / F.when(F.col("norm") >= 1e-15, F.col("norm"))))
    return sums.select(run, F.coalesce(value, F.lit(1.0)).alias("symmetry"))


BINS = 20


def _bin(bins: int) -> Column:
    """The histogram's bin of v between lo and hi, the last one for hi alone."""
    span = F.col("hi") - F.col("lo")
    return F.when(span >= 1e-15, F.floor((F.col("v") - F.col("lo")) / F.when(span >= 1e-15, span) * (bins - 1))).otherwise(F.lit(0))


def entropy(field: DataFrame, run: str = "run", bins: int = BINS) -> DataFrame:
    """Natural-log entropy of a histogram whose last bin holds the maximum alone: bin
    floor((v - min) / range * (bins - 1)); 0 where the range is below 1e-15."""
    every = Window.partitionBy(run)
    rows = field.select(run, "v", F.min("v").over(every).alias("lo"), F.max("v").over(every).alias("hi"))
    counts = rows.groupBy(run, _bin(bins).alias("bin")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(every)
    return counts.select(run, (-p * F.log(p)).alias("e")).groupBy(run).agg(F.sum("e").alias("entropy"))


def gradient(field: DataFrame, run: str = "run", spacing: float = 1.0) -> DataFrame:
    """|v_(i+1) - v_i| / spacing for all but the last position."""
    rows = field.withColumn("next", F.lead("v").over(_along(run)))
    return rows.where("next is not null").select(run, "i", (F.abs(F.col("next") - F.col("v")) / spacing).alias("gradient"))


def classify(variance: Column, wavelength: Column, amplitude: Column, correlation: Column, symmetry: Column) -> Column:
    """The first fitting class of an ordered list."""
    # fixed values: classes and their limits
    return (
        F.when(variance < 1.0e-6, "UNIFORM")
        .when((wavelength < 1.0e-6) & (variance > 0.01), "OSCILLATORY")
        .when((amplitude > 0.5) & (correlation < 0.3), "SPOTS")
        .when((wavelength > 0.0) & (correlation > 0.5), "STRIPES")
        .when((symmetry > 0.8) & (correlation > 0.3), "HEXAGONS")
        .when((correlation > 0.2) & (correlation < 0.5), "LABYRINTH")
        .when((variance > 0.1) & (correlation < 0.2), "CHAOTIC")
        .otherwise("UNIFORM")
    )


def analyze(field: DataFrame, run: str = "run", spacing: float = 1.0) -> DataFrame:
    """Every metric and the class of each run."""
    every, v = Window.partitionBy(run), F.col("v")
    binned = field.select(run, "i", "v", F.min("v").over(every).alias("lo"), F.max("v").over(every).alias("hi")).withColumn("bin", _bin(BINS))
    also = [F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.max(v) - F.min(v), F.lit(0.0)).alias("amplitude"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("energy"), *(F.count_if(F.col("bin") == k).alias(f"h{k}") for k in range(BINS))]
    sums = _lag_sums(binned, run, MAX_LAG, also)
    total = sum((F.col(f"h{k}") for k in range(1, BINS)), start=F.col("h0"))
    shares = [F.col(f"h{k}") / total for k in range(BINS)]
    spread = sum((F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0)) for p in shares[1:]), start=F.when(shares[0] > 0, -shares[0] * F.log(shares[0])).otherwise(F.lit(0.0)))
    out = sums.withColumn("acf", _acf(MAX_LAG)).select(run, "n", "mean", "variance", "amplitude", "energy", F.coalesce(_by_lag(1), F.lit(0.0)).alias("correlation"), _wavelength(spacing).alias("wavelength"), spread.alias("entropy"))
    out = out.join(symmetry(field, run), run).select(run, "n", "mean", "variance", "amplitude", "energy", "correlation", "wavelength", "symmetry", "entropy")
    return out.withColumn("pattern", classify(F.col("variance"), F.col("wavelength"), F.col("amplitude"), F.col("correlation"), F.col("symmetry")))


def stable(before: DataFrame, after: DataFrame, tolerance: float, run: str = "run") -> DataFrame:
    """(run, stable): the fields have equal positions and differ by less than tolerance."""
    both = before.select(run, "i", F.col("v").alias("a")).join(after.select(run, "i", F.col("v").alias("b")), [run, "i"], "full_outer")
    return both.groupBy(run).agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("sized"), F.max(F.abs(F.col("a") - F.col("b"))).alias("d")).select(run, (F.col("sized") & (F.coalesce("d", F.lit(0.0)) < tolerance)).alias("stable"))


def histogram(field: DataFrame, bins: int, run: str = "run") -> DataFrame:
    """(run, bin, count) of equal-width bins over the run's range, the maximum in the last."""
    every = Window.partitionBy(run)
    rows = field.select(run, "v", F.min("v").over(every).alias("lo"), F.max("v").over(every).alias("hi"))
    span = F.col("hi") - F.col("lo")
    index = F.when(span > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.when(span > 0, span) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.groupBy(run, index.cast("int").alias("bin")).agg(F.count("*").alias("count"))
