"""Configurations as (key, type, value) rows: layering, diffing, validation.

Values are texts; ``type`` is bool, int, double or string.  Rules are rows too:
(key, rule, low, high, options) with rule range, enum, regex or nonempty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, type string, required boolean, default string, rule string, low double, high double, options array<string>"

#: The built-in schemas.
SCHEMAS: dict[str, list[tuple]] = {
    "solver": [
        ("solver.type", "string", True, None, "enum", None, None, ["explicit", "implicit", "petsc", "ngsolve"]),
        ("solver.tolerance", "double", False, "1.0E-6", "positive", None, None, None),
        ("solver.max_iterations", "int", False, "1000", "range", 1.0, 1000000.0, None),
        ("solver.preconditioner", "string", False, "jacobi", "enum", None, None, ["none", "jacobi", "ilu", "multigrid"]),
    ],
    "mesh": [
        ("mesh.filename", "string", True, None, "nonempty", None, None, None),
        ("mesh.dimension", "int", False, "2", "range", 1.0, 3.0, None),
        ("mesh.refine_level", "int", False, "0", "range", 0.0, 10.0, None),
    ],
    "time": [
        ("time.dt", "double", True, None, "positive", None, None, None),
        ("time.t_final", "double", False, "1.0", "positive", None, None, None),
        ("time.output_interval", "int", False, "10", "range", 1.0, 1000000.0, None),
        ("time.cfl", "double", False, "0.5", "range", 0.0, 1.0, None),
    ],
}

#: Presets by name.
PRESETS: dict[str, dict[str, object]] = {
    "fast": {"solver.type": "explicit", "solver.tolerance": 1.0e-3, "solver.max_iterations": 100, "time.dt": 0.01, "time.cfl": 0.9, "time.output_interval": 100, "output.format": "csv", "output.verbose": False},
    "balanced": {"solver.type": "implicit", "solver.tolerance": 1.0e-6, "solver.max_iterations": 500, "solver.preconditioner": "jacobi", "time.dt": 0.001, "time.cfl": 0.5, "time.output_interval": 50, "output.format": "vtk", "output.verbose": False},
    "accurate": {"solver.type": "implicit", "solver.tolerance": 1.0e-9, "solver.max_iterations": 2000, "solver.preconditioner": "ilu", "time.dt": 0.0001, "time.cfl": 0.25, "time.output_interval": 10, "mesh.refine_level": 2, "output.format": "vtk", "output.precision": 12, "output.verbose": False},
    "production": {"solver.type": "implicit", "solver.tolerance": 1.0e-6, "solver.max_iterations": 1000, "solver.preconditioner": "ilu", "time.dt": 0.001, "time.output_interval": 100, "output.format": "vtk", "output.checkpoint_interval": 1000, "output.save_fields": True, "output.save_statistics": True, "output.verbose": True, "logging.level": "INFO", "logging.file": "simulation.log"},
    "debug": {"solver.type": "explicit", "solver.tolerance": 1.0e-3, "solver.max_iterations": 50, "time.dt": 0.01, "time.output_interval": 1, "output.verbose": True, "output.save_every_step": True, "logging.level": "DEBUG", "logging.console": True},
    "reaction_diffusion": {"solver.type": "implicit", "solver.tolerance": 1.0e-6, "time.dt": 0.01, "time.t_final": 1000.0, "time.output_interval": 100, "coupling.model": "gray_scott", "coupling.diffusion_u": 2.0e-5, "coupling.diffusion_v": 1.0e-5, "coupling.feed_rate": 0.055, "coupling.kill_rate": 0.062, "mesh.dimension": 2, "mesh.periodic": True, "output.format": "vtk", "output.save_pattern_metrics": True},
    "transport": {"solver.type": "implicit", "solver.tolerance": 1.0e-6, "time.dt": 0.001, "time.cfl": 0.5, "transport.diffusion_coefficient": 1.0e-9, "transport.velocity_field": "uniform", "transport.boundary_conditions": "dirichlet", "output.format": "vtk", "output.save_fluxes": True},
    "surface_chemistry": {"solver.type": "implicit", "solver.tolerance": 1.0e-8, "time.dt": 1.0e-6, "time.output_interval": 1000, "surface.mechanism": "langmuir_hinshelwood", "surface.site_density": 1.0e19, "surface.temperature": 300.0, "output.format": "csv", "output.save_coverage": True, "output.save_rates": True},
}


def kind_of(value: object) -> str:
    return "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "double" if isinstance(value, float) else "string"


def to_rows(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    """A flat dictionary as (key, type, value) rows."""
    rows = [(k, kind_of(v), str(v).lower() if isinstance(v, bool) else str(v)) for k, v in sorted(values.items())]
    return spark.createDataFrame(rows, "key string, type string, value string")


def schema_rows(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([r for n in names for r in SCHEMAS[n]], SCHEMA)


def with_prefix(config: DataFrame, prefix: str, strip: bool = False) -> DataFrame:
    rows = config.where(F.col("key").startswith(prefix))
    return rows.withColumn("key", F.substring("key", len(prefix) + 1, 1 << 20)) if strip else rows


def layer(*layers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The last layer that has a key decides: ([keys], key, type, value, source)."""
    on, both = [*(keys or []), "key"], None
    for n, rows in enumerate(layers):
        part = rows.select(*on, "type", "value", F.lit(n).alias("source"))
        both = part if both is None else both.union(part)
    return both.groupBy(*on).agg(F.max_by(F.struct("type", "value", "source"), "source").alias("b")).select(*on, "b.*")


def diff(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """([keys], key, change, old_value, new_value): added, removed, modified or unchanged;
    equal texts of different types are modified."""
    on = [*(keys or []), "key"]
    a = old.select(*on, F.col("type").alias("old_type"), F.col("value").alias("old_value"))
    b = new.select(*on, F.col("type").alias("new_type"), F.col("value").alias("new_value"))
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when((F.col("old_type") == F.col("new_type")) & F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("modified")
    return a.join(b, on, "full_outer").select(*on, change.alias("change"), "old_value", "new_value")


def type_fits(value: Column, kind: Column) -> Column:
    return F.when(kind == "int", value.try_cast("bigint").isNotNull()).when(kind == "double", value.try_cast("double").isNotNull()).when(kind == "bool", F.lower(value).isin("true", "false")).otherwise(F.lit(True))


def rule_fits(value: Column, rule: Column, low: Column, high: Column, options: Column) -> Column:
    number = value.try_cast("double")
    return F.when(rule == "range", F.coalesce(number.between(low, high), F.lit(False))).when(rule == "positive", F.coalesce(number > 0, F.lit(False))).when(rule == "enum", F.array_contains(options, value)).when(rule == "regex", F.regexp(value, F.concat(F.lit("^(?:"), F.element_at(options, 1), F.lit(")$")))).when(rule == "nonempty", F.length(F.trim(value)) > 0).otherwise(F.lit(True))


#: A custom rule: whether a value's text is sound, as a Column of it.
Predicate = Callable[[Column], Column]


def validate(config: DataFrame, schema: DataFrame, keys: list[str] | None = None, predicates: dict[str, Predicate] | None = None) -> DataFrame:
    """([keys], key, problem): missing, type or rule, the first that fails; sound keys give no
    row.  ``config`` may hold many configurations told apart by ``keys``.

    ``predicates`` are custom rules by key, also of keys that the schema lacks: values that are
    there and fail one, or for which it is null, have the problem ``custom``.
    """
    keys = keys or []
    wanted = schema
    if keys:
        wanted = config.select(*keys).distinct().crossJoin(F.broadcast(schema))  # a schema has few rows
    rows = wanted.join(config.select(*keys, "key", "value"), [*keys, "key"], "left")
    own = F.lit(True)
    for name, sound in (predicates or {}).items():
        own = F.when(F.col("key") == name, F.coalesce(sound(F.col("value")), F.lit(False))).otherwise(own)
    problem = F.when(F.col("value").isNull(), F.when(F.col("required"), "missing")).when(~type_fits(F.col("value"), F.col("type")), "type").when(~rule_fits(F.col("value"), F.col("rule"), F.col("low"), F.col("high"), F.col("options")), "rule").when(~own, "custom")
    out = rows.select(*keys, "key", problem.alias("problem")).where("problem is not null")
    if predicates:
        free = config.where(F.col("key").isin(list(predicates)) & F.col("value").isNotNull()).join(schema.select("key"), "key", "left_anti")
        out = out.union(free.where(~own).select(*keys, "key", F.lit("custom").alias("problem")))
    return out


def defaults(config: DataFrame, schema: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """config with the schema's defaults for absent keys.  ``config`` may hold many
    configurations told apart by ``keys``."""
    wanted = schema.where("default is not null").select("key", "type", F.col("default").alias("value"))
    if keys:
        wanted = config.select(*keys).distinct().crossJoin(F.broadcast(wanted))  # a schema has few rows
    return layer(wanted, config, keys=keys)


def preset(spark: SparkSession, name: str, config: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """A preset's rows, or config with it applied."""
    rows = to_rows(spark, PRESETS[name])
    if config is None:
        return rows
    return layer(config, rows) if overwrite else layer(rows, config)


def conflicts(boundaries: DataFrame) -> DataFrame:
    """(tag, field, n): places where more than one enabled boundary condition acts."""
    return boundaries.where("enabled").groupBy("tag", "field").agg(F.count("*").alias("n")).where("n > 1")


def document(schema: DataFrame) -> DataFrame:
    """(key, text): one line of documentation a key."""
    return schema.select("key", F.concat_ws(" ", F.concat("key", F.lit(":")), "type", F.when(F.col("required"), "required").otherwise("optional"), F.concat(F.lit("default="), "default")).alias("text"))
