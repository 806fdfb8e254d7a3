"""Formulas, equations and typed literals as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col


def formula(composition, charge=0) -> Column:
    """Element symbols in order with counts above 1, then the charge: ``H2O``, ``HO-``."""
    composition, charge = col(composition), col(charge)
    parts = F.transform(F.array_sort(F.map_entries(composition)), lambda e: F.concat(e["key"], F.when(e["value"] > 1, e["value"].cast("string")).otherwise(F.lit(""))))
    size = F.when(F.abs(charge) > 1, F.abs(charge).cast("string")).otherwise(F.lit(""))
    sign = F.when(charge > 0, F.concat(F.lit("+"), size)).when(charge < 0, F.concat(F.lit("-"), size)).otherwise(F.lit(""))
    return F.concat(F.array_join(parts, ""), sign)


def atom_count(composition) -> Column:
    return F.aggregate(F.map_values(col(composition)), F.lit(0), lambda a, x: a + x)


def element_count(composition, element: str) -> Column:
    return F.coalesce(F.try_element_at(col(composition), F.lit(element)), F.lit(0))


def key_to_env(key, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.upper(F.translate(col(key), ".-", "__")))


def env_to_key(name, prefix: str = "") -> Column:
    return F.lower(F.translate(F.substring(col(name), len(prefix) + 1, 1 << 20), "_", "."))


def literal_type(text) -> Column:
    """bool, int, float, array or string, tried in this order."""
    t = F.trim(col(text))
    return F.when(F.lower(t).isin("true", "false", "yes", "no"), "bool").when(t.rlike("^[+-]?[0-9]+$"), "int").when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float").when(t.rlike(r"^\[.*\]$"), "array").otherwise("string")


def parse_array(text) -> Column:
    """The items of ``[a, b, c]``, trimmed; empty for ``[]``."""
    inner = F.regexp_replace(F.trim(col(text)), r"^\[|\]$", "")
    return F.when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x)))


def to_bool(text, default: bool = False) -> Column:
    t = F.lower(F.trim(col(text)))
    return F.when(t.isNull(), F.lit(default)).otherwise(t.isin("true", "yes", "1"))


def to_int(text, default: int = 0) -> Column:
    return F.coalesce(F.trim(col(text)).try_cast("bigint"), F.lit(default))


def to_double(text, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(col(text)).try_cast("double"), F.lit(default))
