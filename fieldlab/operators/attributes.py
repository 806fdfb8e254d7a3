"""Attributes of nodes and elements as one map column: get with a default, has, set, remove.

Maps keep text values; ``get`` casts to the type of its default.  A null map counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import col


def _map(attributes) -> Column:
    return F.coalesce(col(attributes), F.from_json(F.lit("{}"), "map<string,string>"))


def has(attributes, name: str) -> Column:
    return F.map_contains_key(_map(attributes), F.lit(name))


def get(attributes, name: str, default: object = None) -> Column:
    """The value of an attribute, or the default where it is absent, null or not of its type."""
    found = F.try_element_at(_map(attributes), F.lit(name))
    kind = {bool: "boolean", int: "bigint", float: "double"}.get(type(default))
    return F.coalesce(found.try_cast(kind) if kind else found, F.lit(default))


def put(attributes, name: str, value) -> Column:
    """The map with one attribute set, replacing what it had."""
    return F.map_concat(remove(attributes, name), F.create_map(F.lit(name), col(value).cast("string")))


def remove(attributes, *names: str) -> Column:
    return F.map_filter(_map(attributes), lambda k, _: ~k.isin(list(names)))


def merge(attributes, other) -> Column:
    """Both maps; where both have an attribute the other's value stands."""
    kept = F.map_filter(_map(attributes), lambda k, _: ~F.map_contains_key(_map(other), k))
    return F.map_concat(kept, _map(other))


def collect(rows: DataFrame, keys: list[str], name: str, value: str, order: str) -> DataFrame:
    """([keys], attributes) from one row an assignment; the last in order stands."""
    last = rows.groupBy(*keys, name).agg(F.max_by(F.col(value).cast("string"), order).alias("_v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, "_v"))).alias("attributes"))


def spell(attributes) -> Column:
    """The attributes in order of their names, for output: ``a=1;b=2``."""
    entries = F.array_sort(F.map_entries(_map(attributes)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
