"""Three-component vectors as structs, and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col
from .constants import TINY

AXES = ("x", "y", "z")


def vector(x, y, z) -> Column:
    return F.struct(*(col(c).cast("double").alias(a) for c, a in zip((x, y, z), AXES, strict=True)))


def _each(f) -> Column:
    return vector(*(f(a) for a in AXES))


def add(u: Column, v: Column) -> Column:
    return _each(lambda a: u[a] + v[a])


def subtract(u: Column, v: Column) -> Column:
    return _each(lambda a: u[a] - v[a])


def scale(u: Column, k) -> Column:
    return _each(lambda a: u[a] * col(k))


def divide(u: Column, k) -> Column:
    """Fails where |k| is below 1e-15."""
    k = col(k)
    safe = F.when(F.abs(k) < TINY, F.raise_error("division by zero").cast("double")).otherwise(k)
    return _each(lambda a: u[a] / safe)


def dot(u: Column, v: Column) -> Column:
    return u.x * v.x + u.y * v.y + u.z * v.z


def cross(u: Column, v: Column) -> Column:
    return vector(u.y * v.z - u.z * v.y, u.z * v.x - u.x * v.z, u.x * v.y - u.y * v.x)


def norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def normalized(u: Column) -> Column:
    return divide(u, norm(u))


def constants(value: float, n) -> Column:
    """An array of n equal values."""
    return F.array_repeat(F.lit(value), col(n))
