"""Rate laws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col
from .constants import R


def arrhenius(A, beta, Ea, T) -> Column:
    """A T^beta exp(-Ea / R T); fails for T <= 0."""
    A, beta, Ea, T = map(col, (A, beta, Ea, T))
    return F.when(T <= 0, F.raise_error("temperature must be positive").cast("double")).otherwise(A * F.pow(T, beta) * F.exp(-Ea / (R * T)))


def substep(dt, scheme: str, operator: str) -> tuple[Column, int]:
    """(size, count) of the sub-steps of one operator: Strang halves chemistry twice."""
    halves = scheme == "strang" and operator == "chemistry"
    return (col(dt) / 2.0, 2) if halves else (col(dt), 1)
