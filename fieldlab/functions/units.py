"""Units with dimension checks made while the plan is built.

A Quantity is a Column with seven SI exponents (length, mass, time, current, temperature,
amount, luminosity).  Adding or comparing different dimensions is an error before any row is
read; what runs is plain column arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col

NONE = (0,) * 7


class DimensionError(TypeError):
    pass


@dataclass(frozen=True)
class Quantity:
    value: Column
    dim: tuple[int, ...] = NONE

    def _same(self, other: Quantity) -> None:
        if self.dim != other.dim:
            raise DimensionError(f"{self.dim} and {other.dim}")

    def __add__(self, other: Quantity) -> Quantity:
        self._same(other)
        return Quantity(self.value + other.value, self.dim)

    def __sub__(self, other: Quantity) -> Quantity:
        self._same(other)
        return Quantity(self.value - other.value, self.dim)

    def __mul__(self, other: Quantity | float) -> Quantity:
        if not isinstance(other, Quantity):
            return Quantity(self.value * other, self.dim)
        return Quantity(self.value * other.value, tuple(a + b for a, b in zip(self.dim, other.dim, strict=True)))

    __rmul__ = __mul__

    def __truediv__(self, other: Quantity | float) -> Quantity:
        if not isinstance(other, Quantity):
            return Quantity(self.value / other, self.dim)
        return Quantity(self.value / other.value, tuple(a - b for a, b in zip(self.dim, other.dim, strict=True)))

    def __lt__(self, other: Quantity) -> Column:
        self._same(other)
        return self.value < other.value

    def equals(self, other: Quantity, tolerance: float = 1e-10) -> Column:
        self._same(other)
        return F.abs(self.value - other.value) < tolerance

    def pow(self, exponent: float) -> Quantity:
        if self.dim != NONE:
            raise DimensionError("only pure numbers have powers")
        return Quantity(F.pow(self.value, F.lit(float(exponent))))

    def sqrt(self) -> Quantity:
        return self.pow(0.5)


def _dim(length=0, mass=0, time=0, temperature=0, amount=0) -> tuple[int, ...]:
    return (length, mass, time, 0, temperature, amount, 0)


#: Factor, offset and exponents of each unit.
UNITS: dict[str, tuple[float, float, tuple[int, ...]]] = {
    "m": (1.0, 0.0, _dim(length=1)),
    "cm": (0.01, 0.0, _dim(length=1)),
    "mm": (0.001, 0.0, _dim(length=1)),
    "s": (1.0, 0.0, _dim(time=1)),
    "min": (60.0, 0.0, _dim(time=1)),
    "h": (3600.0, 0.0, _dim(time=1)),
    "kg": (1.0, 0.0, _dim(mass=1)),
    "g": (0.001, 0.0, _dim(mass=1)),
    "K": (1.0, 0.0, _dim(temperature=1)),
    "degC": (1.0, 273.15, _dim(temperature=1)),
    "mol": (1.0, 0.0, _dim(amount=1)),
    "J": (1.0, 0.0, _dim(length=2, mass=1, time=-2)),
    "Pa": (1.0, 0.0, _dim(length=-1, mass=1, time=-2)),
    "1": (1.0, 0.0, NONE),
}


def quantity(value, unit: str) -> Quantity:
    factor, offset, dim = UNITS[unit]
    return Quantity(col(value) * factor + offset, dim)
