"""Thermodynamic polynomials and transport properties of species."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col
from .constants import R


def _coefficients(T: Column, Tmid: Column, low: Column, high: Column) -> Column:
    return F.when(T <= Tmid, low).otherwise(high)


def _checked(T: Column, Tmin: Column, Tmax: Column, low: Column, high: Column, value: Column) -> Column:
    bad = (T < Tmin) | (T > Tmax) | (F.size(low) != 7) | (F.size(high) != 7)
    return F.when(bad, F.raise_error("temperature outside the polynomial's range, or not 7 coefficients")).otherwise(value)


def nasa7(kind: str, T, Tmin, Tmid, Tmax, low, high) -> Column:
    """``cp``, ``h``, ``s`` or ``g`` (J/mol[/K]) from seven-coefficient polynomials; the low
    set up to Tmid.  Outside Tmin..Tmax the plan fails."""
    T, Tmin, Tmid, Tmax, low, high = map(col, (T, Tmin, Tmid, Tmax, low, high))
    a = [F.element_at(_coefficients(T, Tmid, low, high), k + 1) for k in range(7)]
    powers = lambda divide: sum((a[k] * F.pow(T, F.lit(float(k))) / divide(k) for k in range(1, 5)), start=F.lit(0.0))
    cp = R * (a[0] + powers(lambda k: 1))
    h = R * T * (a[0] + powers(lambda k: k + 1) + a[5] / T)
    s = R * (a[0] * F.log(T) + powers(lambda k: k) + a[6])
    value = {"cp": cp, "h": h, "s": s, "g": h - T * s}[kind]
    return _checked(T, Tmin, Tmax, low, high, value)


def binary_diffusivity(T, P, mw1, sigma1, eps1, mw2, sigma2, eps2) -> Column:
    """Chapman-Enskog diffusivity in m2/s with a fitted collision integral; mw in kg/mol."""
    T, P, mw1, sigma1, eps1, mw2, sigma2, eps2 = map(col, (T, P, mw1, sigma1, eps1, mw2, sigma2, eps2))
    # fixed values: the collision integral's fit
    reduced = T / F.sqrt(eps1 * eps2)
    omega = 1.16145 / F.pow(reduced, F.lit(0.14874)) + 0.52487 / F.exp(0.77320 * reduced)
    sigma = (sigma1 + sigma2) / 2.0
    mass = 2.0 / (1.0 / (mw1 * 1000.0) + 1.0 / (mw2 * 1000.0))
    return 0.00266 * F.pow(T, F.lit(1.5)) / (P * 1e-5 * sigma * sigma * omega * F.sqrt(mass)) * 1e-4


def temperature_change(heat, density, specific_heat, dt) -> Column:
    """q dt / (rho cp); fails unless density and heat capacity are positive."""
    heat, density, specific_heat, dt = map(col, (heat, density, specific_heat, dt))
    ok = (density > 0) & (specific_heat > 0)
    return F.when(~ok, F.raise_error("density and specific heat must be positive").cast("double")).otherwise(heat * dt / F.when(ok, density * specific_heat))
