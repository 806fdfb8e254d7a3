"""Adsorption, desorption, isotherms and surface reaction rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col
from .constants import K_B, N_A, R

PRE_EXPONENTIAL = 1.0e13


def _thermal(mw: Column, T: Column) -> Column:
    return F.sqrt(2.0 * math.pi * (mw / N_A) * K_B * T)


def collision_rate(P, T, mw, site_density) -> Column:
    P, T, mw, site_density = map(col, (P, T, mw, site_density))
    return P / _thermal(mw, T) / site_density


def adsorption_rate(P, T, mw, sticking, theta, site_density, order: int = 1) -> Column:
    free = F.greatest(1.0 - col(theta), F.lit(0.0))
    return col(sticking) * collision_rate(P, T, mw, site_density) * F.pow(free, F.lit(float(order)))


def desorption_rate(E, T, theta, pre: float = PRE_EXPONENTIAL, order: int = 1) -> Column:
    return pre * F.exp(-col(E) / (R * col(T))) * F.pow(col(theta), F.lit(float(order)))


def langmuir_constant(sticking, mw, E, T, pre: float = PRE_EXPONENTIAL) -> Column:
    """k_ads / k_des of the named species."""
    return col(sticking) / pre * _thermal(col(mw), col(T)) * F.exp(col(E) / (R * col(T)))


def langmuir_coverage(K, P) -> Column:
    kp = col(K) * col(P)
    return kp / (1.0 + kp)


def langmuir_pressure(K, theta) -> Column:
    K, theta = col(K), col(theta)
    return F.when(theta >= 1.0, F.raise_error("coverage must be below 1").cast("double")).otherwise(theta / (K * (1.0 - F.when(theta < 1.0, theta))))


def bet_coverage(C, P, P0) -> Column:
    C, P, P0 = map(col, (C, P, P0))
    x = F.when(P < P0, P / P0)
    return F.when(P >= P0, F.raise_error("pressure must be below saturation").cast("double")).otherwise(C * x / ((1.0 - x) * (1.0 + (C - 1.0) * x)))


def freundlich(K, P, n) -> Column:
    return col(K) * F.pow(col(P), 1.0 / col(n))


def rate_constant(A, Ea, T, alpha=0.0, theta=0.0) -> Column:
    """Arrhenius with an activation energy that grows with coverage."""
    return col(A) * F.exp(-(col(Ea) + col(alpha) * col(theta)) / (R * col(T)))


def dissociative_rate(k, P, total_coverage) -> Column:
    free = F.greatest(1.0 - col(total_coverage), F.lit(0.0))
    return col(k) * col(P) * free * free


def clamp_coverage(theta) -> Column:
    return F.least(F.greatest(col(theta), F.lit(0.0)), F.lit(1.0))


def surface_concentration(theta, site_density) -> Column:
    return col(theta) * col(site_density) / N_A


def saturated(theta, tolerance: float = 1e-6) -> Column:
    return col(theta) >= 1.0 - tolerance
