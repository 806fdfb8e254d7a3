"""Boundary-value generators f(x, y, z, t)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col


def sinusoid(t, amplitude, frequency, phase=0.0) -> Column:
    return col(amplitude) * F.sin(2.0 * math.pi * col(frequency) * col(t) + col(phase))


def ramp(t, start, end, duration) -> Column:
    """From start to end over duration, constant before and after."""
    t, start, end, duration = map(col, (t, start, end, duration))
    return F.when(t <= 0, start).when(t >= duration, end).otherwise(start + (end - start) * t / duration)


def step(t, before, after, at) -> Column:
    return F.when(col(t) < col(at), col(before)).otherwise(col(after))


def parabola(y, peak, height) -> Column:
    """0 at y = 0 and y = height, ``peak`` in the middle."""
    y, peak, height = map(col, (y, peak, height))
    return 4.0 * peak * (y / height) * (1.0 - y / height)


def decay(t, initial, rate) -> Column:
    return col(initial) * F.exp(-col(rate) * col(t))


def pulsating(t, mean, amplitude, frequency) -> Column:
    return col(mean) + sinusoid(t, amplitude, frequency)


def gaussian(x, y, z, peak, cx, cy, cz, sigma) -> Column:
    x, y, z, peak, cx, cy, cz, sigma = map(col, (x, y, z, peak, cx, cy, cz, sigma))
    r2 = (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)
    return peak * F.exp(-r2 / (2.0 * sigma * sigma))


def robin(kind: str, h=0.0, k=1.0, ambient=0.0) -> tuple[Column, Column, Column]:
    """(alpha, beta, gamma) of alpha u + beta du/dn = gamma."""
    if kind in ("convection", "radiation"):
        return col(h), col(k), col(h) * col(ambient)
    if kind == "impedance":
        return F.lit(1.0), col(k), F.lit(0.0)
    if kind == "absorbing":
        return F.lit(1.0), F.lit(1.0), F.lit(0.0)
    raise ValueError(f"unknown kind {kind}")


def dirichlet_like(alpha, beta, tolerance: float = 1e-10) -> Column:
    return (F.abs(col(beta)) < tolerance) & (F.abs(col(alpha)) >= tolerance)


def neumann_like(alpha, beta, tolerance: float = 1e-10) -> Column:
    return (F.abs(col(alpha)) < tolerance) & (F.abs(col(beta)) >= tolerance)


def evaluate(kind, y, t, params) -> Column:
    """The value of a boundary row: constant, sinusoid, ramp, step, parabola or decay, with its
    parameters in an array."""
    kind, params = col(kind), col(params)
    p = [F.try_element_at(params, F.lit(k + 1)) for k in range(3)]
    return F.when(kind == "constant", p[0]).when(kind == "sinusoid", sinusoid(t, p[0], p[1])).when(kind == "ramp", ramp(t, p[0], p[1], p[2])).when(kind == "step", step(t, p[0], p[1], p[2])).when(kind == "parabola", parabola(y, p[0], p[1])).when(kind == "decay", decay(t, p[0], p[1]))
