"""Two-species reaction-diffusion models: reactions, equilibria, Jacobians, Turing analysis."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col

Pair = tuple[Column, Column]


def gray_scott(u, v, feed, kill) -> Pair:
    u, v, feed, kill = map(col, (u, v, feed, kill))
    return -u * v * v + feed * (1.0 - u), u * v * v - (feed + kill) * v


def brusselator(u, v, a, b) -> Pair:
    u, v, a, b = map(col, (u, v, a, b))
    return a - (b + 1.0) * u + u * u * v, b * u - u * u * v


def schnakenberg(u, v, a, b) -> Pair:
    u, v, a, b = map(col, (u, v, a, b))
    return a - u + u * u * v, b - u * u * v


MODELS: dict[str, Callable[..., Pair]] = {"gray_scott": gray_scott, "brusselator": brusselator, "schnakenberg": schnakenberg}


def rhs(D, laplacian, reaction: Column) -> Column:
    return col(D) * col(laplacian) + reaction


def equilibrium(model: str, p, q) -> Pair:
    p, q = col(p), col(q)
    if model == "gray_scott":
        return F.lit(1.0), F.lit(0.0)
    if model == "brusselator":
        return p, q / p
    return p + q, q / ((p + q) * (p + q))


def jacobian(model: str, p, q) -> tuple[Column, Column, Column, Column]:
    """f_u, f_v, g_u, g_v at the equilibrium."""
    p, q = col(p), col(q)
    if model == "gray_scott":
        return -p, F.lit(0.0), F.lit(0.0), -(p + q)
    if model == "brusselator":
        return q - 1.0, p * p, -q, -(p * p)
    u, v = equilibrium(model, p, q)
    return -1.0 + 2.0 * u * v, u * u, -2.0 * u * v, -(u * u)


def oscillatory(a, b) -> Column:
    return col(b) > 1.0 + col(a) * col(a)


def turing(Du, Dv, fu, fv, gu, gv) -> dict[str, Column]:
    Du, Dv, fu, fv, gu, gv = map(col, (Du, Dv, fu, fv, gu, gv))
    trace, det = fu + gv, fu * gv - fv * gu
    first = Dv * fu + Du * gv
    stable = (trace < 0) & (det > 0)
    unstable = (first > 0) & (first * first - 4.0 * Du * Dv * det > 0)
    forms = stable & unstable
    return {"trace": trace, "determinant": det, "diffusion_ratio": Dv / Du, "stable_without_diffusion": stable, "unstable_with_diffusion": unstable, "can_form_patterns": forms, "critical_wavenumber": F.when(forms, F.sqrt(F.when(forms, first) / (2.0 * Du * Dv))).otherwise(F.lit(0.0))}


def wavelength(k) -> Column:
    k = col(k)
    return F.when(k <= 0, F.lit(0.0)).otherwise(2.0 * math.pi / F.when(k > 0, k))


def regime_name(feed, kill) -> Column:
    """The first fitting of an ordered list of regions of the (feed, kill) plane."""
    feed, kill = col(feed), col(kill)
    # fixed values: the regions' limits and names
    return F.when((feed < 0.03) & (kill < 0.06), "Spots").when((feed < 0.04) & (kill > 0.06), "Stripes").when((feed > 0.05) & (kill < 0.065), "Spirals").when((feed > 0.06) & (kill > 0.06), "Chaos").otherwise("Uniform")
