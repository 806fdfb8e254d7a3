"""Diffusion and advection formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col
from .constants import HUGE, R, TINY

INF = float("inf")


def diffusivity(model, T, C, D0, p1=0.0, p2=0.0) -> Column:
    """By model: ``constant`` D0; ``arrhenius`` D0 exp(-p1/RT); ``chapman_enskog``
    D0 T^1.5 / p1; ``concentration`` D0 (1 + p1 C + p2 C^2)."""
    known = isinstance(model, str) and model in ("constant", "arrhenius", "chapman_enskog", "concentration")
    model, T, C, D0, p1, p2 = F.lit(model) if known else col(model), col(T), col(C), col(D0), col(p1), col(p2)
    return F.when(model == "constant", D0).when(model == "arrhenius", D0 * F.exp(-p1 / (R * T))).when(model == "chapman_enskog", D0 * F.pow(T, F.lit(1.5)) / p1).when(model == "concentration", D0 * (1.0 + p1 * C + p2 * C * C))


def tensor_mean(dx, dy, dz) -> Column:
    return (col(dx) + col(dy) + col(dz)) / 3.0


def tensor_isotropic(dx, dy, dz, tolerance: float = 1e-12) -> Column:
    return (F.abs(col(dx) - col(dy)) < tolerance) & (F.abs(col(dy) - col(dz)) < tolerance)


def fick_flux(D, *gradient) -> list[Column]:
    """-D grad C, component by component; D may be one column or one for each axis."""
    each = D if isinstance(D, (list, tuple)) else [D] * len(gradient)
    return [-(col(d) * col(g)) for d, g in zip(each, gradient, strict=True)]


def magnitude(*components) -> Column:
    return F.sqrt(sum((col(c) * col(c) for c in components), start=F.lit(0.0)))


def _positive(D: Column, value: Column) -> Column:
    return F.when(D <= 0, F.raise_error("diffusivity must be positive").cast("double")).otherwise(value)


def diffusion_time(L, D) -> Column:
    L, D = col(L), col(D)
    return _positive(D, L * L / F.when(D > 0, D))


def diffusion_length(D, t) -> Column:
    return F.sqrt(col(D) * col(t))


def peclet(v, L, D, guarded: bool = True) -> Column:
    """v L / D; infinite for D <= 0, or a failure where ``guarded`` is off."""
    v, L, D = col(v), col(L), col(D)
    ratio = v * L / F.when(D > 0, D)
    return F.when(D <= 0, F.lit(INF)).otherwise(ratio) if guarded else _positive(D, ratio)


def schmidt(nu, D) -> Column:
    nu, D = col(nu), col(D)
    return F.when(D <= 0, F.lit(INF)).otherwise(nu / F.when(D > 0, D))


def turbulent_diffusivity(eddy, schmidt_number=0.7) -> Column:
    return col(eddy) / col(schmidt_number)


def optimal_spacing(v, D) -> Column:
    """2 D / |v|; the largest double for v = 0."""
    v, D = col(v), col(D)
    return F.when(v == 0, F.lit(1.7976931348623157e308)).otherwise(2.0 * D / F.when(v != 0, F.abs(v)))


def advection_term(velocity, gradient) -> Column:
    return sum((col(v) * col(g) for v, g in zip(velocity, gradient, strict=True)), start=F.lit(0.0))


def material_derivative(dcdt, velocity, gradient) -> Column:
    return col(dcdt) + advection_term(velocity, gradient)


def courant(v, dt, dx) -> Column:
    return col(v) * col(dt) / col(dx)


def max_advective_dt(v, dx, cfl=1.0) -> Column:
    v, dx = col(v), col(dx)
    return F.when(v < TINY, F.lit(HUGE)).otherwise(col(cfl) * dx / F.when(v >= TINY, v))


def adr_rhs(velocity, gradient, D, laplacian, source) -> Column:
    return -advection_term(velocity, gradient) + col(D) * col(laplacian) + col(source)


def regime(pe, low: float = 0.1, high: float = 10.0) -> Column:
    pe = col(pe)
    return F.when(pe < low, F.lit("diffusion")).when(pe > high, F.lit("advection")).otherwise(F.lit("mixed"))


def advection_time(L, v) -> Column:
    L, v = col(L), col(v)
    return F.when(v < TINY, F.lit(HUGE)).otherwise(L / F.when(v >= TINY, v))


def advection_step(C, dt, velocity, gradient) -> Column:
    return col(C) - col(dt) * advection_term(velocity, gradient)


def diffusion_step(C, dt, D, laplacian) -> Column:
    return col(C) + col(dt) * col(D) * col(laplacian)


def strang_step(C, dt, velocity, gradient, D, laplacian) -> Column:
    """Half diffusion, whole advection, half diffusion."""
    half = 0.5 * col(dt)
    return diffusion_step(advection_step(diffusion_step(C, half, D, laplacian), dt, velocity, gradient), half, D, laplacian)


def boundary_gradient(kind, C, D, value, flux, h, ambient) -> Column:
    """``dirichlet``: the value; ``neumann``: -q/D; ``robin``: -h (C - C_inf) / D.  Fails for
    the last two where |D| is below 1e-15."""
    kind, C, D, value, flux, h, ambient = map(col, (kind, C, D, value, flux, h, ambient))
    safe = F.when(F.abs(D) < TINY, F.raise_error("diffusion coefficient too small").cast("double")).otherwise(D)
    return F.when(kind == "dirichlet", value).when(kind == "neumann", -flux / safe).when(kind == "robin", -h * (C - ambient) / safe)


def convective_outflow(C, upwind, v, dt, dn) -> Column:
    C, upwind, v, dt, dn = map(col, (C, upwind, v, dt, dn))
    return C - dt * v * (C - upwind) / F.when(dn > 0, dn).otherwise(F.raise_error("grid spacing must be positive").cast("double"))


def total_flux(C, gradient, D, v) -> Column:
    return -col(D) * col(gradient) + col(v) * col(C)


def biot(h, L, D) -> Column:
    h, L, D = col(h), col(L), col(D)
    return F.when(F.abs(D) < TINY, F.lit(HUGE)).otherwise(h * L / F.when(F.abs(D) >= TINY, D))


def upwind_flux(left, right, v) -> Column:
    v = col(v)
    return F.when(v > 0, v * col(left)).otherwise(v * col(right))


def central_flux(left, right, v) -> Column:
    return col(v) * (0.5 * (col(left) + col(right)))


def face_flux(scheme: str, left, right, v) -> Column:
    """``upwind`` or ``central``; the higher-order names fall back to upwind."""
    if scheme not in ("upwind", "central", "quick", "weno"):
        raise ValueError(f"unknown scheme {scheme}")
    return central_flux(left, right, v) if scheme == "central" else upwind_flux(left, right, v)


def van_leer(r) -> Column:
    r = col(r)
    return F.when(r <= 0, F.lit(0.0)).otherwise((r + F.abs(r)) / (1.0 + F.abs(r)))


def stable_dt(dx, D, v, safety: float = 0.9) -> Column:
    """safety * min(dx^2 / 2D, dx / v), each only where its divisor is positive."""
    dx, D, v = col(dx), col(D), col(v)
    big = F.lit(1.7976931348623157e308)
    return F.least(F.when(D > 0, dx * dx / (2.0 * F.when(D > 0, D))).otherwise(big), F.when(v > 0, dx / F.when(v > 0, v)).otherwise(big)) * safety


def diffusion_cfl(D, dt, *spacing) -> Column:
    return col(D) * col(dt) * sum((1.0 / (col(h) * col(h)) for h in spacing), start=F.lit(0.0))


def max_diffusion_dt(D, *spacing) -> Column:
    """The step at which the explicit scheme's number reaches 1/2."""
    return 0.5 / (col(D) * sum((1.0 / (col(h) * col(h)) for h in spacing), start=F.lit(0.0)))
