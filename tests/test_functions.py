"""Scalar formulas against independently computed values."""

import math

import pytest
from pyspark.sql import functions as F

from fieldlab.functions import boundary, kinetics, models, surface, text, thermo, transport, units


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "A,beta,Ea,T,want",
    [(1e13, 0, 1e5, 500, 357.0217595110907), (1e13, 0, 1e5, 1500, 3292796529.3542247), (1e10, 0, 5e4, 300, 19.67488661945756), (1e10, 0, 5e4, 400, 2954.161124729344), (1e14, 0.5, 8e4, 300, 20.361989477759128), (1e14, 0.5, 8e4, 500, 9809361.754646588)],
)
def test_arrhenius(spark, A, beta, Ea, T, want):
    assert value(spark, kinetics.arrhenius(A, float(beta), Ea, T)) == pytest.approx(want, rel=1e-9)


def test_arrhenius_needs_heat(spark):
    with pytest.raises(Exception, match="positive"):
        value(spark, kinetics.arrhenius(1.0, 0.0, 1.0, F.col("id") * 1.0))


def test_surface(spark):
    mw, sites = 0.028, 1.5e19
    assert value(spark, surface.collision_rate(1000.0, 300.0, mw, sites)) == pytest.approx(1916495.9153901094, rel=1e-9)
    assert value(spark, surface.adsorption_rate(1000.0, 300.0, mw, 0.8, 0.3, sites)) == pytest.approx(1073237.7126184613, rel=1e-9)
    assert value(spark, surface.desorption_rate(120000.0, 500.0, 0.5)) == pytest.approx(1.4527926283822536, rel=1e-9)
    k = value(spark, surface.langmuir_constant(0.8, mw, 120000.0, 400.0))
    named = math.sqrt(2 * math.pi * mw / 6.022e23 * 1.380649e-23 * 400) * 0.8 / 1e13 * math.exp(120000 / (8.314 * 400))
    assert k == pytest.approx(named, rel=1e-9)
    assert value(spark, surface.langmuir_coverage(k, 1 / k)) == pytest.approx(0.5)
    assert value(spark, surface.bet_coverage(100.0, 1500.0, 3000.0)) == pytest.approx(1.9801980198019802, rel=1e-12)
    assert value(spark, surface.freundlich(0.5, 1000.0, 2.0)) == pytest.approx(15.811388300841896, rel=1e-12)
    assert value(spark, surface.rate_constant(1e13, 1e5, 500.0) * 0.3 * 0.4) == pytest.approx(42.842611141330885, rel=1e-9)
    assert value(spark, surface.rate_constant(1e13, 1e5, 500.0, 20000.0, 0.5)) == pytest.approx(32.208029445769455, rel=1e-9)
    assert value(spark, surface.dissociative_rate(0.1, 1000.0, 0.3)) == pytest.approx(49.0)
    with pytest.raises(Exception, match="saturation"):
        value(spark, surface.bet_coverage(100.0, F.lit(3000.0) + F.col("id"), 3000.0))


def test_models(spark):
    u, v = models.gray_scott(0.5, 0.25, 0.04, 0.06)
    assert (value(spark, u), value(spark, v)) == (pytest.approx(-0.01125), pytest.approx(0.00625))
    j = [value(spark, c) for c in models.jacobian("schnakenberg", 0.1, 0.9)]
    assert j == [pytest.approx(x) for x in (0.8, 1, -1.8, -1)]
    t = {k: value(spark, c) for k, c in models.turing(1e-5, 1e-4, 0.8, 1.0, -1.8, -1.0).items()}
    assert t["can_form_patterns"] and t["critical_wavenumber"] == pytest.approx(187.08286933869704)
    assert value(spark, models.wavelength(t["critical_wavenumber"])) == pytest.approx(0.033585038167254284)
    assert value(spark, models.oscillatory(1.0, 3.0)) and not value(spark, models.oscillatory(1.0, 2.0))
    assert [value(spark, c) for c in models.equilibrium("brusselator", 1.0, 3.0)] == [1.0, 3.0]


def test_boundaries_and_transport(spark):
    assert value(spark, boundary.sinusoid(0.25, 10.0, 1.0)) == pytest.approx(10)
    assert [value(spark, boundary.ramp(t, 0.0, 100.0, 10.0)) for t in (-1.0, 5.0, 15.0)] == [0, 50, 100]
    assert value(spark, thermo.temperature_change(1000.0, 1000.0, 4000.0, 0.1)) == pytest.approx(2.5e-5)
    assert value(spark, transport.courant(1.0, 0.01, 0.1)) == pytest.approx(0.1)
    assert value(spark, transport.upwind_flux(1.0, 0.5, 1.0)) == 1.0
    assert value(spark, transport.peclet(1.0, 0.1, 0.01)) == pytest.approx(10) and value(spark, transport.peclet(1.0, 0.1, 0.0)) == math.inf
    assert value(spark, transport.schmidt(1e-5, 1e-6)) == pytest.approx(10)
    assert value(spark, transport.max_advective_dt(0.0, 0.1)) == 1e10
    with pytest.raises(Exception, match="positive"):
        value(spark, transport.diffusion_time(1.0, F.col("id") * 0.0))


def test_units():
    length, time = units.quantity(1.0, "m"), units.quantity(1.0, "min")
    with pytest.raises(units.DimensionError):
        length + time
    with pytest.raises(units.DimensionError):
        length.sqrt()
    assert (length / time).dim == (1, 0, -1, 0, 0, 0, 0) and (length / length).sqrt().dim == units.NONE


def test_text(spark):
    water = F.create_map(F.lit("O"), F.lit(1), F.lit("H"), F.lit(2))
    assert value(spark, text.formula(water)) == "H2O" and value(spark, text.formula(water, -2)) == "H2O-2"
    assert [value(spark, text.literal_type(F.lit(x))) for x in ("yes", "12", "1e-3", "[1, 2]", "abc")] == ["bool", "int", "float", "array", "string"]
    assert value(spark, text.parse_array(F.lit("[]"))) == [] and value(spark, text.parse_array(F.lit("[a, b]"))) == ["a", "b"]
    assert value(spark, text.env_to_key(F.lit("APP_SOLVER_TYPE"), "APP_")) == "solver.type"
    assert value(spark, text.to_double(F.lit("x"), 2.5)) == 2.5 and value(spark, text.to_bool(F.lit(" YES ")))
