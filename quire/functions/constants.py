"""The catalogue of physical constants: by name or alias, as quantities, in their textual forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import quantities as Q

# Name, TeX symbol, aliases, magnitude, unit, valid digits, whether exact, whether in fixed notation.
CONSTANTS: tuple[tuple[str, str, tuple[str, ...], float, str | None, int, bool, bool], ...] = (
    ("planck", "h", ("h",), 6.62607015e-34, "joule second", 4, True, False),
    ("planck_bar", "\\hbar", ("hbar",), 1.054571817e-34, "joule second", 4, True, False),
    ("speed_light", "c", ("c",), 299792458, "metre / second", 1, True, False),
    ("gravity", "G", ("G",), 6.6743e-11, "newton metre squared / kilogram squared", 3, False, False),
    ("inch", "\\mathrm{in}", (), 0.0254, "metre", 3, True, False),
    ("foot", "\\mathrm{ft}", ("ft",), 0.3048, "metre", 4, True, False),
    ("mile", "\\mathrm{mi}", (), 1609.344, "metre", 2, True, False),
    ("us_pint", "\\mathrm{pt}", (), 473.176473, "millilitre", 3, False, False),
    ("pound", "\\mathrm{lb}", ("lb",), 0.45359237, "kilogram", 4, False, False),
    ("gforce", "g", ("g",), 9.80665, "metre / s^2", 1, False, True),
    ("radius_earth", "R_{\\oplus}", ("r_E",), 6378000, "metre", 4, False, False),
    ("mass_earth", "M_{\\oplus}", ("m_E",), 5.972168e24, "kilogram", 2, False, False),
    ("eccentricity_earth", "e_{\\Earth}", ("e_E",), 0.0167086, None, 2, False, False),
    ("obliquity_earth", "\\epsilon_{\\Earth}", (), 23.4392811, "degree", 3, False, False),
    ("radius_sun", "R_{\\odot}", (), 6.957e8, "metre", 2, False, False),
    ("mass_sun", "M_{\\odot}", (), 1.988475e30, "kilogram", 2, False, False),
    ("temperature_sun", "T_{\\odot}", (), 5777, "kelvin", 4, False, False),
    ("radius_mars", "R_\\Mars", (), 3390000, "metre", 4, False, False),
    ("tropical_year", "y", (), 31556926, "second", 5, False, False),
    ("day", "d", (), 86400, "second", 5, True, False),
    ("day_sidereal", "d", (), 86164.0905, "second", 5, False, False),
    ("mass_mars", "M_\\Mars", (), 6.417e23, "kilogram", 2, False, False),
    ("au", "\\mathrm{au}", (), 1.495978707e11, "metre", 2, False, False),
    ("parsec", "\\mathrm{pc}", ("pc",), 30856775814913673, "metre", 4, False, False),
    ("solar_flux", "F_{\\odot}", (), 1366, "watt per metre squared", 4, False, False),
    ("avogadro", "N_A", (), 6.02214076e23, "1 / mole", 4, False, False),
    ("universal_gas", "R", (), 8.31446261815324, "joule / kelvin / mole", 3, False, False),
    ("boltzmann", "k_B", (), 1.380649e-23, "joule / kelvin", 3, False, False),
    ("stefan_boltzmann", "\\sigma", (), 5.670374419e-8, "watt / metre squared / kelvin^4", 3, False, False),
    ("pressure_standard", "p_0", (), 101325, "pascal", 2, False, False),
    ("temperature_standard", "T_0", (), 0, "celsius", 1, False, False),
    ("speed_sound", "c_s", (), 343, "metre / second", 3, False, False),
    ("permittivity", "\\epsilon_0", ("eps0",), 8.8541878188e-12, "farad / metre", 4, False, False),
    ("permeability", "\\mu_0", ("mu0",), 1.25663706127e-6, "henry / metre", 3, False, False),
    ("elementary_charge", "e", ("e",), 1.602176634e-19, "coulomb", 2, False, False),
    ("mass_electron", "m_e", ("m_e",), 9.1093837139e-31, "kilogram", 3, False, False),
    ("mass_proton", "m_p", ("m_p",), 1.67262192595e-27, "kilogram", 3, False, False),
    ("amu", "u", (), 1.6605390689e-27, "kilogram", 3, False, False),
    ("refraction_water", "n_{\\ce{H2O}}", (), 1.333, None, 4, False, False),
    ("density_air", "\\rho_a", (), 1.28, "kilogram / metre cubed", 2, False, False),
    ("density_water", "\\rho_{\\ce{H2O}}", (), 998, "kilogram / metre cubed", 2, False, False),
    ("density_ice", "\\rho_{\\ce{H2O}}", (), 916, "kilogram / metre cubed", 3, False, False),
    ("density_helium", "\\rho_{\\ce{He}}", (), 0.18, "kilogram / metre cubed", 3, False, False),
    ("density_mercury", "\\rho_{\\ce{Hg}}", (), 13546, "kilogram / metre cubed", 3, False, False),
    ("density_gold", "\\rho_{\\ce{Au}}", (), 19283, "kilogram / metre cubed", 3, False, False),
    ("molar_mass_gold", "M_{\\ce{Au}}", (), 196.96657, "gram / mole", 3, False, False),
    ("molar_mass_air", "M_{\\mathrm{a}}", (), 28.9647, "gram / mole", 2, False, False),
    ("surface_tension_water", "\\sigma", (), 0.072, "newton / metre", 2, False, False),
    ("heat_capacity_water", "c_{\\ce{H2O}}", (), 4180, "joule / kilogram / kelvin", 3, False, False),
    ("heat_vaporization_water", "l_{\\ce{H2O}}", (), 2260, "kilojoule / kilogram", 2, False, False),
    ("heat_capacity_ice", "c_\\text{\\Snow}", (), 2093, "joule / kilogram / kelvin", 4, False, False),
    ("heat_melting_ice", "l_\\text{\\Snow}", (), 334000, "J / kg", 3, False, False),
    ("thermal_expansion_water", "\\beta_{\\ce{H2O}}", (), 1.8e-4, "1 / kelvin", 2, False, False),
)
# Options of the TeX command of some constants.
OPTIONS = {"avogadro": {"per-mode": "reciprocal"}, "thermal_expansion_water": {"per-mode": "reciprocal"}}
UNITS = sorted({c[4] for c in CONSTANTS if c[4]})
_NAMES = "name string, symbol string, aliases array<string>, magnitude double, unit string, digits int, exact boolean, force_f boolean, si_extra map<string,string>"


def catalogue(spark: SparkSession) -> DataFrame:
    """One row a constant."""
    return spark.createDataFrame([(n, s, list(a), float(m), u, d, e, f, OPTIONS.get(n)) for n, s, a, m, u, d, e, f in CONSTANTS], _NAMES)


def references(spark: SparkSession) -> DataFrame:
    """One row for each name or alias (ref) of a constant."""
    return catalogue(spark).withColumn("ref", F.explode(F.concat(F.array("name"), F.col("aliases"))))


def as_quantity(d: DataFrame, name: str = "q") -> DataFrame:
    """The catalogue with its constants as quantities."""
    return d.withColumn(name, Q.quantity(F.col("magnitude"), F.col("unit"), F.col("symbol"), F.col("si_extra"), UNITS))


def shown(q: Column, digits: Column, force_f: Column) -> Column:
    """To the constant's digits: valid digits, or with force_f decimal places."""
    return Q.tex(q, F.when(force_f, fixed(q["magnitude"], digits)).otherwise(N.general(q["magnitude"], digits)))


def fixed(x: Column, digits: Column) -> Column:
    """Fixed notation with a column of decimal places."""
    return F.call_function("format_string", F.concat(F.lit("%."), digits.cast("string"), F.lit("f")), x)


def fullf(q: Column, digits: Column) -> Column:
    return Q.tex(q, fixed(q["magnitude"], digits))


def fullg(q: Column, digits: Column) -> Column:
    return Q.tex(q, N.general(q["magnitude"], digits))


def full_exact(q: Column) -> Column:
    """In general notation, padded to 99 characters on the left."""
    return Q.tex(q, F.lpad(N.general(q["magnitude"]), 99, " "))
