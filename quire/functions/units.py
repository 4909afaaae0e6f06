"""Units by rule: prefixes and base units, expressions of them, their TeX forms and factors to base units."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from math import pi

# Prefixes, with their symbols, and powers of ten.
PREFIXES = {
    "quetta": ("Q", 30), "ronna": ("R", 27), "yotta": ("Y", 24), "zetta": ("Z", 21), "exa": ("E", 18), "peta": ("P", 15), "tera": ("T", 12), "giga": ("G", 9), "mega": ("M", 6), "kilo": ("k", 3), "hecto": ("h", 2), "deca": ("da", 1),
    "deci": ("d", -1), "centi": ("c", -2), "milli": ("m", -3), "micro": ("µ", -6), "nano": ("n", -9), "pico": ("p", -12), "femto": ("f", -15), "atto": ("a", -18), "zepto": ("z", -21), "yocto": ("y", -24), "ronto": ("r", -27), "quecto": ("q", -30),
}
#: The base units, in the order of the exponents of a dimension.
BASE = ("meter", "kilogram", "second", "ampere", "kelvin", "mole", "candela")
# Name, other names and symbols, exponents of the base units, factor and shift to them.
UNITS: dict[str, tuple[tuple[str, ...], tuple[int, ...], float, float]] = {
    "meter": (("metre", "m"), (1, 0, 0, 0, 0, 0, 0), 1.0, 0.0),
    "gram": (("g",), (0, 1, 0, 0, 0, 0, 0), 0.001, 0.0),
    "second": (("s", "sec"), (0, 0, 1, 0, 0, 0, 0), 1.0, 0.0),
    "ampere": (("A", "amp"), (0, 0, 0, 1, 0, 0, 0), 1.0, 0.0),
    "kelvin": (("K",), (0, 0, 0, 0, 1, 0, 0), 1.0, 0.0),
    "mole": (("mol",), (0, 0, 0, 0, 0, 1, 0), 1.0, 0.0),
    "candela": (("cd",), (0, 0, 0, 0, 0, 0, 1), 1.0, 0.0),
    "radian": (("rad",), (0, 0, 0, 0, 0, 0, 0), 1.0, 0.0),
    "degree": (("deg",), (0, 0, 0, 0, 0, 0, 0), pi / 180, 0.0),
    "arcminute": (("arcmin",), (0, 0, 0, 0, 0, 0, 0), pi / 180 / 60, 0.0),
    "arcsecond": (("arcsec",), (0, 0, 0, 0, 0, 0, 0), pi / 180 / 3600, 0.0),
    "hertz": (("Hz",), (0, 0, -1, 0, 0, 0, 0), 1.0, 0.0),
    "newton": (("N",), (1, 1, -2, 0, 0, 0, 0), 1.0, 0.0),
    "pascal": (("Pa",), (-1, 1, -2, 0, 0, 0, 0), 1.0, 0.0),
    "joule": (("J",), (2, 1, -2, 0, 0, 0, 0), 1.0, 0.0),
    "watt": (("W",), (2, 1, -3, 0, 0, 0, 0), 1.0, 0.0),
    "coulomb": (("C",), (0, 0, 1, 1, 0, 0, 0), 1.0, 0.0),
    "volt": (("V",), (2, 1, -3, -1, 0, 0, 0), 1.0, 0.0),
    "farad": (("F",), (-2, -1, 4, 2, 0, 0, 0), 1.0, 0.0),
    "ohm": (("Ω",), (2, 1, -3, -2, 0, 0, 0), 1.0, 0.0),
    "siemens": (("S",), (-2, -1, 3, 2, 0, 0, 0), 1.0, 0.0),
    "weber": (("Wb",), (2, 1, -2, -1, 0, 0, 0), 1.0, 0.0),
    "tesla": (("T",), (0, 1, -2, -1, 0, 0, 0), 1.0, 0.0),
    "henry": (("H",), (2, 1, -2, -2, 0, 0, 0), 1.0, 0.0),
    "lumen": (("lm",), (0, 0, 0, 0, 0, 0, 1), 1.0, 0.0),
    "lux": (("lx",), (-2, 0, 0, 0, 0, 0, 1), 1.0, 0.0),
    "becquerel": (("Bq",), (0, 0, -1, 0, 0, 0, 0), 1.0, 0.0),
    "degree_Celsius": (("celsius", "degC"), (0, 0, 0, 0, 1, 0, 0), 1.0, 273.15),
    "minute": (("min",), (0, 0, 1, 0, 0, 0, 0), 60.0, 0.0),
    "hour": (("h", "hr"), (0, 0, 1, 0, 0, 0, 0), 3600.0, 0.0),
    "day": (("d",), (0, 0, 1, 0, 0, 0, 0), 86400.0, 0.0),
    "year": (("a", "yr"), (0, 0, 1, 0, 0, 0, 0), 31557600.0, 0.0),
    "liter": (("litre", "l", "L"), (3, 0, 0, 0, 0, 0, 0), 0.001, 0.0),
    "metric_ton": (("tonne", "t"), (0, 1, 0, 0, 0, 0, 0), 1000.0, 0.0),
    "electron_volt": (("eV",), (2, 1, -2, 0, 0, 0, 0), 1.602176634e-19, 0.0),
    "calorie": (("cal",), (2, 1, -2, 0, 0, 0, 0), 4.184, 0.0),
    "bar": ((), (-1, 1, -2, 0, 0, 0, 0), 1e5, 0.0),
    "astronomical_unit": (("au",), (1, 0, 0, 0, 0, 0, 0), 149597870700.0, 0.0),
    "light_year": (("ly",), (1, 0, 0, 0, 0, 0, 0), 9460730472580800.0, 0.0),
    "inch": (("in",), (1, 0, 0, 0, 0, 0, 0), 0.0254, 0.0),
    "foot": (("ft",), (1, 0, 0, 0, 0, 0, 0), 0.3048, 0.0),
    "mile": (("mi",), (1, 0, 0, 0, 0, 0, 0), 1609.344, 0.0),
    "pound": (("lb",), (0, 1, 0, 0, 0, 0, 0), 0.45359237, 0.0),
}
# Units whose TeX command isn't their name.
TEX = {"degree_Celsius": "celsius"}
_POWERS = {"squared": 2, "cubed": 3}


@dataclass(frozen=True)
class Unit:
    """parts: (name, TeX command, exponent), by name; dims: exponents of the base units; factor and shift to them."""

    parts: tuple[tuple[str, str, int], ...]
    dims: tuple[int, ...]
    factor: float
    shift: float


@cache
def _names() -> dict[str, str]:
    return {n: name for name, (others, *_) in UNITS.items() for n in (name, *others)}


@cache
def single(name: str) -> Unit:
    """A unit by its name or symbol, with or without a prefix; an unknown one raises KeyError."""
    known = _names()
    if name in known:
        prefix, plain = "", known[name]
    else:
        long = [(p, name[len(p) :]) for p in PREFIXES if name.startswith(p) and name[len(p) :] in known]
        short = [(p, name[len(s) :]) for p, (s, _) in PREFIXES.items() if name.startswith(s) and name[len(s) :] in known]
        if not long and not short:
            raise KeyError(f"unknown unit {name}")
        prefix, plain = (long or short)[0]
        plain = known[plain]
    _, dims, factor, shift = UNITS[plain]
    tex = f"\\{prefix}" * bool(prefix) + "\\" + TEX.get(plain, plain)
    return Unit(((prefix + plain, tex, 1),), dims, factor * (10.0 ** PREFIXES[prefix][1] if prefix else 1.0), shift)


@cache
def parse(text: str | None) -> Unit:
    """A unit expression: names with *, / (or per), blanks, ^ or ** and a number, squared, cubed. An empty or null one
    is dimensionless. Each sign of division holds for the next unit only."""
    made, sign, last = Unit((), (0,) * len(BASE), 1.0, 0.0), 1, None
    powers: dict[tuple[str, str], int] = {}
    factor, shift, dims, many = 1.0, 0.0, [0] * len(BASE), 0

    def put(unit: Unit, power: int) -> None:
        nonlocal factor, shift
        name, tex, _ = unit.parts[0]
        powers[name, tex] = powers.get((name, tex), 0) + power
        factor *= unit.factor**power
        shift = unit.shift
        for k, x in enumerate(unit.dims):
            dims[k] += x * power

    for word in re.findall(r"\*\*\s*-?\d+|\^\s*-?\d+|[*/]|[^\s*/^]+", text or ""):
        if m := re.fullmatch(r"(?:\*\*|\^)\s*(-?\d+)", word):
            put(last[0], last[1] * (int(m[1]) - 1))
        elif word in _POWERS:
            put(last[0], last[1] * (_POWERS[word] - 1))
        elif word in ("/", "per"):
            sign = -1
        elif word not in ("*", "1"):
            last = (single(word), sign)
            put(*last)
            many += 1
            sign = 1
        elif word == "1":
            sign = 1
    parts = tuple(sorted((n, t, p) for (n, t), p in powers.items() if p))
    if not parts:
        return made
    return Unit(parts, tuple(dims), factor, shift if many == 1 and parts[0][2] == 1 else 0.0)
