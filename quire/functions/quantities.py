"""Quantities with units: construction, arithmetic, conversion, functions, TeX forms, ranges and lists.

A quantity is a struct column: magnitude; unit (its parts by name with TeX command and exponent, factor and shift to
base units, and the exponents of these); symbol; si_extra (options of the TeX command). All are Column builders, so
a quantity never changes: each operation makes a new one, without symbol and options unless it says otherwise.
A builder names its quantities several times, so give it columns: compute quantities in one select, show them in the
next, and no expression grows with the number of operations.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import units as U

KELVIN = 273.15
_PARTS = "array<struct<name:string,tex:string,power:int>>"
_UNIT = f"struct<parts:{_PARTS},factor:double,shift:double,dims:array<int>>"


def _unit(u: U.Unit) -> Column:
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("tex"), F.lit(p).alias("power")) for n, t, p in u.parts]).cast(_PARTS)
    return F.struct(parts.alias("parts"), F.lit(u.factor).alias("factor"), F.lit(u.shift).alias("shift"), F.array(*[F.lit(x) for x in u.dims]).alias("dims"))


def _made(magnitude: Column, unit: Column, symbol: Column | None = None, extra: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(magnitude.cast("double").alias("magnitude"), unit.alias("unit"), (none if symbol is None else symbol).cast("string").alias("symbol"), (none if extra is None else extra).cast("map<string,string>").alias("si_extra"))


def _fail(*words: str | Column) -> Column:
    return F.raise_error(F.concat(*[F.lit(w) if isinstance(w, str) else w for w in words]))


def quantity(magnitude: Column, unit: str | Column | None = "", symbol: Column | str | None = None, si_extra: dict[str, str] | Column | None = None, among: list[str] | None = None) -> Column:
    """A quantity. A null unit is dimensionless, an unknown one raises. unit may be a column of the expressions listed
    in among; another value of it raises when it is met."""
    if isinstance(unit, Column):
        known = F.create_map(*[x for n in among or () for x in (F.lit(n), _unit(U.parse(n)))]) if among else F.create_map().cast(f"map<string,{_UNIT}>")
        u = F.when(F.coalesce(unit, F.lit("")) == "", _unit(U.parse(""))).otherwise(F.coalesce(known[unit], _fail("unknown unit ", unit).cast(_UNIT)))
    else:
        u = _unit(U.parse(unit))
    extra = si_extra
    if isinstance(si_extra, dict):
        extra = F.create_map(*[F.lit(x) for kv in si_extra.items() for x in kv]) if si_extra else None
    return _made(magnitude, u, F.lit(symbol) if isinstance(symbol, str) else symbol, extra)


def mag(q: Column) -> Column:
    return q["magnitude"]


def symbol(q: Column) -> Column:
    return q["symbol"]


def unit_name(q: Column) -> Column:
    """The unit as text: factors with * and ** by name, those with negative exponents behind /; '' if there is none."""
    parts = q["unit"]["parts"]
    shown = lambda p: F.concat(p["name"], F.when(F.abs(p["power"]) == 1, "").otherwise(F.concat(F.lit(" ** "), F.abs(p["power"]).cast("string"))))
    up, down = (F.transform(F.filter(parts, f), shown) for f in (lambda p: p["power"] > 0, lambda p: p["power"] < 0))
    head = F.when((F.size(up) == 0) & (F.size(down) > 0), "1").otherwise(F.array_join(up, " * "))
    return F.concat(head, F.array_join(F.transform(down, lambda x: F.concat(F.lit(" / "), x)), ""))


def base(q: Column) -> Column:
    """Value in base units."""
    return q["magnitude"] * q["unit"]["factor"] + q["unit"]["shift"]


def _alike(a: Column, b: Column, value: Column, what: str) -> Column:
    return F.when(a["unit"]["dims"] == b["unit"]["dims"], value).otherwise(_fail(f"cannot {what} ", unit_name(a), " and ", unit_name(b)).cast("double"))


def _in_unit_of(q: Column, other: Column) -> Column:
    """The magnitude of q in another quantity's unit; raises where the dimensions differ."""
    return _alike(q, other, (base(q) - other["unit"]["shift"]) / other["unit"]["factor"], "convert between")


def to(q: Column, unit: str) -> Column:
    """Converted, with its symbol and options; raises where the dimensions differ."""
    target = _made(F.lit(0.0), _unit(U.parse(unit)))
    return _made(_in_unit_of(q, target), target["unit"], q["symbol"], q["si_extra"])


def simplify(q: Column) -> Column:
    """In base units."""
    parts = F.zip_with(q["unit"]["dims"], F.array(*[F.struct(F.lit(n).alias("name"), F.lit(U.single(n).parts[0][1]).alias("tex")) for n in U.BASE]), lambda p, u: F.struct(u["name"].alias("name"), u["tex"].alias("tex"), p.alias("power")))
    parts = F.array_sort(F.filter(parts, lambda p: p["power"] != 0))
    return _made(base(q), F.struct(parts.alias("parts"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("shift"), q["unit"]["dims"].alias("dims")))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """a + b (or a - b) in a's unit; raises where the dimensions differ. A plain number is quantity(number)."""
    return _made(_alike(a, b, a["magnitude"] + sign * (base(b) - a["unit"]["shift"]) / a["unit"]["factor"], "add"), a["unit"])


def negate(q: Column) -> Column:
    return _made(-q["magnitude"], q["unit"])


def _merged(parts: Column) -> Column:
    """Parts of the same name become one, those that cancel out go; by name."""
    names = F.array_distinct(F.transform(parts, lambda p: F.struct(p["name"].alias("name"), p["tex"].alias("tex"))))
    powers = F.transform(names, lambda n: F.struct(n["name"].alias("name"), n["tex"].alias("tex"), F.aggregate(F.filter(parts, lambda p: p["name"] == n["name"]), F.lit(0), lambda s, p: s + p["power"]).alias("power")))
    return F.array_sort(F.filter(powers, lambda p: p["power"] != 0))


def _scaled(parts: Column, power: int) -> Column:
    return F.transform(parts, lambda p: F.struct(p["name"].alias("name"), p["tex"].alias("tex"), (p["power"] * power).alias("power")))


def _no_shift(q: Column, value: Column) -> Column:
    return F.when(q["unit"]["shift"] == 0, value).otherwise(_fail("no product of ", unit_name(q)).cast("double"))


def multiply(a: Column, b: Column, power: int = 1) -> Column:
    """a * b (power -1: a / b), units multiplied. Units with a shift (celsius) raise."""
    ua, ub = a["unit"], b["unit"]
    unit = F.struct(
        _merged(F.concat(ua["parts"], _scaled(ub["parts"], power))).alias("parts"), (ua["factor"] * F.pow(ub["factor"], F.lit(float(power)))).alias("factor"), F.lit(0.0).alias("shift"), F.zip_with(ua["dims"], ub["dims"], lambda x, y: x + y * power).alias("dims")
    )
    return _made(_no_shift(a, _no_shift(b, a["magnitude"] * F.pow(b["magnitude"], F.lit(float(power))))), unit)


def scale(q: Column, by: float | Column) -> Column:
    """A quantity times a plain number, in its unit."""
    return _made(q["magnitude"] * by, q["unit"])


def power(q: Column, exponent: int) -> Column:
    u = q["unit"]
    unit = F.struct(F.filter(_scaled(u["parts"], exponent), lambda p: p["power"] != 0).alias("parts"), F.pow(u["factor"], F.lit(float(exponent))).alias("factor"), F.lit(0.0).alias("shift"), F.transform(u["dims"], lambda x: x * exponent).alias("dims"))
    return _made(_no_shift(q, F.pow(q["magnitude"], F.lit(float(exponent)))), unit)


def equal(a: Column, b: Column) -> Column:
    """Physical equality: the same dimensions and, to twelve digits, the same value in base units."""
    return (a["unit"]["dims"] == b["unit"]["dims"]) & (F.abs(base(a) - base(b)) <= 1e-12 * F.greatest(F.abs(base(a)), F.abs(base(b))))


def _number(q: Column) -> Column:
    """The value of a dimensionless quantity (an angle in radians); others raise."""
    return F.when(F.forall(q["unit"]["dims"], lambda x: x == 0), base(q)).otherwise(_fail("not dimensionless: ", unit_name(q)).cast("double"))


def apply(q: Column, name: str) -> Column:
    """A function of a quantity, which must be dimensionless: sin, cos and log give a number, arcsin, arccos and arctan
    an angle in radians, degrees an angle in degrees."""
    x = _number(q)
    made = {"sin": (F.sin, ""), "cos": (F.cos, ""), "log": (F.ln, ""), "arcsin": (F.asin, "radian"), "arccos": (F.acos, "radian"), "arctan": (F.atan, "radian"), "degrees": (lambda v: v * (180 / pi), "degree")}
    f, unit = made[name]
    return quantity(f(x), unit)


def approximate(q: Column, digits: int | Column) -> Column:
    """The magnitude rounded to so many valid digits, with symbol and options."""
    return _made(N.approximate(q["magnitude"], digits), q["unit"], q["symbol"], q["si_extra"])


def tex_unit(q: Column) -> Column:
    """The unit's TeX commands, by name, those with negative exponents after the others."""
    up = lambda p: F.when(F.abs(p) == 1, "").when(F.abs(p) == 2, "\\squared").when(F.abs(p) == 3, "\\cubed").otherwise(F.concat(F.lit("\\tothe{"), F.abs(p).cast("string"), F.lit("}")))
    parts = q["unit"]["parts"]
    above = F.transform(F.filter(parts, lambda p: p["power"] > 0), lambda p: F.concat(p["tex"], up(p["power"])))
    below = F.transform(F.filter(parts, lambda p: p["power"] < 0), lambda p: F.concat(F.lit("\\per"), p["tex"], up(p["power"])))
    return F.array_join(F.concat(above, below), "")


def tex_extra(extra: Column) -> Column:
    """Options in brackets, '' if there are none."""
    shown = F.transform(F.map_entries(extra), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(extra.isNull() | (F.size(extra) == 0), "").otherwise(F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")))


def tex(q: Column, formatted: Column | None = None) -> Column:
    """TeX form; formatted: its magnitude as text, else in general notation. A dimensionless one has an empty unit."""
    shown = N.general(q["magnitude"]) if formatted is None else formatted
    plain = F.size(q["unit"]["parts"]) == 0
    return F.concat(F.when(plain, "\\num").otherwise("\\qty"), tex_extra(q["si_extra"]), F.lit("{"), shown, F.lit("}{"), tex_unit(q), F.lit("}"))


def equals(q: Column, formatted: Column | None = None) -> Column:
    """symbol = TeX form."""
    return F.concat(q["symbol"], F.lit(" = "), tex(q, formatted))


def _union(a: Column, b: Column) -> Column:
    """Options of both, those of b going before."""
    x, y = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (a, b))
    kept = F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("key"), F.coalesce(y[e["key"]], e["value"]).alias("value")))
    return F.map_from_entries(F.concat(kept, F.filter(F.map_entries(y), lambda e: ~F.map_contains_key(x, e["key"]))))


def span(low: Column, high: Column) -> Column:
    """A range (low, high) of quantities, both in low's unit; raises where the dimensions differ."""
    return F.struct(low.alias("low"), _made(_in_unit_of(high, low), low["unit"], high["symbol"], high["si_extra"]).alias("high"))


def widen(r: Column, by: float) -> Column:
    """A range made wider by a share at both ends."""
    return F.struct(scale(r["low"], 1 - by).alias("low"), scale(r["high"], 1 + by).alias("high"))


def tex_range(r: Column, shown=N.general) -> Column:  # noqa: ANN001
    """TeX form of a range; shown formats a magnitude."""
    low, high = r["low"], r["high"]
    return F.concat(F.lit("\\qtyrange"), tex_extra(_union(low["si_extra"], high["si_extra"])), F.lit("{"), shown(low["magnitude"]), F.lit("}{"), shown(high["magnitude"]), F.lit("}{"), tex_unit(low), F.lit("}"))


def tex_list(qs: Column, shown=N.general) -> Column:  # noqa: ANN001
    """TeX form of an array of quantities, all in the unit of the first; raises where the dimensions differ."""
    first = qs[0]
    extra = F.aggregate(qs, F.create_map().cast("map<string,string>"), lambda m, q: _union(m, q["si_extra"]))
    return F.concat(F.lit("\\qtylist"), tex_extra(extra), F.lit("{"), F.array_join(F.transform(qs, lambda q: shown(_in_unit_of(q, first))), ";"), F.lit("}{"), tex_unit(first), F.lit("}"))


def celsius(kelvin: Column) -> Column:
    return kelvin - KELVIN


def kelvin(celsius_: Column) -> Column:
    return celsius_ + KELVIN
