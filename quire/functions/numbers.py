"""Numbers as text: Roman numerals, ordinals, plurals, fixed and general notation. All are Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The symbols of Roman numerals, largest first.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
LARGEST_ROMAN = 4000


def _fail(message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), value.cast("string"))).cast("string")


def roman(n: Column, strict: bool = True) -> Column:
    """Roman numeral of 1 to 4000. Others raise (strict) or give null; null gives null."""
    n = n.cast("int")
    parts, rest = [], n
    for value, symbol in ROMAN:
        parts.append(F.repeat(F.lit(symbol), F.floor(rest / value).cast("int")))
        rest = rest % value
    ok = (n >= 1) & (n <= LARGEST_ROMAN)
    return F.when(n.isNull(), None).when(ok, F.concat(*parts)).otherwise(_fail("no Roman numeral for ", n) if strict else F.lit(None))


def plural(n: Column, one: Column, few: Column, many: Column, slavic_two: bool = False) -> Column:
    """one for 1, few for 3 and 4 (with slavic_two also for 2), else many; null gives null."""
    return F.when(n.isNull(), None).when(n == 1, one).when((n > (1 if slavic_two else 2)) & (n < 5), few).otherwise(many)


def ordinal_suffix(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    return F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")


def nth(n: Column) -> Column:
    """English ordinal of a number of at least 0; null for negative and null ones."""
    return F.when(n >= 0, F.concat(n.cast("string"), ordinal_suffix(n)))


def upnth(n: Column) -> Column:
    """TeX ordinal with a raised ending."""
    return F.when(n >= 0, F.concat(F.lit("$"), n.cast("string"), F.lit("^{\\mathrm{"), ordinal_suffix(n), F.lit("}}$")))


def cut_extra_one(s: Column) -> Column:
    """Drops a mantissa of exactly 1 before an exponent: 1e+09 to e+09; negative numbers stay."""
    return F.when(F.startswith(s, F.lit("1")) & F.rlike(s, F.lit(r"^1\.?e[+-]?[0-9]+")), F.substring(s, 2, 1_000_000)).otherwise(s)


def fixed(x: Column, digits: int = 6) -> Column:
    """Fixed notation, which has no exponent and so no extra one. Ties of the shortest decimal form are rounded away
    from zero; null gives null."""
    x = x.cast("double")
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def general(x: Column, digits: int | Column = 6) -> Column:
    """General notation as C's %g, without the extra one: scientific for exponents under -4 or from digits on, no
    trailing zeros. Null gives null, others than numbers nan and inf.

    Java's %g picks the notation by the same rule, but keeps zeros at the end; these are trimmed in plain string
    functions. The formatted text is tested first of all, so generated code makes it once.
    """
    x = x.cast("double")
    if isinstance(digits, Column):
        s = F.call_function("format_string", F.concat(F.lit("%."), F.greatest(digits, F.lit(1)).cast("string"), F.lit("g")), x)
    else:
        s = F.format_string(f"%.{max(1, digits)}g", x)
    head, tail = F.substring_index(s, "e", 1), F.concat(F.lit("e"), F.substring_index(s, "e", -1))
    trimmed = F.when(F.contains(head, F.lit(".")), F.rtrim(F.rtrim(head, F.lit("0")), F.lit("."))).otherwise(head)
    shown = F.when(F.contains(s, F.lit("e")), F.concat(F.when(trimmed == "1", "").otherwise(trimmed), tail)).when(F.startswith(s, F.lit("N")), "nan").when(F.contains(s, F.lit("I")), F.replace(s, F.lit("Infinity"), F.lit("inf"))).when(x == 0, "0").otherwise(trimmed)
    return F.concat(shown, F.when(x.isNotNull(), ""))


def num(s: Column) -> Column:
    """A formatted number in TeX's num command."""
    return F.concat(F.lit("\\num{"), s, F.lit("}"))


def approximate(x: Column, digits: int | Column) -> Column:
    """x rounded to so many valid digits, half away from zero; 0 for 0."""
    p = (digits - 1 if isinstance(digits, Column) else F.lit(digits - 1)) - F.when(x == 0, 1.0).otherwise(F.floor(F.log10(F.abs(x))).cast("double"))
    scale = F.pow(F.lit(10.0), F.abs(p))
    up = F.when(p >= 0, F.abs(x) * scale).otherwise(F.abs(x) / scale)
    whole = F.floor(up + 0.5).cast("double")
    return F.signum(x) * F.when(p >= 0, whole / scale).otherwise(whole * scale)


def shorthand(name: str):  # noqa: ANN201
    """The formatter that a short name stands for: f0 to f9 and g0 to g9 (fixed and general notation of a number), nf and
    ng (in TeX's num command), ef and eg (of a quantity, with its symbol); these take a number of digits, too (nf2).
    Without one, six digits. Unknown names raise KeyError."""
    m = re.fullmatch(r"([ne]?)([fg])(\d?)", name)
    if not m or not (m[1] or m[3]):
        raise KeyError(name)
    digits = int(m[3]) if m[3] else 6
    plain = lambda x: (fixed if m[2] == "f" else general)(x, digits)
    if m[1] == "e":
        from quire.functions import quantities as Q

        return lambda q: Q.equals(q, plain(Q.mag(q)))
    return (lambda x: num(plain(x))) if m[1] else plain
