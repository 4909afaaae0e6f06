import random

import pytest
from pyspark.sql import functions as F

from quire.functions import lists as L
from quire.functions import numbers as N
from quire.functions import quantities as Q
from quire.functions import units as U


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_roman(spark):
    known = {1: "I", 2: "II", 3: "III", 9: "IX", 49: "XLIX", 949: "CMXLIX", 1234: "MCCXXXIV", 1990: "MCMXC", 2022: "MMXXII", 4000: "MMMM"}
    got = dict(values(spark, [(k,) for k in known], "n int", "n", N.roman(F.col("n"))))
    assert got == known
    assert one(spark, N.roman(F.lit(None).cast("int"))) is None
    assert one(spark, N.roman(F.lit(0), strict=False)) is None
    with pytest.raises(Exception, match="Roman"):
        one(spark, N.roman(F.lit(0)))


def test_ordinals_and_plurals(spark):
    known = {0: "0th", 1: "1st", 2: "2nd", 3: "3rd", 4: "4th", 11: "11th", 12: "12th", 13: "13th", 21: "21st", 101: "101st", 111: "111th"}
    assert dict(values(spark, [(k,) for k in known], "n int", "n", N.nth(F.col("n")))) == known
    words = [F.lit(x) for x in ("a", "b", "c")]
    assert values(spark, [(n,) for n in (1, 2, 3, 4, 5, None)], "n int", N.plural(F.col("n"), *words), N.plural(F.col("n"), *words, slavic_two=True)) == [("a", "a"), ("c", "b"), ("b", "b"), ("b", "b"), ("c", "c"), (None, None)]


def test_general_is_like_c(spark):
    rng = random.Random(4)
    xs = [rng.uniform(-9, 9) * 10 ** rng.randint(-9, 12) for _ in range(400)] + [0.0, 123456789.0, 3.14e15, 2.4433e-19]
    for p in (1, 3, 6):
        got = values(spark, [(x,) for x in xs], "x double", "x", N.general(F.col("x"), p))
        for x, s in got:
            want = f"{x:.{p}g}"
            if want.startswith(("1e", "1.e")):
                want = want[1:]
            assert s == want
    assert one(spark, N.general(F.lit(1e9), 6)) == "e+09"
    assert one(spark, N.general(F.lit(None).cast("double"))) is None


def test_approximate(spark):
    assert one(spark, N.approximate(F.lit(299792458.0), 1)) == 3e8
    assert one(spark, N.approximate(F.lit(9.80665), 1)) == 10
    assert one(spark, N.approximate(F.lit(-2.5), 1)) == -3
    assert one(spark, N.approximate(F.lit(0.0), 3)) == 0


def test_lists_and_people(spark):
    x = F.col("x")
    rows = [([],), (["x"],), (["x", "y"],), (["x", "y", "z"],), (None,), (["x", None],)]
    assert values(spark, rows, "x array<string>", L.render_list(x)) == [("",), ("x",), ("x a y",), ("x, y a z",), (None,), ("x",)]
    f = lambda i: F.concat(F.lit("f("), i, F.lit(")"))
    assert values(spark, [(["x", "y", "z"],)], "x array<string>", L.render_list(x, f, "und", True)) == [("f(x), f(y), und f(z)",)]
    p = F.col("p")
    rows = [([("Jaro", "m"), ("Moczo", "m")],), ([("Eva", "f")],), ([("", "?")],), ([],), (None,)]
    assert values(spark, rows, "p array<struct<name string, gender string>>", L.render_people(p), L.gender_suffix(p)) == [("Jaro a Moczo", "i"), ("Eva", "a"), (L.UNKNOWN, L.UNKNOWN), ("", None), (None, None)]


def test_dates(spark):
    assert one(spark, L.isotex(F.to_date(F.lit("2021-09-23")))) == "2021--09--23"


def test_quantities(spark):
    kg, g, m = Q.quantity(F.lit(1.0), "kilogram"), Q.quantity(F.lit(7000.0), "gram"), Q.quantity(F.lit(2.0), "metre")
    assert one(spark, Q.to(Q.add(kg, g), "gram")["magnitude"]) == 8000
    assert one(spark, Q.equal(Q.quantity(F.lit(8.0), "kg"), Q.quantity(F.lit(8000.0), "g")))
    with pytest.raises(Exception, match="cannot"):
        one(spark, Q.add(kg, m)["magnitude"])
    assert one(spark, Q.to(Q.quantity(F.lit(25.0), "celsius"), "kelvin")["magnitude"]) == pytest.approx(298.15)
    assert one(spark, Q.tex(Q.quantity(F.lit(5.0)), F.lit("5"))) == "\\num{5}{}"
    with pytest.raises(Exception, match="dimensionless"):
        one(spark, Q.apply(m, "sin")["magnitude"])
    with pytest.raises(Exception, match="product"):
        one(spark, Q.multiply(Q.quantity(F.lit(1.0), "celsius"), m)["magnitude"])
    with pytest.raises(KeyError):
        Q.quantity(F.lit(1.0), "furlongs")
    null = Q.quantity(F.lit(None).cast("double"), "m")
    assert one(spark, Q.tex(null)) is None and one(spark, Q.mag(Q.add(null, m))) is None


def test_ranges_and_lists(spark):
    q = lambda x, u, **k: Q.quantity(F.lit(x), u, **k)
    assert one(spark, Q.tex_range(Q.span(q(1.0, "kg"), q(7.0, "kg")))) == "\\qtyrange{1}{7}{\\kilo\\gram}"
    with pytest.raises(Exception, match="cannot"):
        one(spark, Q.tex_range(Q.span(q(1.0, "kg"), q(2.0, "m"))))
    sun = q(2e30, "kg", si_extra={"forbid-literal-units": "false"})
    assert one(spark, Q.tex_list(F.array(q(1.0, "kg"), q(7.0, "kg"), sun))) == "\\qtylist[forbid-literal-units=false]{1;7;2e+30}{\\kilo\\gram}"
    assert one(spark, Q.tex_list(F.array(q(2.0, "m"), q(320.0, "cm")), lambda x: N.general(x, 6))) == "\\qtylist{2;3.2}{\\meter}"
    with pytest.raises(Exception, match="cannot"):
        one(spark, Q.tex_list(F.array(q(2.0, "m"), q(7.0, "kg"))))


def test_units():
    assert U.parse("newton metre squared / kilogram squared").parts == (("kilogram", "\\kilo\\gram", -2), ("meter", "\\meter", 2), ("newton", "\\newton", 1))
    assert U.parse("metre / s^2").dims == (1, 0, -2, 0, 0, 0, 0) and U.parse("km").factor == 1000 and U.parse("mm").factor == 1e-3
    assert U.parse("watt per metre squared").dims == U.parse("W / m ** 2").dims and U.parse("1 / mole").parts == (("mole", "\\mole", -1),)
    assert U.parse("celsius").shift == 273.15 and U.parse("celsius / s").shift == 0 and U.parse(None).parts == () and U.parse("min").factor == 60
    assert U.parse("m / m").parts == ()


def test_people_and_titles(spark):
    people = lambda x: [tuple(p) for p in one(spark, L.people_of(F.lit(x)))]
    assert people('"Ann"') == [("Ann", "?")] and people('{"name": "Bo", "gender": "m"}') == [("Bo", "m")]
    assert people('["Ann", {"name": "Bo", "gender": "m"}]') == [("Ann", "?"), ("Bo", "m")] and people("[]") == []
    assert one(spark, L.people_of(F.lit(None).cast("string"))) is None
    for bad in ("7", '{"name": "Bo"}', '[{"gender": "m"}]'):
        with pytest.raises(Exception, match="no pe"):
            one(spark, L.people_of(F.lit(bad)))
    assert one(spark, L.title(F.lit("hello wORLD-wide (a test)"))) == "Hello World-Wide (A Test)"
    with pytest.raises(KeyError):
        N.shorthand("x9")



def test_gamma(spark):
    import math

    from quire.functions.special import gamma

    xs = [0.3, 0.5, 1.0, 4.5, 10.0, -0.5, -2.5]
    for x, g in values(spark, [(x,) for x in xs], "x double", "x", gamma(F.col("x"))):
        assert g == pytest.approx(math.gamma(x), rel=1e-9)
    assert one(spark, gamma(F.lit(-2.0))) is None
