"""Queries on quantities, units and mathematical functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import constants as C
from quire.functions import numbers as N
from quire.functions import quantities as Q
from quire.plans.catalogue import query
from quire.plans.text import sql_text
from quire.runtime import table

_NAMES = ("meter", "centimeter", "kilometer", "inch", "foot")
_FACTOR = "([1.0, 0.01, 1000.0, 0.0254, 0.3048]::DOUBLE[])[p_size % 5 + 1]"
_UNIT = f"([{', '.join(repr(n) for n in _NAMES)}])[p_size % 5 + 1]"
_TEX = r"(['\meter', '\centi\meter', '\kilo\meter', '\inch', '\foot'])[p_size % 5 + 1]"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_size") % 5).cast("int"))
    return table(spark, sf_dir, "part").withColumn("q", Q.quantity(F.col("p_retailprice"), unit, "s", among=list(_NAMES)))


#: Parts of a product's unit come in order of their names, so the newton stands after the inch or foot and before the others.
_PRODUCT = r"(['\meter\newton', '\centi\meter\newton', '\kilo\meter\newton', '\inch\newton', '\foot\newton'])[p_size % 5 + 1]"


@query(
    f"SELECT p_partkey, round(p_retailprice + 2.5::DOUBLE / {_FACTOR}, 6) AS plus, round(p_retailprice - 2.5::DOUBLE / {_FACTOR}, 6) AS minus, '\\qty{{' || printf('%g', p_retailprice * 3) || '}}{{' || {_PRODUCT} || '}}' AS moment, "
    f"'\\qty{{' || printf('%g', p_retailprice / 3) || '}}{{' || {_TEX} || '\\per\\newton}}' AS ratio, '\\qty{{' || printf('%g', p_retailprice * p_retailprice) || '}}{{' || {_TEX} || '\\squared}}' AS area, '\\num{{1}}{{}}' AS one, -p_retailprice AS minus_q, round(p_retailprice * {_FACTOR} * 3, 4) AS joules FROM part"
)
def quantity_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    two, three = Q.quantity(F.lit(2.5), "metre"), Q.quantity(F.lit(3.0), "newton")
    q, c = F.col("q"), F.col
    made = {"plus": Q.add(q, two), "minus": Q.add(q, two, -1), "moment": Q.multiply(q, three), "ratio": Q.multiply(q, three, -1), "area": Q.power(q, 2), "one": Q.multiply(q, q, -1), "minus_q": Q.negate(q)}
    d = _parts(spark, sf_dir).select("p_partkey", *[v.alias(k) for k, v in made.items()])
    r = lambda x, n: F.round(Q.mag(x), n)
    return d.select("p_partkey", r(c("plus"), 6).alias("plus"), r(c("minus"), 6).alias("minus"), *[Q.tex(c(k)).alias(k) for k in ("moment", "ratio", "area", "one")], Q.mag(c("minus_q")).alias("minus_q"), r(Q.to(c("moment"), "joule"), 4).alias("joules"))


@query(
    f"SELECT p_partkey, {_UNIT} AS unit, 's' AS symbol, round(p_retailprice * {_FACTOR} / 0.3048::DOUBLE, 6) AS feet, round(p_retailprice * {_FACTOR}, 6) AS metres, 'meter' AS base_unit, '\\qty{{' || printf('%g', p_retailprice * {_FACTOR} * 2) || '}}{{\\kilogram\\meter\\squared\\per\\second\\squared}}' AS work FROM part".replace(r"\kilogram", r"\kilo\gram")
)
def quantity_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = F.col("q"), F.col
    d = _parts(spark, sf_dir).select("p_partkey", "q", Q.to(q, "foot").alias("foot"), Q.simplify(q).alias("si"), Q.multiply(q, Q.quantity(F.lit(2.0), "N")).alias("work")).withColumn("work", Q.simplify(c("work")))
    return d.select("p_partkey", Q.unit_name(q).alias("unit"), Q.symbol(q).alias("symbol"), F.round(Q.mag(c("foot")), 6).alias("feet"), F.round(Q.mag(c("si")), 6).alias("metres"), Q.unit_name(c("si")).alias("base_unit"), Q.tex(c("work")).alias("work"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p >= 0 THEN floor(x * pow(10, p) + 0.5) / pow(10, p) ELSE floor(x / pow(10, -p) + 0.5) * pow(10, -p) END AS approx FROM (SELECT *, l_extendedprice AS x, 2 - floor(log10(l_extendedprice)) AS p FROM lineitem)")
def quantity_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.approximate(F.col("l_extendedprice"), 3).alias("approx"))


@query(f"SELECT p_partkey, '\\qty{{' || printf('%.5g', p_retailprice * 1.00001) || '}}{{' || {_TEX} || '}}' AS full, 's = \\qty{{' || printf('%.1f', p_retailprice * 1.00001) || '}}{{' || {_TEX} || '}}' AS equals, '\\num[round-mode=none]{{' || printf('%g', p_retailprice) || '}}{{}}' AS plain FROM part")
def quantity_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, x = F.col("q"), F.col("p_retailprice") * F.lit(1.00001)
    return _parts(spark, sf_dir).select("p_partkey", Q.tex(q, N.general(x, 5)).alias("full"), Q.equals(q, N.fixed(x, 1)).alias("equals"), Q.tex(Q.quantity(F.col("p_retailprice"), None, si_extra={"round-mode": "none"})).alias("plain"))


@query(
    "SELECT p_partkey, round(sin(radians(a)), 9) AS s, round(cos(radians(a)), 9) AS c, '\\qty{' || printf('%.4g', asin(u)) || '}{\\radian}' AS arcsin, '\\qty{' || printf('%.4g', acos(u)) || '}{\\radian}' AS arccos, round(atan(a), 9) AS arctan, round(ln(a + 1), 9) AS log, '\\qty{' || printf('%.5g', degrees(u)) || '}{\\degree}' AS degrees FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_size / 51.0::DOUBLE AS u FROM part)"
)
def quantity_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that know of units: angles are brought to radians, inverse functions give angles."""
    a = F.col("p_size").cast("double")
    angle, share = Q.quantity(a, "degree"), Q.quantity(a / F.lit(51.0))
    made = {"s": Q.apply(angle, "sin"), "c": Q.apply(angle, "cos"), "arcsin": Q.apply(share, "arcsin"), "arccos": Q.apply(share, "arccos"), "arctan": Q.apply(Q.quantity(a), "arctan"), "log": Q.apply(Q.quantity(a + 1), "log"), "degrees": Q.apply(Q.quantity(a / F.lit(51.0), "rad"), "degrees")}
    d = table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in made.items()])
    q = F.col
    shown = lambda k, n: Q.tex(q(k), N.general(Q.mag(q(k)), n)).alias(k)
    return d.select("p_partkey", *[F.round(Q.mag(q(k)), 9).alias(k) for k in ("s", "c", "arctan", "log")], shown("arcsin", 4), shown("arccos", 4), shown("degrees", 5))


@query("SELECT o_custkey, '\\qtyrange{' || printf('%.2f', lo * (1 - 0.1::DOUBLE)) || '}{' || printf('%.2f', hi * (1 + 0.1::DOUBLE)) || '}{\\joule}' AS shown FROM (SELECT o_custkey, min(o_totalprice) * 1.0000003 AS lo, max(o_totalprice) * 1.0000003 AS hi FROM orders GROUP BY 1)")
def range_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.min("o_totalprice") * F.lit(1.0000003)).alias("lo"), (F.max("o_totalprice") * F.lit(1.0000003)).alias("hi"))
    d = d.select("o_custkey", Q.quantity(F.col("lo"), "joule").alias("lo"), Q.quantity(F.col("hi"), "joule").alias("hi"))
    d = d.select("o_custkey", Q.span(F.col("lo"), F.col("hi")).alias("r")).select("o_custkey", Q.widen(F.col("r"), 0.1).alias("r"))
    return d.select("o_custkey", Q.tex_range(F.col("r"), lambda x: N.fixed(x, 2)).alias("shown"))


@query(f"SELECT p_partkey, '\\qtyrange[a=2, b=3]{{' || printf('%g', p_retailprice) || '}}{{' || printf('%.3f', 5 / {_FACTOR}) || '}}{{' || {_TEX} || '}}' AS shown FROM part".replace("printf('%g', p_retailprice)", "printf('%.3f', p_retailprice)"))
def range_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of quantities in different units: the lower bound's unit holds, options are merged."""
    q = _parts(spark, sf_dir).select("p_partkey", F.col("q").withField("si_extra", F.create_map(F.lit("a"), F.lit("1"))).alias("q"))
    q = q.select("p_partkey", Q.span(F.col("q"), Q.quantity(F.lit(5.0), "m", si_extra={"b": "3", "a": "2"})).alias("r"))
    return q.select("p_partkey", Q.tex_range(F.col("r"), lambda x: N.fixed(x, 3)).alias("shown"))


@query("SELECT l_orderkey, '\\qtylist{' || string_agg(printf('%.0f', l_quantity), ';' ORDER BY l_linenumber, printf('%.0f', l_quantity)) || '}{\\kilo\\gram}' AS shown FROM lineitem GROUP BY l_orderkey")
def quantity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", N.fixed(F.col("l_quantity"), 0).alias("s"), F.col("l_quantity").alias("x"))))
    qs = F.transform(items, lambda r: Q.quantity(r["x"], "kilogram"))
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(qs.alias("qs"))
    return d.select("l_orderkey", Q.tex_list(F.col("qs"), lambda x: N.fixed(x, 0)).alias("shown"))


@query(f"SELECT p_partkey, '\\qtylist[per-mode=symbol]{{' || printf('%.4f', p_retailprice) || ';' || printf('%.4f', 2.5 / {_FACTOR}) || ';' || printf('%.4f', 0.3048::DOUBLE * 7 / {_FACTOR}) || '}}{{' || {_TEX} || '}}' AS shown FROM part")
def quantity_list_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of quantities in different units, in the unit of the first."""
    qs = F.array(F.col("q"), Q.quantity(F.lit(2.5), "metre", si_extra={"per-mode": "symbol"}), Q.quantity(F.lit(7.0), "ft"))
    return _parts(spark, sf_dir).select("p_partkey", Q.tex_list(qs, lambda x: N.fixed(x, 4)).alias("shown"))


# The TeX form of each unit of the catalogue of constants.
_UNIT_TEX = {
    "joule second": r"\joule\second", "metre / second": r"\meter\per\second", "newton metre squared / kilogram squared": r"\meter\squared\newton\per\kilo\gram\squared", "metre": r"\meter", "millilitre": r"\milli\liter", "kilogram": r"\kilo\gram", "metre / s^2": r"\meter\per\second\squared", "degree": r"\degree", "kelvin": r"\kelvin",
    "second": r"\second", "watt per metre squared": r"\watt\per\meter\squared", "1 / mole": r"\per\mole", "joule / kelvin / mole": r"\joule\per\kelvin\per\mole", "joule / kelvin": r"\joule\per\kelvin", "watt / metre squared / kelvin^4": r"\watt\per\kelvin\tothe{4}\per\meter\squared", "pascal": r"\pascal", "celsius": r"\celsius",
    "farad / metre": r"\farad\per\meter", "henry / metre": r"\henry\per\meter", "coulomb": r"\coulomb", "kilogram / metre cubed": r"\kilo\gram\per\meter\cubed", "gram / mole": r"\gram\per\mole", "newton / metre": r"\newton\per\meter", "joule / kilogram / kelvin": r"\joule\per\kelvin\per\kilo\gram", "kilojoule / kilogram": r"\kilo\joule\per\kilo\gram",
    "J / kg": r"\joule\per\kilo\gram", "1 / kelvin": r"\per\kelvin", None: "",
}
_K = "(VALUES " + ", ".join(f"('{n}', {sql_text(s)}, {float(m)!r}::DOUBLE, {sql_text(_UNIT_TEX[u])}, {d}, {f}, {sql_text('[per-mode=reciprocal]' if n in C.OPTIONS else '')})" for n, s, _, m, u, d, _, f in C.CONSTANTS) + ") AS k(name, symbol, x, tex, digits, force_f, extra)"
_ONE = lambda s: f"regexp_replace({s}, '^1(e[+-]?[0-9]+)', '\\1')"
_SHOWN = lambda s: f"CASE WHEN tex = '' THEN '\\num' ELSE '\\qty' END || extra || '{{' || {s} || '}}{{' || tex || '}}'"
#: Ties of the shortest decimal form are rounded away from zero here, while the twin's engine looks at the binary value:
#: for it, the value is raised by less than any digit shows.
_UP = "x * 1.000000000000001::DOUBLE"
_G = _ONE("printf('%.' || digits || 'g', x)")
_APPROX = "CASE WHEN x = 0 THEN 0 WHEN p >= 0 THEN floor(x * pow(10, p) + 0.5) / pow(10, p) ELSE floor(x / pow(10, -p) + 0.5) * pow(10, -p) END"


@query(
    f"SELECT p_partkey, name, {_SHOWN(_ONE(f"printf('%g', {_UP})"))} AS full, CASE WHEN force_f THEN {_SHOWN("printf('%.' || digits || 'f', x)")} ELSE {_SHOWN(_G)} END AS formatted, CASE WHEN x < 1e15 THEN {_SHOWN("printf('%.2f', x)")} END AS fullf, {_SHOWN(_ONE("printf('%.3g', x)"))} AS fullg, symbol || ' = ' || {_SHOWN(_ONE(f"printf('%g', {_UP})"))} AS equals, {_SHOWN(_ONE(f"printf('%g', {_APPROX})"))} AS approx, {_SHOWN("lpad(" + _ONE(f"printf('%g', {_UP})") + ", 99, ' ')")} AS exact "
    f"FROM (SELECT *, digits - 1 - CASE WHEN x = 0 THEN 1 ELSE floor(log10(abs(x))) END AS p FROM {_K}) JOIN part ON p_partkey % 53 = (SELECT count(*) FROM {_K.replace('AS k(', 'AS j(')} WHERE j.name < name)".replace("j.name < name", "j.name < k2.name").replace(f"FROM {_K}) JOIN", f"FROM {_K}) k2 JOIN")
)
def constant_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every constant in its textual forms, dealt out to the parts in order of name."""
    d = C.as_quantity(C.catalogue(spark))
    q, n = F.col("q"), F.col("digits")
    order = {x: i for i, x in enumerate(sorted(c[0] for c in C.CONSTANTS))}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("name")]
    d = d.select(
        place.alias("_k"), "name", Q.tex(q).alias("full"), C.shown(q, n, F.col("force_f")).alias("formatted"), F.when(F.col("magnitude") < 1e15, C.fullf(q, F.lit(2))).alias("fullf"), C.fullg(q, F.lit(3)).alias("fullg"), Q.equals(q).alias("equals"), Q.tex(Q.approximate(q, n)).alias("approx"), C.full_exact(q).alias("exact"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 53).cast("int").alias("_k")).join(d, "_k").drop("_k")


@query("SELECT p_partkey, round(sin(x), 9) AS s, round(cos(x), 9) AS c, round(atan2(x, 2.0::DOUBLE), 9) AS a, round(ln(x), 9) AS l, round(log10(x), 9) AS l10, round(log2(x), 9) AS l2, round(exp(x / 1000), 9) AS e, round(sqrt(x), 9) AS r, round(cbrt(x), 9) AS cr, ceil(x)::BIGINT AS up, floor(x)::BIGINT AS down, round(radians(x), 9) AS rad, round(degrees(x), 6) AS deg, round(2 * pi(), 9) AS tau FROM (SELECT p_partkey, p_retailprice AS x FROM part)")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_retailprice")
    made = {"s": F.sin(x), "c": F.cos(x), "a": F.atan2(x, F.lit(2.0)), "l": F.ln(x), "l10": F.log10(x), "l2": F.log2(x), "e": F.exp(x / 1000), "r": F.sqrt(x), "cr": F.cbrt(x), "rad": F.radians(x), "tau": 2 * F.pi()}
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(v, 9).alias(k) for k, v in made.items()], F.ceil(x).alias("up"), F.floor(x).alias("down"), F.round(F.degrees(x), 6).alias("deg"))


@query("SELECT c_custkey, round(c_acctbal / 10 + 273.15, 6) AS kelvin, round(c_acctbal / 10 - 273.15, 6) AS celsius FROM customer")
def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal") / 10
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(Q.kelvin(x), 6).alias("kelvin"), F.round(Q.celsius(x), 6).alias("celsius"))


@query(f"SELECT p_size % 5 AS kind, count(*) AS n, count(*) FILTER (abs(p_retailprice * {_FACTOR} - p_retailprice * 0.3048::DOUBLE) <= 1e-12 * p_retailprice) AS same, 0 AS other FROM part GROUP BY 1")
def quantity_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as lengths in the part's unit, compared with the same number of feet, and of seconds."""
    feet, seconds = Q.quantity(F.col("p_retailprice"), "foot"), Q.quantity(F.col("p_retailprice"), "s")
    d = _parts(spark, sf_dir).select((F.col("p_size") % 5).alias("kind"), Q.equal(F.col("q"), feet).alias("same"), Q.equal(F.col("q"), seconds).alias("other"))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("same").alias("same"), F.count_if("other").cast("int").alias("other"))
