"""Queries on numbers, lists, people and dates as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import lists as L
from quire.functions import numbers as N
from quire.plans.catalogue import query
from quire.runtime import spread, table


def _digit(symbols: str, place: int) -> str:
    """The Roman form of one decimal digit, in SQL; symbols: for one, five and ten."""
    one, five, ten = symbols
    forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    return f"(['{"', '".join(forms)}'])[(n // {place}) % 10 + 1]"


_ROMAN = f"repeat('M', (n // 1000)::INT) || {_digit('CDM', 100)} || {_digit('XLC', 10)} || {_digit('IVX', 1)}"


@query(f"SELECT p_partkey, {_ROMAN} AS roman FROM (SELECT p_partkey, (p_partkey + 3999) % 4000 + 1 AS n FROM part)")
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.roman((F.col("p_partkey") + 3999) % 4000 + 1).alias("roman"))


_END = "CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END"


@query(f"SELECT o_orderkey, n || {_END} AS nth, '$' || n || '^{{\\mathrm{{' || {_END} || '}}}}$' AS upnth FROM (SELECT o_orderkey, o_orderkey AS n FROM orders)")
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.nth(n).alias("nth"), N.upnth(n).alias("upnth"))


@query(
    "SELECT p_partkey, CASE WHEN n = 1 THEN 'bod' WHEN n > 2 AND n < 5 THEN 'body' ELSE 'bodov' END AS faithful, CASE WHEN n = 1 THEN 'bod' WHEN n > 1 AND n < 5 THEN 'body' ELSE 'bodov' END AS slavic FROM (SELECT p_partkey, p_size % 8 AS n FROM part)"
)
def plural_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, words = F.col("p_size") % 8, [F.lit(x) for x in ("bod", "body", "bodov")]
    return table(spark, sf_dir, "part").select("p_partkey", N.plural(n, *words).alias("faithful"), N.plural(n, *words, slavic_two=True).alias("slavic"))


def _listed(comma: str, word: str) -> str:
    return f"CASE WHEN len(x) = 0 THEN '' WHEN len(x) = 1 THEN x[1] ELSE array_to_string(x[1:len(x) - 1], ', ') || {comma} || ' {word} ' || x[len(x)] END"


@query(f"SELECT language_id, {_listed("''", 'a')} AS plain, {_listed("CASE WHEN len(x) > 2 THEN ',' ELSE '' END", 'und')} AS oxford FROM (SELECT DISTINCT language_id, translators AS x FROM languages WHERE translators IS NOT NULL)")
def list_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "languages").where("translators is not null").select("language_id", "translators").distinct()
    x = F.col("translators")
    return d.select("language_id", L.render_list(x).alias("plain"), L.render_list(x, and_word="und", oxford=True).alias("oxford"))


@query(
    "SELECT venue_id, " + _listed("''", "a").replace("x", "y") + " AS people, CASE WHEN len(y) = 0 THEN NULL WHEN len(y) > 1 THEN 'i' WHEN venue_id % 4 = 0 THEN '' WHEN venue_id % 4 = 1 THEN 'a' WHEN venue_id % 4 = 2 THEN 'o' ELSE '\\errorMessage{?}' END AS suffix FROM (SELECT DISTINCT venue_id, list_transform(orgs, lambda z: CASE WHEN z = '' THEN '\\errorMessage{?}' ELSE z END) AS y FROM venues WHERE orgs IS NOT NULL)"
)
def people_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "venues").where("orgs is not null").select("venue_id", "orgs").distinct()
    g = F.get(F.array(*[F.lit(x) for x in ("m", "f", "n", "?")]), (F.col("venue_id") % 4).cast("int"))
    persons = L.people(F.col("orgs"), F.transform("orgs", lambda _: g))
    return d.select("venue_id", L.render_people(persons).alias("people"), L.gender_suffix(persons).alias("suffix"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y--%m--%d') AS isotex, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%d. %m. %Y') AS day, strftime(o_orderdate, '%d.~%m.~%Y') AS tex, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders"
)
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    forms = {"year": "yyyy", "day": "dd'.' MM'.' yyyy", "tex": "dd'.~'MM'.~'yyyy", "stamp": "yyyy-MM-dd HH:mm:ss"}
    return table(spark, sf_dir, "orders").select("o_orderkey", L.isotex(d).alias("isotex"), *[F.date_format(d, f).alias(n) for n, f in forms.items()])


_CUT = "regexp_replace({}, '^1(\\.?e[+-]?[0-9]+)', '\\1')"


@query(f"SELECT l_orderkey, l_linenumber, {_CUT.format("printf('%.2f', x)")} AS f2, {_CUT.format("printf('%.0f', x)")} AS f0, {_CUT.format("printf('%.3f', x)")} AS f3 FROM (SELECT *, l_extendedprice * 1.41421356237::DOUBLE AS x FROM lineitem)")
def format_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") * F.lit(1.41421356237)
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")).select("l_orderkey", "l_linenumber", *[N.fixed(x, k).alias(f"f{k}") for k in (2, 0, 3)])


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f"{_CUT.format(f"printf('%.{k}g', x)")} AS g{k}" for k in (3, 6))}, '\\num{{' || {_CUT.format("printf('%.4g', x)")} || '}}' AS num FROM (SELECT *, l_extendedprice * pow(10, l_linenumber * 4 - 14) * 1.000013::DOUBLE AS x FROM lineitem)")
def format_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("l_linenumber") * 4 - 14) * F.lit(1.000013)
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")).select("l_orderkey", "l_linenumber", N.general(x, 3).alias("g3"), N.general(x, 6).alias("g6"), N.num(N.general(x, 4)).alias("num"))


@query("SELECT doc_id, CASE WHEN title IS NULL THEN NULL ELSE upper(left(title, 1)) || lower(title[2:]) END AS capitalised, lower(title) AS low, coalesce(nullif(title, ''), 'untitled') AS shown, length(coalesce(title, '')) AS size, left(title, 1) AS first, '\\textbf{' || title || '}' AS bold, left(title, 4) AS head, title[5:] AS tail FROM documents")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    cap = F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 1_000_000)))
    shown = F.coalesce(F.nullif(t, F.lit("")), F.lit("untitled"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", cap.alias("capitalised"), F.lower(t).alias("low"), shown.alias("shown"), F.length(F.coalesce(t, F.lit(""))).cast("bigint").alias("size"), F.left(t, F.lit(1)).alias("first"), L.wrapped("textbf", t).alias("bold"), F.substring(t, 1, 4).alias("head"), F.substring(t, 5, 1_000_000).alias("tail")
    )
