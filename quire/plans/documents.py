"""Queries on catalogues, folds, sets and fragments of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import constants as C
from quire.functions import quantities as Q
from quire.functions.lists import math_display
from quire.functions.special import gamma
from quire.operators import lint as L
from quire.operators import trees
from quire.plans.catalogue import query
from quire.plans.text import ALL_HITS, BAITED, RULES, baited, sql_text
from quire.runtime import table
from quire.sources import schemas

_REFS = ("c", "speed_light", "G", "boltzmann", "nope", "m_e", "hbar", "gforce", "eps0")
_K = "(VALUES " + ", ".join(f"('{n}', {sql_text(s)}, {float(m)!r}::DOUBLE, {list(a)!r}::VARCHAR[])" for n, s, a, m, *_ in C.CONSTANTS) + ") AS k(name, symbol, magnitude, aliases)"


@query(f"SELECT p_partkey, r AS ref, name, symbol, magnitude FROM (SELECT p_partkey, ({list(_REFS)!r})[p_partkey % {len(_REFS)} + 1] AS r FROM part) p JOIN {_K} ON k.name = r OR list_contains(k.aliases, r)")
def constant_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array(*[F.lit(x) for x in _REFS])
    d = table(spark, sf_dir, "part").select("p_partkey", F.get(refs, (F.col("p_partkey") % len(_REFS)).cast("int")).alias("ref"))
    return d.join(C.references(spark), "ref").select("p_partkey", "ref", "name", "symbol", "magnitude")


@query(
    "SELECT volume_id, string_agg(id || '=' || name, ';' ORDER BY id) AS names, count(*) AS n FROM (SELECT volume_id, id, max(name) AS name FROM languages WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY ALL) GROUP BY volume_id"
)
def dictionary_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "languages").where("id is not null and name is not null").groupBy("volume_id", "id").agg(F.max("name").alias("name"))
    m = d.groupBy("volume_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("m"))
    entries = F.array_sort(F.map_entries("m"))
    return m.select("volume_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("names"), F.size("m").cast("bigint").alias("n"))


@query(
    "SELECT o_custkey, string_agg(k || '=' || v, ';' ORDER BY k) AS merged FROM (SELECT o_custkey, o_orderpriority AS k, arg_max(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY ALL) GROUP BY o_custkey"
)
def fold_of_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of one entry each, folded in order, the later entry of a key winning."""
    maps = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("v"))))
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(maps.alias("a"))
    empty = F.create_map().cast("map<string,string>")
    m = F.aggregate("a", empty, lambda acc, x: trees.merge_maps(acc, F.create_map(x["k"], x["v"])))
    entries = F.array_sort(F.map_entries(m))
    return d.select("o_custkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


_U = "([1.0, 0.01, 0.3048]::DOUBLE[])"


@query(
    f"SELECT l_orderkey, count(*) AS n, round(sum(v * f / first_f), 6) AS total, arg_min(u, o) AS unit FROM (SELECT *, first_value(f) OVER (PARTITION BY l_orderkey ORDER BY o) AS first_f FROM (SELECT l_orderkey, l_quantity AS v, {_U}[l_linenumber % 3 + 1] AS f, (['meter', 'centimeter', 'foot'])[l_linenumber % 3 + 1] AS u, l_linenumber * 1000000 + l_partkey AS o FROM lineitem)) GROUP BY l_orderkey"
)
def unit_of_the_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of lengths brought to the unit of their first item."""
    unit = F.get(F.array(F.lit("meter"), F.lit("centimeter"), F.lit("foot")), F.col("l_linenumber") % 3)
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("o"), Q.quantity(F.col("l_quantity"), unit, among=["meter", "centimeter", "foot"]).alias("q"))
    first = F.first("q").over(Window.partitionBy("l_orderkey").orderBy("o"))
    d = d.withColumn("first", first)
    value = Q.base(F.col("q")) / F.col("first.unit.factor")
    return d.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"), F.min_by(Q.unit_name(F.col("q")), F.col("o")).alias("unit"))


@query(
    f"SELECT doc_id, line_no, rule_id FROM (SELECT h.doc_id, h.line_no, h.rule_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.line_no, o.ord) AS r FROM ({ALL_HITS(BAITED)}) h JOIN (SELECT * FROM (VALUES {', '.join(f"('{r.id}', {i})" for i, r in enumerate(RULES) if i == [x.id for x in RULES].index(r.id))}) AS o(id, ord)) o ON o.id = h.rule_id) WHERE r = 1"
)
def lint_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = baited(spark, sf_dir).select("doc_id", "line_no", L.findings(F.col("line"), RULES, extra=False).alias("f")).where(F.size("f") > 0)
    first = F.min_by(F.struct("line_no", F.col("f")[0]["rule_id"].alias("rule_id")), "line_no")
    return d.groupBy("doc_id").agg(first.alias("x")).select("doc_id", "x.line_no", "x.rule_id")


@query(
    "SELECT volume_id, problem_id, langs, before IS NOT NULL AND before <> langs AS differs FROM (SELECT *, lag(langs) OVER (PARTITION BY volume_id ORDER BY problem_id) AS before FROM (SELECT volume_id, problem_id, string_agg(l, ',' ORDER BY l) AS langs FROM (SELECT DISTINCT volume_id, problem_id, lower(lang[1:2]) AS l FROM problem_files WHERE lang IS NOT NULL) GROUP BY ALL))"
)
def translation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.numbering import neighbours

    d = table(spark, sf_dir, "problem_files").where("lang is not null").groupBy("volume_id", "problem_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.substring("lang", 1, 2)))), ",").alias("langs"))
    return neighbours(d, ["volume_id"], ["problem_id"], "langs").select("volume_id", "problem_id", "langs", "differs")


@query(
    "SELECT language_id, array_to_string(list_filter([CASE WHEN c.intro THEN 'intro' END, CASE WHEN c.problems THEN 'problems' END, CASE WHEN c.solutions THEN 'solutions' END, CASE WHEN c.answers THEN 'answers' END], lambda x: x IS NOT NULL), '+') AS sections FROM (SELECT DISTINCT language_id, booklet.contents AS c FROM languages)"
)
def section_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "booklet.contents."
    shown = F.array_compact(F.array(*[F.when(F.col(c + n), n) for n in ("intro", "problems", "solutions", "answers")]))
    return table(spark, sf_dir, "languages").select("language_id", F.array_join(shown, "+").alias("sections")).distinct()


_HEAD, _TAIL = "\\documentclass{standalone}\n\\begin{document}\n    ", "\n\\end{document}\n"


@query(f"SELECT doc_id, {sql_text(_HEAD)} || regexp_replace(regexp_replace(text, '\\n', chr(10) || '    ', 'g'), '\\n    $', chr(10)) || {sql_text(_TAIL)} AS wrapped FROM documents WHERE text IS NOT NULL")
def standalone_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.regexp_replace("text", r"\n(?!\z)", "\n    ")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit(_HEAD), body, F.lit(_TAIL)).alias("wrapped"))


@query("SELECT volume_id, '$$' || chr(10) || '    ' || competition || ' =' || chr(10) || '    ' || id || chr(10) || '$$ {#eq:' || id || '}' AS shown FROM (SELECT DISTINCT volume_id, competition, id FROM volumes)")
def display_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "volumes").select("volume_id", "competition", "id").distinct()
    return d.select("volume_id", math_display(F.concat("competition", F.lit(" =\n"), "id"), F.col("id")).alias("shown"))


@query("SELECT p_partkey, round(gamma(p_size / 4.0::DOUBLE + 0.3), 6 - greatest(0, floor(log10(gamma(p_size / 4.0::DOUBLE + 0.3))))::INT) AS g FROM part")
def gamma_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gamma(F.col("p_size") / F.lit(4.0) + F.lit(0.3))
    d = table(spark, sf_dir, "part").select("p_partkey", g.alias("g"))
    scale = F.pow(F.lit(10.0), 6 - F.greatest(F.lit(0.0), F.floor(F.log10("g")).cast("double")))
    return d.select("p_partkey", F.call_function("round", F.col("g") * scale).alias("x"), scale.alias("s")).select("p_partkey", (F.col("x") / F.col("s")).alias("g"))


@query("SELECT volume_id, id, volume_no AS number, CAST(held_on AS VARCHAR) AS date, authors.head AS head, coalesce(len(authors.problems), 0)::INT AS problems FROM (SELECT DISTINCT volume_id, id, volume_no, held_on, authors FROM volumes)")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes written as JSON documents and read back by their schema."""
    v = table(spark, sf_dir, "volumes")
    doc = F.to_json(F.struct("id", F.col("volume_no").alias("number"), F.col("held_on").alias("date"), "authors", F.col("table_no").alias("table"), F.col("start_minute").alias("start")))
    d = schemas.parse(v.select("volume_id", doc.alias("json")).distinct(), "json", "contest_volume", strict=True)
    size = F.when(F.col("document.authors.problems").isNull(), 0).otherwise(F.size("document.authors.problems"))
    return d.select("volume_id", "document.id", "document.number", F.col("document.date").cast("string").alias("date"), "document.authors.head", size.alias("problems"))
