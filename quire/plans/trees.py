"""Queries on hierarchies: paths, children, ancestors, merging, locales, rendered fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import constants as C
from quire.functions.lists import render_list
from quire.operators import render, trees
from quire.plans.catalogue import query
from quire.plans.text import sql_text
from quire.runtime import table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "problem_files").select("file_id", "volume_id", "problem_id", "lang", "filename").distinct()


_PATH = "CASE WHEN volume_id IS NOT NULL THEN concat_ws('/', CASE WHEN length(volume_id::VARCHAR) < 3 THEN lpad(volume_id::VARCHAR, 3, '0') ELSE volume_id::VARCHAR END, problem_id, lang, CASE WHEN lang IS NOT NULL THEN filename END) END"


@query(f"SELECT DISTINCT file_id, {_PATH} AS path FROM problem_files")
def path_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _nodes(spark, sf_dir)
    return d.select("file_id", trees.path_of(trees.padded(F.col("volume_id"), 3), F.col("problem_id"), F.col("lang"), F.col("filename")).alias("path")).distinct()


@query(
    f"SELECT DISTINCT file_id, split_part(path, '/', 2) AS second, split_part(path, '/', -1) AS last, regexp_replace(path, '/[^/]*$', '') AS parent, repeat('    ', len(string_split(path, '/')) - 1) || split_part(path, '/', -1) AS printed FROM (SELECT file_id, {_PATH} AS path FROM problem_files)"
)
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return path_build(spark, sf_dir).select("file_id", trees.segment(p, 2).alias("second"), trees.segment(p, -1).alias("last"), trees.parent_of(p).alias("parent"), trees.print_tree(p).alias("printed"))


@query("SELECT r_regionkey, coalesce(string_agg(n_nationkey || ':' || n_name, ', ' ORDER BY n_nationkey), '') AS nations, count(n_name)::INT AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def hierarchy_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    d = trees.with_children(table(spark, sf_dir, "region"), kids, ["r_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"], "kids")
    text = F.array_join(F.transform("kids", lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(":"), x["n_name"])), ", ")
    return d.select("r_regionkey", text.alias("nations"), F.size("kids").alias("n"))


@query("SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS path, r_name AS region, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def hierarchy_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    d = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select("c_custkey", trees.path_of(F.col("r_name"), F.col("n_name"), F.col("c_name")).alias("path"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))


@query(
    "SELECT o.override_id, coalesce(o.quotes.open_mark, l.quotes.open_mark) AS open_mark, coalesce(o.quotes.close_mark, l.quotes.close_mark) AS close_mark, coalesce(o.quotes.babel_id, l.quotes.babel_id) AS babel_id FROM locale_overrides o LEFT JOIN locales l ON l.id = o.id"
)
def merge_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_map = lambda q: F.map_filter(F.create_map(*[x for n in ("open_mark", "close_mark", "babel_id") for x in (F.lit(n), q[n])]), lambda _, v: v.isNotNull())
    base = table(spark, sf_dir, "locales").select("id", as_map(F.col("quotes")).alias("base"))
    d = table(spark, sf_dir, "locale_overrides").join(base, "id", "left")
    m = trees.merge_maps(F.col("base"), F.when(F.col("quotes").isNotNull(), as_map(F.col("quotes"))))
    return d.select("override_id", m.alias("m")).select("override_id", *[F.col("m")[n].alias(n) for n in ("open_mark", "close_mark", "babel_id")])


def _leaves(d: DataFrame, key: str) -> DataFrame:
    q = F.array(*[F.struct(F.lit(f"quotes/{n}").alias("path"), F.col(f"quotes.{n}").alias("value")) for n in ("open_mark", "close_mark", "babel_id")])
    return d.select(F.col(key).alias("key"), F.explode(q).alias("x")).select("key", "x.path", "x.value").where("value is not null")


@query(
    "WITH r AS (SELECT override_id AS key, unnest(['quotes/open_mark', 'quotes/close_mark', 'quotes/babel_id']) AS path, unnest([quotes.open_mark, quotes.close_mark, quotes.babel_id]) AS value FROM locale_overrides), l AS (SELECT o.override_id AS key, unnest(['quotes/open_mark', 'quotes/close_mark', 'quotes/babel_id']) AS path, unnest([l.quotes.open_mark, l.quotes.close_mark, l.quotes.babel_id]) AS value FROM locale_overrides o JOIN locales l ON l.id = o.id) "
    "SELECT coalesce(l.key, r.key) AS key, coalesce(l.path, r.path) AS path, coalesce(r.value, l.value) AS value FROM l FULL JOIN r ON l.key = r.key AND l.path = r.path WHERE coalesce(r.value, l.value) IS NOT NULL"
)
def merge_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "locale_overrides"), table(spark, sf_dir, "locales")
    left = o.select("override_id", "id").join(l.select("id", "quotes"), "id")
    return trees.merge_deep(_leaves(left, "override_id"), _leaves(o, "override_id"), ["key"])


@query("SELECT d.doc_id, l.full_name, l.quotes.open_mark AS open_mark, l.rtl FROM documents d JOIN locales l ON l.id = d.lang")
def locale_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "locales")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("id"))
    return d.join(l, "id").select("doc_id", "full_name", F.col("quotes.open_mark").alias("open_mark"), "rtl")


#: What the volumes of the data call some constants, and names with a translation, by language.
_TRANSLATED = {"en": ("gforce", "speed_light", "planck"), "sk": ("gforce", "gravity")}
_CONSTANTS = "(VALUES " + ", ".join(f"('{n}', {sql_text(s)}, {list(a)!r}::VARCHAR[])" for n, s, a, *_ in C.CONSTANTS) + ") AS k(name, symbol, aliases)"
_WORDS = "(VALUES " + ", ".join(f"('{lang}', '{n}')" for lang, names in _TRANSLATED.items() for n in names) + ") AS w(lang, name)"


@query(
    f"SELECT DISTINCT c.volume_id, g.lang, c.pos, c.name, CASE WHEN k.name IS NULL THEN 'Undefined constant ' || c.name WHEN w.name IS NULL THEN 'No translation provided for ' || c.name ELSE g.lang || ':' || w.name END AS label, CASE WHEN k.name IS NOT NULL THEN '$' || k.symbol || '$' END AS symbol "
    f"FROM (SELECT volume_id, unnest(range(1, len(constants) + 1)) AS pos, unnest(constants) AS name FROM volumes) c CROSS JOIN (SELECT unnest(['en', 'sk']) AS lang) g LEFT JOIN {_CONSTANTS} ON k.name = c.name OR list_contains(k.aliases, c.name) LEFT JOIN {_WORDS} ON w.lang = g.lang AND w.name = k.name"
)
def constants_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each volume's constants in two languages: the constant by its name or alias, then its name in the language, each
    with a text for what is missing."""
    v = table(spark, sf_dir, "volumes").select("volume_id", F.posexplode("constants").alias("pos", "ref")).withColumn("pos", (F.col("pos") + 1).cast("bigint")).distinct()
    v = v.withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("sk"))))
    words = spark.createDataFrame([(lang, n, f"{lang}:{n}") for lang, names in _TRANSLATED.items() for n in names], "lang string, name string, word string")
    d = v.join(C.references(spark).select("ref", "name", "symbol"), "ref", "left").join(words, ["lang", "name"], "left")
    label = F.when(F.col("name").isNull(), F.concat(F.lit("Undefined constant "), "ref")).otherwise(F.coalesce("word", F.concat(F.lit("No translation provided for "), "ref")))
    return d.select("volume_id", "lang", "pos", F.col("ref").alias("name"), label.alias("label"), F.concat(F.lit("$"), "symbol", F.lit("$")).alias("symbol"))


@query(
    "SELECT r_name AS doc, '# ' || r_name || chr(10) || chr(10) || string_agg('* ' || n_name || CASE WHEN nxt IS NULL THEN '.' ELSE ',' END, chr(10) ORDER BY n_nationkey) AS text FROM (SELECT *, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nxt FROM nation) JOIN region ON r_regionkey = n_regionkey GROUP BY r_name"
)
def booklet(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    head = n.select(F.col("r_name").alias("doc"), F.lit(0).alias("seq"), F.concat(F.lit("# "), "r_name", F.lit("\n")).alias("fragment")).distinct()
    from quire.operators.numbering import neighbours

    items = neighbours(n, ["n_regionkey"], ["n_nationkey"], "n_name")
    body = items.select(F.col("r_name").alias("doc"), (F.col("n_nationkey") + 1).alias("seq"), F.concat(F.lit("* "), "n_name", F.when(F.col("is_last"), ".").otherwise(",")).alias("fragment"))
    return render.assemble(head.unionByName(body), ["doc"], "seq", "fragment")


@query(
    "SELECT volume_id, regexp_replace(regexp_replace('Volume (* id *) of (* competition *): (* workshop *)', '\\(\\* id \\*\\)', id), '\\(\\* competition \\*\\)', competition) AS t0, replace(t0, '(* workshop *)', coalesce(nullif(workshop, ''), 'none')) AS text FROM (SELECT DISTINCT volume_id, id, competition, workshop FROM volumes)".replace("SELECT volume_id, regexp", "SELECT volume_id, text FROM (SELECT volume_id, regexp", 1)
    + ")"
)
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "volumes").select("volume_id", "id", "competition", "workshop").distinct()
    values = {"id": F.col("id"), "competition": F.col("competition"), "workshop": F.coalesce(F.nullif(F.col("workshop"), F.lit("")), F.lit("none"))}
    return d.select("volume_id", render.fill("Volume (* id *) of (* competition *): (* workshop *)", values).alias("text"))


@query(
    "SELECT DISTINCT file_id, regexp_replace(regexp_replace(path, '^', 'build/'), '\\.md$', '.tex') AS target, 'source/' || path AS source FROM (SELECT file_id, concat_ws('/', problem_id, lang, filename) AS path FROM problem_files WHERE lang IS NOT NULL)"
)
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat_ws("/", "problem_id", "lang", "filename")
    d = _nodes(spark, sf_dir).where("lang is not null")
    return d.select("file_id", F.concat(F.lit("build/"), F.regexp_replace(p, r"\.md$", ".tex")).alias("target"), F.concat(F.lit("source/"), p).alias("source")).distinct()


@query(
    "SELECT volume_id, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN x[1] ELSE array_to_string(x[1:n - 1], ', ') || ' a ' || x[n] END AS authors FROM (SELECT DISTINCT volume_id, list_filter(authors.problems, lambda y: y IS NOT NULL) AS x, len(x) AS n FROM volumes WHERE authors.problems IS NOT NULL)"
)
def author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "volumes").select("volume_id", "authors.problems").where("problems is not null").distinct()
    return d.select("volume_id", render_list(F.col("problems")).alias("authors"))
