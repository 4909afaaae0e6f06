"""Queries on ordered records: numbering, bucketing, neighbours, presence, constraints, joins by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import numbering as N
from quire.operators import trees as T
from quire.operators import validate as V
from quire.plans.catalogue import query
from quire.runtime import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")


_RN = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"


@query(f"SELECT o_custkey, o_orderkey, ({_RN} - 1 + 4) AS number FROM orders")
def number_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.number(_orders(spark, sf_dir), ["o_custkey"], ["o_orderkey"], start=4).select("o_custkey", "o_orderkey", "number")


@query(f"SELECT o_custkey, o_orderkey, ({_RN} - 1 + 1) % 3 AS bin FROM orders")
def split_mod_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.split_mod(_orders(spark, sf_dir), ["o_custkey"], ["o_orderkey"], 3, first=1).select("o_custkey", "o_orderkey", "bin")


@query(
    f"SELECT c.o_custkey, b.bin, count(o.o_orderkey) AS items FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN (SELECT unnest(range(0, 7)) AS bin) b LEFT JOIN (SELECT o_custkey, o_orderkey, ({_RN} - 1) % 7 AS bin FROM orders) o ON o.o_custkey = c.o_custkey AND o.bin = b.bin GROUP BY ALL"
)
def split_mod_empty_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = N.split_mod(_orders(spark, sf_dir), ["o_custkey"], ["o_orderkey"], 7)
    return N.all_bins(binned, ["o_custkey"], 7)


@query(f"SELECT o_custkey, o_orderkey, ({_RN} - 1) // 4 AS batch FROM orders")
def split_div_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.split_div(_orders(spark, sf_dir), ["o_custkey"], ["o_orderkey"], 4).select("o_custkey", "o_orderkey", "batch")


@query(f"SELECT o_custkey, o_orderkey, CASE WHEN i % 2 = 0 THEN 0 WHEN i % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS bin FROM (SELECT *, {_RN} - 1 AS i FROM orders)")
def split_by_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda i: F.when(i % 2 == 0, 0).when(i % 3 == 0, 1).otherwise(-1)  # noqa: E731  (the last of three bins)
    return N.split_by(_orders(spark, sf_dir), ["o_custkey"], ["o_orderkey"], rule, 3).select("o_custkey", "o_orderkey", "bin")


@query(
    "SELECT o_custkey, o_orderkey, lag(o_orderpriority) OVER w AS before, lag(1) OVER w IS NOT NULL AND lag(o_orderpriority) OVER w IS DISTINCT FROM o_orderpriority AS differs, lag(1) OVER w IS NULL AS is_first, lead(1) OVER w IS NULL AS is_last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"
)
def adjacent_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.neighbours(_orders(spark, sf_dir), ["o_custkey"], ["o_orderkey"], "o_orderpriority").select("o_custkey", "o_orderkey", "before", "differs", "is_first", "is_last")


@query("SELECT l_orderkey, count(*) AS items, CASE WHEN count(*) % 3 = 0 THEN 0 ELSE 1 END AS added, count(*) + CASE WHEN count(*) % 3 = 0 THEN 0 ELSE 1 END AS padded FROM lineitem GROUP BY 1")
def pad_to_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"))
    return d.withColumn("added", N.padding(F.col("items"))).withColumn("padded", F.col("items") + F.col("added"))


_LANGS = ("cs", "de", "en", "es", "fr", "pl", "pt", "ru", "sk", "uk", "hu", "fa")


def _translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "problem_files")
    return files.select("volume_id", "problem_id", "filename", F.lower(F.substring("lang", 1, 2)).alias("lang")).distinct()


_TR = "(SELECT DISTINCT volume_id, problem_id, filename, lower(lang[1:2]) AS lang FROM problem_files)"


@query("SELECT volume_id, problem_id, filename, " + ", ".join(f"max(CASE WHEN lang = '{x}' THEN 1 ELSE 0 END) AS {x}" for x in _LANGS) + f" FROM {_TR} GROUP BY ALL")
def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.presence_matrix(_translations(spark, sf_dir), ["volume_id", "problem_id", "filename"], "lang", list(_LANGS))


@query(
    f"SELECT volume_id, problem_id, count(DISTINCT filename) FILTER (filename IN ('problem.md', 'solution.md')) AS present FROM {_TR} GROUP BY ALL HAVING present <> 2"
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.presence_matrix(_translations(spark, sf_dir), ["volume_id", "problem_id"], "filename", ["problem.md", "solution.md"])
    return V.incomplete(m, ["problem.md", "solution.md"], False).select("volume_id", "problem_id", "present")


@query(
    "SELECT volume_id, count(*) AS languages, string_agg(l, ',' ORDER BY l) AS codes FROM (SELECT DISTINCT volume_id, lower(lang[1:2]) AS l FROM problem_files WHERE lang IS NOT NULL) GROUP BY volume_id"
)
def languages_of_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _translations(spark, sf_dir).where("lang is not null").select("volume_id", "lang").distinct()
    return d.groupBy("volume_id").agg(F.count("*").alias("languages"), F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("codes"))


_VOLUME_RULES = {
    "id": ("length(id) > 0", lambda: V.not_empty(F.col("id"))),
    "number": ("volume_no >= 0", lambda: F.col("volume_no") >= 0),
    "start": ("start_minute >= 0 AND start_minute < 1440", lambda: (F.col("start_minute") >= 0) & (F.col("start_minute") < 1440)),
    "workshop": ("workshop IS NULL OR length(workshop) > 0", lambda: V.optional(F.col("workshop"), V.not_empty(F.col("workshop")))),
    "head": ("authors.head IS NOT NULL AND length(authors.head) > 0", lambda: V.not_empty(F.col("authors.head"))),
    "pictures": ("authors.pictures IS NOT NULL AND len(list_filter(authors.pictures, lambda x: x IS NULL OR length(x) = 0)) = 0", lambda: V.each(F.col("authors.pictures"), V.not_empty)),
}


@query(" UNION ALL ".join(f"SELECT volume_id, '{n}' AS rule FROM volumes WHERE NOT coalesce({sql}, false)" for n, (sql, _) in _VOLUME_RULES.items()))
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.violations(table(spark, sf_dir, "volumes"), ["volume_id"], {n: c() for n, (_, c) in _VOLUME_RULES.items()})


@query(
    "SELECT venue_id, updated_at, regexp_full_match(coalesce(code, ''), '[A-Z]{5}') AS code_ok, coalesce(lang IN (SELECT id FROM locales), false) AS lang_ok, coalesce(start_minute BETWEEN 0 AND 1439, false) AS start_ok, lower(left(name, 1)) IN ('f', 'v') AS preposition FROM venues"
)
def venue_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.existence(table(spark, sf_dir, "venues"), table(spark, sf_dir, "locales").select(F.col("id").alias("lang")), ["lang"], "lang_ok")
    start = F.coalesce(F.col("start_minute").between(0, 1439), F.lit(False))
    return d.select("venue_id", "updated_at", V.matches(F.col("code"), "[A-Z]{5}").alias("code_ok"), "lang_ok", start.alias("start_ok"), F.lower(F.left("name", F.lit(1))).isin("f", "v").alias("preposition"))


@query("SELECT p_partkey, [p_brand, p_type, p_name][p_size % 3 + 1] AS label FROM part")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part")
    return d.select("p_partkey", F.try_element_at(F.array("p_brand", "p_type", "p_name"), (F.col("p_size") % 3 + 1).cast("int")).alias("label"))


@query("SELECT volume_id, i AS number, constants[i] AS constant FROM (SELECT DISTINCT volume_id, constants, unnest(range(1, len(constants) + 1)) AS i FROM volumes)")
def generated_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "volumes").select("volume_id", "constants").distinct()
    d = d.select("volume_id", "constants", F.explode(F.when(F.size("constants") > 0, F.sequence(F.lit(1), F.size("constants")))).alias("number"))
    return d.select("volume_id", F.col("number").cast("bigint").alias("number"), F.element_at("constants", F.col("number")).alias("constant"))


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS present FROM orders")
def existence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.existence(_orders(spark, sf_dir).select("o_orderkey"), lines, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return _orders(spark, sf_dir).join(have, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query(
    "SELECT problem_id, a.lang AS from_lang, b.lang AS to_lang FROM (SELECT DISTINCT problem_id, lower(lang[1:2]) AS lang FROM problem_files WHERE filename = 'problem.md' AND kind = 'file' AND lower(lang[1:2]) IN ('sk', 'en')) a JOIN (SELECT unnest(['cs', 'de', 'pl']) AS lang) b ON true"
)
def translation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.lower(F.substring("lang", 1, 2))
    d = table(spark, sf_dir, "problem_files").where("filename = 'problem.md' and kind = 'file'").select("problem_id", lang.alias("from_lang")).where(F.col("from_lang").isin("sk", "en")).distinct()
    return d.select("problem_id", "from_lang", F.explode(F.array(*[F.lit(x) for x in ("cs", "de", "pl")])).alias("to_lang"))


@query(
    "SELECT volume_id, problem_id, 'missing' AS problem, n AS name FROM (SELECT DISTINCT volume_id, problem_id FROM problem_files) q, (SELECT unnest(['problem.md', 'solution.md']) AS n) x WHERE NOT EXISTS (SELECT 1 FROM problem_files f WHERE f.volume_id = q.volume_id AND f.problem_id = q.problem_id AND f.filename = n) "
    "UNION ALL SELECT DISTINCT volume_id, problem_id, 'unexpected', filename FROM problem_files WHERE filename NOT IN ('problem.md', 'solution.md')"
)
def tree_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tree_check(table(spark, sf_dir, "problem_files"), ["volume_id", "problem_id"], "filename", ["problem.md", "solution.md"], [], [r".*\.docx?"]).withColumn("name", F.col("name"))


@query(
    "SELECT file_id, arg_max(loaded_at, loaded_at) AS loaded_at, count(*) AS deliveries FROM problem_files GROUP BY file_id"
)
def latest_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "problem_files").groupBy("file_id").agg(F.max("loaded_at").alias("loaded_at"), F.count("*").alias("deliveries"))


@query(
    "SELECT t.file_id, t.origin_id, (t.committed_at IS NULL OR o.committed_at > t.committed_at) AS stale FROM (SELECT DISTINCT file_id, origin_id, committed_at FROM problem_files WHERE origin_id IS NOT NULL) t JOIN (SELECT DISTINCT file_id, committed_at FROM problem_files) o ON o.file_id = t.origin_id WHERE o.committed_at IS NOT NULL"
)
def stale_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "problem_files")
    t = f.where("origin_id is not null").select("file_id", "origin_id", "committed_at").distinct()
    o = f.where("committed_at is not null").select(F.col("file_id").alias("origin_id"), F.col("committed_at").alias("source_at")).distinct()
    return t.join(o, "origin_id").select("file_id", "origin_id", (F.col("committed_at").isNull() | (F.col("source_at") > F.col("committed_at"))).alias("stale"))


@query(
    "SELECT lang, kind, n, rank() OVER (PARTITION BY kind ORDER BY n DESC, lang) AS place FROM (SELECT coalesce(lang, '?') AS lang, kind, count(*) AS n FROM problem_files GROUP BY ALL)"
)
def language_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "problem_files").groupBy(F.coalesce("lang", F.lit("?")).alias("lang"), "kind").agg(F.count("*").alias("n"))
    return d.withColumn("place", F.rank().over(Window.partitionBy("kind").orderBy(F.desc("n"), "lang")).cast("bigint"))
