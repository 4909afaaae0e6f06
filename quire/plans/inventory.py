"""Queries on what is left of the inventory: conversion, checks, trees, documents, templates, small formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import lists as L
from quire.functions import numbers as N
from quire.operators import numbering, render, trees
from quire.operators import rewrite as R
from quire.operators import validate as V
from quire.plans.catalogue import query
from quire.plans.text import DOC_LINES, doc_lines, replaced_sql, sql_text
from quire.runtime import table
from quire.sources import files, schemas

# ---- rewrites and their checks, on lines that reach every rule

#: Each derived line is one of these (or a line as it is), by document and line.
MARKED = (
    "$${{", "  }}$$", "$$ {{#eq:x}}", "\\caption{{}}\\label{{fig:a}}", "\\includegraphics[width=3cm]{{a.svg}}", "\\includegraphics{{b.gp}}", "\\includesvg[height=2mm]{{c.gp}}", "\\includegraphics[x]{{d.png}}", "<figcaption>Obrázok 3: a", "\\num{{e9}} \\SI{{3e4}}{{m}}", "\\qty{{1}}{{m}} \\unit{{s}}",
    '<img src="a.png" style="height:20mm">', '<img src="obrazky/b.gp">', "@L x", "@H y", "======== z", "^\\circ and ^{{\\circ}}", "@E bad", "@TODO later", "<<<<<<<< a", "% comment",
)
MARKED = tuple(x.replace("{{", "{").replace("}}", "}") for x in MARKED)
_MARKED = f"SELECT doc_id, line_no, coalesce(([{', '.join(sql_text(x) for x in MARKED)}])[((doc_id + line_no) % {len(MARKED) + 3})::INT + 1] || CASE WHEN line LIKE '%' || chr(10) THEN chr(10) ELSE '' END, line) AS line FROM ({DOC_LINES})"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.get(F.array(*[F.lit(x) for x in MARKED]), ((F.col("doc_id") + F.col("line_no")) % (len(MARKED) + 3)).cast("int"))
    end = F.when(F.endswith("line", F.lit("\n")), "\n").otherwise("")
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", F.coalesce(F.concat(at, end), "line").alias("line"))


def _rewritten(name: str, phase: str, fmt: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return marked(spark, sf_dir).select("doc_id", "line_no", R.rewrite(F.col("line"), phase, fmt).alias("line"))

    run.__name__ = name
    query(replaced_sql(_MARKED, R._rules(R.RULES, phase, fmt)))(run)


for _name, _phase, _fmt in (("rewrite_marked_latex", "pre", "latex"), ("rewrite_marked_html", "pre", "html"), ("rewrite_post_latex", "post", "latex"), ("rewrite_post_html", "post", "html")):
    _rewritten(_name, _phase, _fmt)

_HTML_CHECKS = ["CASE WHEN contains(line, '<img src=\"') AND len(list_filter(string_split(line, '<img src=\"')[2:], lambda x: NOT starts_with(x, 'obrazky'))) > 0 THEN 'Caught an image without ' || chr(39) || 'obrazky/' || chr(39) END"]
_HTML_CHECKS += [f"CASE WHEN contains(line, '{c}') THEN '{m}' END" for c, m in (("\\includegraphics", "Caught an unconverted \\includegraphics"), ("\\includesvg", "Caught an unconverted \\includesvg"), ("@L", "LaTeX-only tag in HTML"))]
_CONFLICT = ["CASE WHEN contains(line, repeat('<', 8)) OR contains(line, repeat('=', 8)) OR contains(line, repeat('>', 8)) THEN 'Git conflict markers present' END", "CASE WHEN contains(line, '^\\circ') OR contains(line, '^{\\circ}') THEN 'No \\circ allowed in exponents' END"]
_JOINED = lambda parts: f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '; ')"


@query(f"SELECT doc_id, line_no, {_JOINED(_CONFLICT)} AS pre, {_JOINED(_HTML_CHECKS)} AS html, {_JOINED(["CASE WHEN contains(line, '@H') THEN 'HTML-only tag in LaTeX' END"])} AS latex FROM ({_MARKED})")
def convert_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks before and after the rewrites, by format."""
    line = F.col("line")
    shown = lambda phase, fmt: F.array_join(R.violations(line, phase, fmt), "; ")
    return marked(spark, sf_dir).select("doc_id", "line_no", shown("pre", "html").alias("pre"), shown("post", "html").alias("html"), shown("post", "latex").alias("latex"))


_BOTH = replaced_sql(replaced_sql(_MARKED, R._rules(R.RULES, "pre", "latex")), R._rules(R.RULES, "post", "latex"))


@query(
    f"SELECT a.doc_id, rtrim(string_agg(a.line, '' ORDER BY a.line_no), chr(10)) AS text, arg_min(e.error, a.line_no) FILTER (e.error <> '') AS error FROM ({_BOTH}) a JOIN (SELECT m.doc_id, m.line_no, coalesce(nullif({_JOINED(_CONFLICT[:1])}, ''), nullif({_JOINED(_CONFLICT[1:])}, ''), CASE WHEN contains(b.after, '@H') THEN 'HTML-only tag in LaTeX' END, '') AS error "
    f"FROM ({_MARKED}) m JOIN (SELECT doc_id, line_no, line AS after FROM ({_BOTH})) b ON b.doc_id = m.doc_id AND b.line_no = m.line_no) e ON e.doc_id = a.doc_id AND e.line_no = a.line_no GROUP BY a.doc_id"
)
def convert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through both phases, with the first error beside the result."""
    return R.converted(marked(spark, sf_dir), ["doc_id"], "latex")


# ---- trees of files

_TREE = """SELECT volume_id, 'problems' AS path, '' AS parent, 'problems' AS name, 'dir' AS kind FROM problem_files UNION SELECT volume_id, 'problems/' || problem_id, 'problems', problem_id, 'dir' FROM problem_files
UNION SELECT volume_id, 'problems/' || problem_id || '/' || lang, 'problems/' || problem_id, lang, 'dir' FROM problem_files WHERE lang IS NOT NULL
UNION SELECT volume_id, 'problems/' || problem_id || '/' || lang || '/' || filename, 'problems/' || problem_id || '/' || lang, filename, kind FROM problem_files WHERE lang IS NOT NULL
UNION SELECT volume_id, 'problems/' || problem_id || '/' || lang || '/note ' || (file_id % 3) || '.txt', 'problems/' || problem_id || '/' || lang, 'note ' || (file_id % 3) || '.txt', 'file' FROM problem_files WHERE lang IS NOT NULL AND file_id % 5 = 0
UNION SELECT volume_id, 'problems/' || problem_id || '/answer.md', 'problems/' || problem_id, 'answer.md', 'file' FROM problem_files WHERE file_id % 2 = 0
UNION SELECT volume_id, '.hidden', '', '.hidden', 'dir' FROM problem_files UNION SELECT volume_id, 'meta.yaml', '', 'meta.yaml', 'file' FROM problem_files WHERE volume_id % 2 = 0
UNION SELECT volume_id, 'problems/' || problem_id || '/meta.yaml', 'problems/' || problem_id, 'meta.yaml', 'file' FROM problem_files WHERE volume_id % 3 = 0"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of the volumes' files: volume_id, path, parent, name, kind."""
    f = table(spark, sf_dir, "problem_files").select("volume_id", "problem_id", "lang", "filename", "kind", "file_id")
    p, id_, there = F.lit("problems"), F.col("file_id"), F.col("lang").isNotNull()
    entry = lambda steps, kind, where: F.when(where, F.struct(F.array(*steps).alias("steps"), (kind if not isinstance(kind, str) else F.lit(kind)).alias("kind")))
    note = F.concat(F.lit("note "), (id_ % 3).cast("string"), F.lit(".txt"))
    one, yes = F.col("problem_id"), F.lit(True)
    made = F.array(
        entry([p], "dir", yes), entry([p, one], "dir", yes), entry([p, one, F.col("lang")], "dir", there), entry([p, one, F.col("lang"), F.col("filename")], F.col("kind"), there), entry([p, one, F.col("lang"), note], "file", there & (id_ % 5 == 0)),
        entry([p, one, F.lit("answer.md")], "file", id_ % 2 == 0), entry([F.lit(".hidden")], "dir", yes), entry([F.lit("meta.yaml")], "file", F.col("volume_id") % 2 == 0), entry([p, one, F.lit("meta.yaml")], "file", F.col("volume_id") % 3 == 0),
    )
    d = f.select("volume_id", F.explode(F.array_compact(made)).alias("x")).select("volume_id", "x.*").distinct()
    s = F.col("steps")
    return d.select("volume_id", F.array_join(s, "/").alias("path"), F.array_join(F.slice(s, 1, F.size(s) - 1), "/").alias("parent"), F.element_at(s, -1).alias("name"), "kind")


@query(f"SELECT DISTINCT path, name FROM ({_TREE}) WHERE kind = 'dir' AND NOT starts_with(name, '.')")
def tree_child_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.child_dirs(tree(spark, sf_dir).select("path", "parent", "name", "kind").distinct()).select("path", "name")


@query(f"SELECT DISTINCT d.path FROM ({_TREE}) d JOIN ({_TREE}) m ON m.parent = d.path AND m.name = 'meta.yaml' WHERE d.kind = 'dir' AND NOT starts_with(d.name, '.')")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.nodes(tree(spark, sf_dir).select("path", "parent", "name", "kind").distinct()).select("path").distinct()


_LANGS = ", ".join(f"'{x}'" for x in V.LANGUAGES)
_PICTURE = "[\\pL\\pM\\p{Nd}\\p{Pc}-]+\\.(png|jpg|svg|gp|py|dat|tikz|tex"
_ODD = (
    "CASE WHEN parent = '' THEN CASE WHEN name = 'problems' OR name = 'meta.yaml' THEN NULL ELSE 'unexpected' END WHEN parent = 'problems' THEN CASE WHEN kind = 'dir' THEN NULL ELSE 'unexpected' END "
    f"WHEN len(string_split(parent, '/')) = 2 THEN CASE WHEN kind = 'file' AND regexp_matches(name, '[\\s\\pZ]') THEN 'forbidden' WHEN kind = 'dir' AND name IN ({_LANGS}) OR name IN ('answer.md', 'meta.yaml') OR kind = 'file' AND regexp_matches(name, '{_PICTURE}|md)') THEN NULL ELSE 'unexpected' END "
    f"ELSE CASE WHEN kind = 'file' AND regexp_matches(name, '[\\s\\pZ]') THEN 'forbidden' WHEN name IN ('problem.md', 'problem-extra.md', 'solution.md', 'answer-extra.md') OR kind = 'file' AND regexp_matches(name, '{_PICTURE})') THEN NULL ELSE 'unexpected' END END"
)


@query(
    f"WITH t AS ({_TREE}) SELECT volume_id, parent AS path, {_ODD} AS problem, name FROM t WHERE {_ODD} IS NOT NULL UNION ALL SELECT DISTINCT volume_id, '', 'missing', n FROM t, (SELECT unnest(['^languages$', '^meta\\.yaml$']) AS n) x WHERE n = '^languages$' OR volume_id % 2 <> 0 "
    f"UNION ALL SELECT d.volume_id, d.path, 'missing', '^answer\\.md$' FROM t d WHERE d.kind = 'dir' AND d.parent = 'problems' AND NOT EXISTS (SELECT 1 FROM t c WHERE c.volume_id = d.volume_id AND c.parent = d.path AND c.name = 'answer.md') "
    f"UNION ALL SELECT d.volume_id, d.path, 'missing', '^({'|'.join(V.LANGUAGES)})$' FROM t d WHERE d.kind = 'dir' AND d.parent = 'problems' AND NOT EXISTS (SELECT 1 FROM t c WHERE c.volume_id = d.volume_id AND c.parent = d.path AND c.kind = 'dir' AND c.name IN ({_LANGS}))"
)
def tree_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volumes' trees against the schema of a contest's volume."""
    return V.tree_violations(tree(spark, sf_dir), ["volume_id"], "contest_volume")


@query(
    f"WITH t AS (SELECT volume_id, path[10:] AS path, CASE WHEN parent = 'problems' THEN '' ELSE parent[10:] END AS parent, name, kind FROM ({_TREE}) WHERE starts_with(path, 'problems/') AND len(string_split(path, '/')) < 4) "
    "SELECT volume_id, parent AS path, 'unexpected' AS problem, name FROM t WHERE CASE WHEN parent = '' THEN NOT (kind = 'dir' AND regexp_matches(name, '0[1-8]')) ELSE kind = 'dir' OR name <> 'meta.yaml' END "
    "UNION ALL SELECT DISTINCT volume_id, '', 'missing', '^meta\\.yaml$' FROM t UNION ALL SELECT volume_id, '', 'missing', '0[1-8]' FROM t GROUP BY 1 HAVING NOT bool_or(parent = '' AND regexp_matches(name, '0[1-8]')) "
    "UNION ALL SELECT d.volume_id, d.path, 'missing', n FROM t d, (SELECT unnest(['^problem\\.md$', '^solution\\.md$', '^meta\\.yaml$']) AS n) x WHERE d.kind = 'dir' AND d.parent = '' AND (n <> '^meta\\.yaml$' OR d.volume_id % 3 <> 0)"
)
def tree_schema_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems' folders, without their files by language, against the schema of a seminar's round."""
    t = tree(spark, sf_dir).where("path like 'problems/%' and size(split(path, '/')) < 4")
    cut = lambda c: F.when(F.col(c) == "problems", "").otherwise(F.substring(c, 10, 1000))
    return V.tree_violations(t.select("volume_id", cut("parent").alias("parent"), "name", "kind"), ["volume_id"], "seminar_round")


@query(f"SELECT volume_id, path, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS extension FROM ({_TREE}) WHERE kind <> 'dir' AND lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN ('md', 'txt')")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return tree(spark, sf_dir).where("kind <> 'dir'").select("volume_id", "path", ext.alias("extension")).where(F.col("extension").isin("md", "txt"))


# ---- documents

if files.yaml is not None:

    @query(
        "WITH v AS (SELECT DISTINCT volume_id, id, volume_no, authors.head AS head, constants FROM volumes) SELECT volume_id, 'number' AS path, volume_no::VARCHAR AS value, false AS failed FROM v WHERE volume_id % 11 <> 0 UNION ALL SELECT volume_id, 'authors/head', coalesce(head, 'nobody'), false FROM v WHERE volume_id % 11 <> 0 "
        "UNION ALL SELECT volume_id, 'constants/' || (i - 1), constants[i], false FROM (SELECT *, unnest(range(1, len(constants) + 1)) AS i FROM v WHERE volume_id % 11 <> 0) UNION ALL SELECT volume_id, NULL, NULL, true FROM v WHERE volume_id % 11 = 0"
    )
    def yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Volumes written as YAML and read again as leaves; every eleventh text is no YAML."""
        v = table(spark, sf_dir, "volumes").select("volume_id", "id", "volume_no", "authors.head", "constants").distinct()
        quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
        items = F.array_join(F.transform(F.coalesce("constants", F.array().cast("array<string>")), quoted), ", ")
        text = F.concat(F.lit("number: "), F.col("volume_no").cast("string"), F.lit("\nauthors:\n    head: "), quoted(F.coalesce("head", F.lit("nobody"))), F.lit("\nconstants: ["), items, F.lit("]\n"))
        bad = F.when(F.col("volume_id") % 11 == 0, F.concat(F.lit("a: [1\nb: "), text)).otherwise(text)
        d = files.yaml_leaves(v.select("volume_id", bad.alias("text")), "volume_id", "text")
        return d.select("volume_id", "path", "value", F.col("error").isNotNull().alias("failed"))


@query("SELECT doc_id, coalesce(length(text) = 0 OR unicode(right(text, 1)) < 128, false) AS utf8 FROM documents")
def utf8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose last byte is cut off: what is left is UTF-8 only where the last character is ASCII."""
    raw = F.encode("text", "UTF-8")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.length(raw) > 0, F.substr(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw).alias("content"))
    return files.valid_utf8(d).select("doc_id", "utf8")


@query(
    "SELECT venue_id, updated_at, coalesce(length(id) > 0, false) AS has_id, code IS NULL AS no_code, coalesce(try_cast(nullif(regexp_extract(code, '[0-9]+'), '') AS INT) < 50, false) AS small_number, coalesce(len(orgs) > 0 AND len(list_filter(orgs, lambda x: x IS NULL OR length(x) = 0)) = 0, false) AS all_orgs, lang IS NOT NULL AND lang IN ('sk', 'cs') AS home FROM venues"
)
def schema_combinators(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    number = V.use(c("code"), lambda x: F.nullif(F.regexp_extract(x, "[0-9]+", 0), F.lit("")).try_cast("int"), lambda n: n < 50)
    named = V.entries(F.when(F.size("orgs") > 0, F.map_from_arrays(F.sequence(F.lit(1), F.size("orgs")), c("orgs"))), lambda k: k > 0, V.not_empty)
    return table(spark, sf_dir, "venues").select("venue_id", "updated_at", V.not_empty(c("id")).alias("has_id"), V.absent(c("code")).alias("no_code"), number.alias("small_number"), named.alias("all_orgs"), V.literal(c("lang"), "sk", "cs").alias("home"))


_VENUE = "SELECT DISTINCT venue_id, id, CASE WHEN venue_id % 3 = 0 THEN upper(left(regexp_replace(code || 'AAAAA', '[^A-Za-z]', 'A', 'g'), 5)) ELSE code END AS code, name, lang, orgs, evaluators, start_minute FROM venues"
_VENUE_RULES = {
    "id": "length(id) > 0", "code": "regexp_full_match(code, '[A-Z]{5}')", "name": "length(name) > 0", "language": f"lang IN ({_LANGS})", "orgs": "orgs IS NULL OR len(list_filter(orgs, lambda x: x IS NULL OR length(x) = 0)) = 0", "evaluators": "evaluators IS NOT NULL", "start": "start_minute BETWEEN 0 AND 1439",
}


@query(" UNION ALL ".join(f"SELECT venue_id, '{n}' AS rule FROM ({_VENUE}) WHERE NOT coalesce({c}, false)" for n, c in _VENUE_RULES.items()))
def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues as JSON documents, read by their schema and held against its rules."""
    v = table(spark, sf_dir, "venues")
    code = F.when(F.col("venue_id") % 3 == 0, F.upper(F.left(F.regexp_replace(F.concat("code", F.lit("AAAAA")), "[^A-Za-z]", "A"), F.lit(5)))).otherwise(F.col("code"))
    doc = F.to_json(F.struct("id", code.alias("code"), "name", F.col("lang").alias("language"), "orgs", "evaluators", F.col("start_minute").alias("start")))
    d = schemas.parse(v.select("venue_id", doc.alias("json")).distinct(), "json", "contest_venue", strict=True)
    return schemas.invalid(d, "contest_venue", ["venue_id"])


@query(
    f"WITH l AS (SELECT DISTINCT language_id, id, name, rtl, booklet, translators FROM languages) SELECT language_id, coalesce(len(translators), 0)::INT AS translators, rule FROM (SELECT *, unnest(list_filter([CASE WHEN NOT coalesce(id IN ({_LANGS}), false) THEN 'id' END, CASE WHEN name IS NULL THEN 'name' END, CASE WHEN rtl IS NULL THEN 'rtl' END], lambda x: x IS NOT NULL)) AS rule FROM l)"
)
def document_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as documents: a missing list of translators counts as empty."""
    v = table(spark, sf_dir, "languages")
    doc = F.to_json(F.struct("id", "name", "rtl", "booklet", "translators"))
    d = schemas.with_defaults(schemas.parse(v.select("language_id", doc.alias("json")).distinct(), "json", "contest_language"), "contest_language")
    return schemas.invalid(d.withColumn("translators", F.size("document.translators")), "contest_language", ["language_id", "translators"])


@query(
    "WITH f AS (SELECT id AS file, 'quotes/open' AS path, quotes.open_mark AS value FROM locales WHERE locale_no % 2 = 0 UNION ALL SELECT id, 'full', full_name FROM locales) SELECT l.id AS file, p.path, CASE WHEN p.path = 'full' THEN l.full_name WHEN p.path = 'quotes/open' AND l.locale_no % 2 = 0 THEN l.quotes.open_mark ELSE p.value END AS value "
    "FROM locales l, (VALUES ('full', 'english'), ('quotes/open', '\"'), ('rtl', 'false')) AS p(path, value)"
)
def locale_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locales' documents over the defaults; a document that isn't named by two letters is left out."""
    l = table(spark, sf_dir, "locales")
    own = l.select(F.col("id").alias("file"), F.lit("full").alias("path"), F.col("full_name").alias("value")).unionByName(l.where("locale_no % 2 = 0").select(F.col("id").alias("file"), F.lit("quotes/open").alias("path"), F.col("quotes.open_mark").alias("value")))
    rest = spark.createDataFrame([("default", "full", "english"), ("default", "quotes/open", '"'), ("default", "rtl", "false"), ("extra", "full", "none")], "file string, path string, value string")
    return trees.catalogue(own.unionByName(rest)).select("file", "path", "value")


@query("SELECT volume_id, 'id=' || id || ',number=' || (volume_no + 1) || ',start=' || start_minute AS volume, 'head=' || coalesce(workshop, '-') AS other FROM (SELECT DISTINCT volume_id, id, volume_no, start_minute, workshop FROM volumes)")
def adopted_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context that takes in two others: one under a key it has, one under a new key."""
    d = table(spark, sf_dir, "volumes").select("volume_id", "id", "volume_no", "start_minute", "workshop").distinct()
    text = lambda c: F.col(c).cast("string")
    own = F.create_map(F.lit("volume"), F.create_map(F.lit("id"), text("id"), F.lit("number"), text("volume_no")))
    both = trees.adopt(trees.adopt(own, "volume", F.create_map(F.lit("number"), (F.col("volume_no") + 1).cast("string"), F.lit("start"), text("start_minute"))), "other", F.create_map(F.lit("head"), F.coalesce("workshop", F.lit("-"))))
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return d.select("volume_id", both.alias("m")).select("volume_id", shown(F.col("m")["volume"]).alias("volume"), shown(F.col("m")["other"]).alias("other"))


_EDGES = "SELECT DISTINCT 'p' || volume_id || '/' || problem_id AS target, 'f' || file_id AS source FROM problem_files UNION SELECT DISTINCT 'v' || volume_id, 'p' || volume_id || '/' || problem_id FROM problem_files UNION SELECT DISTINCT 'all' || (volume_id % 7), 'v' || volume_id FROM problem_files"
_TIMES = "SELECT 'f' || file_id AS node, max(committed_at) AS at FROM problem_files GROUP BY 1 UNION ALL SELECT 'p' || volume_id || '/' || problem_id, max(committed_at) - INTERVAL (CASE WHEN volume_id % 2 = 0 THEN 1 ELSE 0 END) DAY FROM problem_files GROUP BY volume_id, problem_id UNION ALL SELECT 'v' || volume_id, max(committed_at) + INTERVAL 1 DAY FROM problem_files GROUP BY volume_id UNION ALL SELECT 'all' || (volume_id % 7), max(committed_at) + INTERVAL 2 DAY FROM problem_files GROUP BY volume_id % 7"


@query(
    f"WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), t AS MATERIALIZED ({_TIMES}), s AS (SELECT e.target FROM e LEFT JOIN t a ON a.node = e.target LEFT JOIN t b ON b.node = e.source WHERE a.at IS NULL OR b.at > a.at UNION SELECT e.target FROM e JOIN s ON s.target = e.source) SELECT DISTINCT target FROM s"
)
def stale_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems made from files, volumes from problems, collections from volumes: what is stale, to the end."""
    f = table(spark, sf_dir, "problem_files").select("file_id", "volume_id", "problem_id", "committed_at")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    v, at = F.col("volume_id"), F.col("committed_at")
    file, problem, volume, every = text("f", F.col("file_id").cast("string")), text("p", v.cast("string"), "/", F.col("problem_id")), text("v", v.cast("string")), text("all", (v % 7).cast("string"))
    links = F.array(*[F.struct(a.alias("target"), b.alias("source")) for a, b in ((problem, file), (volume, problem), (every, volume))])
    day = F.expr("INTERVAL 1 DAY")
    made = F.array(*[F.struct(n.alias("node"), x.alias("at")) for n, x in ((file, at), (problem, F.when(v % 2 == 0, at - day).otherwise(at)), (volume, at + day), (every, at + day + day))])
    edges = f.select(F.explode(links).alias("x")).select("x.*").distinct()
    return trees.stale(edges, f.select(F.explode(made).alias("x")).select("x.*").groupBy("node").agg(F.max("at").alias("at")))


# ---- templates

_BLOCKS = ("title", "body", "foot")


@query(
    "SELECT volume_id, block, CASE WHEN block = 'body' THEN 'Volume ' || volume_no WHEN block = 'notes' THEN 'Notes of ' || id ELSE block || ' of ' || competition END AS text FROM (SELECT DISTINCT volume_id, id, competition, volume_no FROM volumes) v, (SELECT unnest(['title', 'body', 'foot', 'notes']) AS block) b"
)
def template_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base template's blocks, of which a child replaces one and adds another."""
    v = table(spark, sf_dir, "volumes").select("volume_id", "id", "competition", "volume_no").distinct()
    base = v.select("volume_id", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.concat(F.lit(f"{b} of "), "competition").alias("text")) for b in _BLOCKS])).alias("x")).select("volume_id", "x.*")
    child = v.select("volume_id", F.explode(F.array(F.struct(F.lit("body").alias("block"), F.concat(F.lit("Volume "), F.col("volume_no").cast("string")).alias("text")), F.struct(F.lit("notes").alias("block"), F.concat(F.lit("Notes of "), "id").alias("text")))).alias("x")).select("volume_id", "x.*")
    return render.override(base, child, ["volume_id", "block"], "text").select("volume_id", "block", "text")


@query("SELECT volume_id, 'See Part ' || id || ' of $' || competition || '$, again: Part ' || id || ' of $' || competition || '$' AS text FROM (SELECT DISTINCT volume_id, id, competition FROM volumes)")
def template_two_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that hold names themselves, in any spacing."""
    d = table(spark, sf_dir, "volumes").select("volume_id", "id", "competition").distinct()
    values = {"part": F.lit("Part (*id*) of $(*  competition *)$"), "id": F.col("id"), "competition": F.col("competition")}
    return d.select("volume_id", render.fill("See (* part *), again: (* part *)", values, passes=2).alias("text"))


@query(
    "SELECT language_id, 'booklet-' || coalesce(id, '?') || '.tex' AS target, 'meta.yaml' AS meta, CASE WHEN rtl THEN 'RTL ' ELSE '' END || coalesce(name, '?') || ': ' || coalesce(len(translators), 0) AS text FROM (SELECT DISTINCT language_id, id, name, rtl, translators FROM languages)"
)
def render_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a translation, with the name that its template renders to."""
    d = table(spark, sf_dir, "languages").select("language_id", "id", "name", "rtl", "translators").distinct()
    many = F.when(F.col("translators").isNull(), 0).otherwise(F.size("translators"))
    values = {"mark": F.when(F.col("rtl"), "RTL ").otherwise(""), "name": F.coalesce("name", F.lit("?")), "n": many}
    target = render.target_name(F.concat(F.lit("booklet-"), F.coalesce("id", F.lit("?")), F.lit(".jtex")))
    return d.select("language_id", target.alias("target"), render.target_name(F.lit("meta.jyaml")).alias("meta"), render.fill("(* mark *)(* name *): (* n *)", values).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_size::VARCHAR ELSE '{\"magnitude\":' || p_size || '.5,\"unit\":\"metre\"}' END AS value FROM part")
def template_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, numbers and constants through the gate for templates' values."""
    k = F.col("p_partkey") % 3
    size = F.col("p_size").cast("string")
    value = F.when(k == 0, F.col("p_name")).when(k == 1, size).otherwise(F.concat(F.lit('{"magnitude":'), size, F.lit('.5,"unit":"metre"}')))
    kind = F.when(k == 0, "string").when(k == 1, "number").otherwise("object")
    return table(spark, sf_dir, "part").select("p_partkey", render.passed(value, kind).alias("value"))


# ---- numbers, names and small formats

_PRIMES = numbering.primes(40)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, ({_PRIMES})[r] AS number FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem)")
def number_by_primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    primes = spark.createDataFrame(list(enumerate(_PRIMES)), "place bigint, number bigint")
    return numbering.number_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], primes).select("l_orderkey", "l_linenumber", "l_partkey", "number")


@query("SELECT l_orderkey, l_partkey, false AS added FROM lineitem UNION ALL SELECT l_orderkey, NULL, true FROM lineitem GROUP BY l_orderkey HAVING count(*) % 3 <> 0")
def pad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.padded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey"], "l_partkey")


_NUMBER = "o_orderkey % 80"
_SEMINAR = "(['FKS', 'FX', 'KMS'])[o_custkey % 3 + 1]"


@query(f"SELECT o_orderkey, CASE {_SEMINAR} WHEN 'FKS' THEN CASE WHEN {_NUMBER} < 38 THEN 'FKS-old' ELSE 'FKS' END WHEN 'FX' THEN 'FX' END AS remote, CASE {_SEMINAR} WHEN 'FKS' THEN CASE WHEN {_NUMBER} < 38 THEN 7 ELSE 8 END WHEN 'FX' THEN 6 END AS problems, CASE WHEN {_SEMINAR} = 'KMS' THEN 'Unsupported combination KMS/' || ({_NUMBER}) END AS error FROM orders")
def problem_count_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a seminar's volume is published and how many problems it has; a combination without a rule is an error."""
    seminar = F.get(F.array(F.lit("FKS"), F.lit("FX"), F.lit("KMS")), (F.col("o_custkey") % 3).cast("int"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", seminar.alias("s"), (F.col("o_orderkey") % 80).alias("v"))
    old, s = F.col("v") < 38, F.col("s")
    remote = F.when((s == "FKS") & old, "FKS-old").when(s.isin("FKS", "FX"), s)
    problems = F.when(s == "FKS", F.when(old, 7).otherwise(8)).when(s == "FX", 6)
    return d.select("o_orderkey", remote.alias("remote"), problems.alias("problems"), F.when(remote.isNull(), F.concat(F.lit("Unsupported combination "), s, F.lit("/"), F.col("v").cast("string"))).alias("error"))


@query(
    "SELECT venue_id, updated_at, CASE WHEN lower(left(name, 1)) IN ('f', 'v') THEN 'vo ' ELSE 'v ' END || name AS at_place, CASE WHEN lower(left(name, 1)) IN ('z', 'ž', 's', 'š') THEN 'zo ' ELSE 'z ' END || name AS from_place FROM venues"
)
def prepositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.lower(F.left("name", F.lit(1)))
    pick = lambda letters, a, b: F.concat(F.when(first.isin(*letters), a).otherwise(b), F.col("name"))
    return table(spark, sf_dir, "venues").select("venue_id", "updated_at", pick("fv", "vo ", "v ").alias("at_place"), pick("zžsš", "zo ", "z ").alias("from_place"))


@query("SELECT volume_id, id || '-' || volume_no AS id, volume_no AS number, 297 / greatest(table_no, 1)::DOUBLE AS height, volume_no + 1998 - 1 AS year_from, volume_no + 1998 AS year_to, coalesce(workshop, 'none') AS workshop FROM (SELECT DISTINCT volume_id, id, volume_no, table_no, workshop FROM volumes)")
def added_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys added, overwritten and computed: id, number, the height of a strip, the school year."""
    d = table(spark, sf_dir, "volumes").select("volume_id", "id", "volume_no", "table_no", "workshop").distinct()
    n = F.col("volume_no")
    d = d.withColumns({"id": F.concat_ws("-", "id", n.cast("string")), "number": n, "height": 297 / F.greatest("table_no", F.lit(1)), "year_from": n + 1998 - 1, "year_to": n + 1998, "workshop": F.coalesce("workshop", F.lit("none"))})
    return d.select("volume_id", "id", "number", "height", "year_from", "year_to", "workshop")


@query("SELECT doc_id, '$' || rtrim(title, chr(10)) || '$' AS inline, '$${' || chr(10) || '    ' || title || chr(10) || '    = 0' || chr(10) || '}$$ {#eq:t' || doc_id || '}' AS aligned FROM documents WHERE title IS NOT NULL AND title <> '' AND NOT contains(title, chr(10))")
def math_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    d = table(spark, sf_dir, "documents").where("title is not null and title <> '' and not contains(title, '\n')")
    return d.select("doc_id", L.math_inline(t).alias("inline"), L.math_aligned(F.concat(t, F.lit("\n= 0\n")), F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("aligned"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(w[2:])), ' ') AS title FROM part")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", L.title(F.upper("p_name")).alias("title"))


@query(
    "SELECT volume_id, head AS shown, '\\errorMessage{?}' AS suffix, head || ' a ' || head AS both FROM (SELECT DISTINCT volume_id, authors.head AS head FROM volumes WHERE authors.head IS NOT NULL AND authors.head <> '') UNION ALL SELECT -venue_id, name, 'a', name || ' a ' || name FROM (SELECT DISTINCT venue_id, name FROM venues WHERE name IS NOT NULL AND name <> '')"
)
def people_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People given as a name, as an object, and as a list of both."""
    v = table(spark, sf_dir, "volumes").select("volume_id", F.col("authors.head").alias("n")).where("n <> ''").distinct()
    w = table(spark, sf_dir, "venues").select((-F.col("venue_id")).alias("volume_id"), F.col("name").alias("n")).where("n <> ''").distinct()
    name = F.substring_index(F.substring(F.to_json(F.struct("n")), 6, 1_000_000), "}", 1)
    person = F.to_json(F.struct(F.col("n").alias("name"), F.lit("f").alias("gender")))
    d = v.withColumn("j", name).unionByName(w.withColumn("j", person))
    both = F.concat(F.lit("["), "j", F.lit(", "), name, F.lit("]"))
    d = d.select("volume_id", L.people_of(F.col("j")).alias("a"), L.people_of(both).alias("b"))
    return d.select("volume_id", L.render_people(F.col("a")).alias("shown"), L.gender_suffix(F.col("a")).alias("suffix"), L.render_people(F.col("b")).alias("both"))


@query("SELECT p_partkey, printf('%.2f', p_retailprice) AS f2, regexp_replace(printf('%.3g', p_retailprice * 1.0000003), '^1e', 'e') AS g3, '\\num{' || printf('%.1f', p_retailprice) || '}' AS nf1, '\\num{' || printf('%g', p_retailprice) || '}' AS ng, 'p = \\qty{' || printf('%.0f', p_retailprice * 1.0000003) || '}{\\meter}' AS ef0 FROM part")
def precision_shorthands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions import quantities as Q

    x = F.col("p_retailprice")
    d = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", Q.quantity(x * F.lit(1.0000003), "metre", "p").alias("q"))
    return d.select("p_partkey", *[N.shorthand(n)(x).alias(n) for n in ("f2", "nf1", "ng")], N.shorthand("g3")(x * F.lit(1.0000003)).alias("g3"), N.shorthand("ef0")(F.col("q")).alias("ef0"))
