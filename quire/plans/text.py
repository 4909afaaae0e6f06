"""Queries on lines of text: lint, rewrites, quotation marks, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import lint as L
from quire.operators import rewrite as R
from quire.operators.lines import join_lines, split_lines
from quire.plans.catalogue import query
from quire.runtime import spread, table

#: Each derived line gets one of these, so that every rule has something to find.
BAITS = (
    "a\tb", "x,y", "a;b", "( a)", "(a )", "end \t", "x\\\\", "\\frac12", "\\qty{1,2}{m}", "\\SI{1}{m}", "\\num{1,2}", "\\varepsilon", "^\\circ", "{ a}", "{a }", "môžme", "tohoto", "\\,", "\\thinspace", "t.j.",
    "\\text{.}", "\\sum a", "\\int a", "\\implies", "\\Rightarrow", "\\textbf{a}", "\\section", "\\footnote", "\\insertPicture", "a – b", "\\sin{(x)}", "=======", "a\\cdot b", "\\SI{1\\cdot 2}", "a+b", "tak je", "$$ a", "plain",
    "x,\u00a0y", "{\u00a0a}", "{a\u00a0}", "see \\summary then \\sum x", "\\integral and \\int x", "\\qtylist{1;2;3}{m} a;b", "\\ang{;;5} a; b", "\\text{ a} { b}", "a=b", "a =b", "a = b", "a \\approx{}b", "a\\leq 5", "height=40mm, x=y, z]", "takýto tak", "x a;b, \U0001d7d9;c",
    "======== x", "^{\\circ}", "$${ a", "a }$$", "\\unit{m} \\qty{1}{m}",
)


def sql_text(s: str) -> str:
    """A string as an SQL literal, with chr() for characters that don't print."""
    parts = []
    for piece in s.replace("\t", "\0\t\0").replace("\n", "\0\n\0").split("\0"):
        parts.append({"\t": "chr(9)", "\n": "chr(10)"}.get(piece) or "'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def lines_sql(source: str, key: str, text: str, *keep: str, where: str = "true") -> str:
    """A DuckDB query for split_lines."""
    cols = ", ".join([key, *keep])
    return (
        f"SELECT {cols}, line_no, l || CASE WHEN line_no < n THEN chr(10) ELSE '' END AS line FROM (SELECT {cols}, len(p) AS n, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS l "
        f"FROM (SELECT {cols}, string_split(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), chr(10)) AS p FROM {source} WHERE {text} IS NOT NULL AND {where}))"
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "text", "doc_id", "lang")


DOC_LINES = lines_sql("documents", "doc_id", "text", "lang")


def baited(spark: SparkSession, sf_dir: str) -> DataFrame:
    bait = F.array(*[F.lit(b) for b in BAITS])
    d = doc_lines(spark, sf_dir)
    bare = F.regexp_replace("line", "\n$", "")
    end = F.when(F.endswith(F.col("line"), F.lit("\n")), "\n").otherwise("")
    return d.withColumn("line", F.concat(bare, F.lit(" "), F.get(bait, ((F.col("doc_id") + F.col("line_no")) % len(BAITS)).cast("int")), end))


BAITED = (
    f"SELECT doc_id, lang, line_no, rtrim(line, chr(10)) || ' ' || ([{', '.join(sql_text(b) for b in BAITS)}])[((doc_id + line_no) % {len(BAITS)})::INT + 1] "
    f"|| CASE WHEN line LIKE '%' || chr(10) THEN chr(10) ELSE '' END AS line FROM ({DOC_LINES})"
)
RULES = L.selected(warnings=True)
#: All whitespace, and the characters of words, in DuckDB's patterns, whose classes are ASCII otherwise.
_WS, _WORD = r"\s\pZ\x{85}", r"\pL\pM\p{Nd}\p{Pc}"
#: Patterns of the twin where the rule's own has look-around or a word border.
_TWIN = {
    "tws": r"\t\n?$", "spb": r"[^ ]\\\\\n?$", "pws": r"(^|[^ \"(\[{$])\+([^ \")\]}]|$)", "sum": rf"\\sum([^{_WORD}]|$)", "int": rf"\\int([^{_WORD}]|$)", "tak": rf"(^|[^{_WORD}])tak([^{_WORD},]|$)",
}
_EQUALS = r"=|\\approx|\\doteq|\\geq|\\leq|\\gg|\\ll"
#: What the twin looks at instead of the line: places that a look-behind exempts are taken out, of the same length.
_SEEN = {"lbw": "replace({0}, '\\text{{', repeat(chr(1), 6))", "sws": r"regexp_replace(regexp_replace({0}, '\\(qtylist|Coord)\{{[0-9.e;]+', chr(1), 'g'), '\\ang\{{;{{1,2}}', chr(1), 'g')"}
_PLAIN = {"sws": f";[^{_WS}]", "lbw": rf"\{{[{_WS}]+[^{_WS}]"}


def _pattern(r: L.Rule) -> str:
    own = _PLAIN.get(r.id) or _TWIN.get(r.id)
    return own or r.pattern.replace(r"[^\s^]", f"[^{_WS}^]").replace(r"[^\s]", f"[^{_WS}]").replace(r"\s+", f"[{_WS}]+")


def hit_sql(r: L.Rule, line: str = "line") -> str:
    """A DuckDB predicate for a rule."""
    if r.id == "eqs":  # what follows each relation must begin in one of these ways
        parts = f"string_split_regex({line}, {sql_text(_EQUALS)})"
        ends = f"(i = len({parts}) AND p IN ('', chr(10)))"
        return rf"len(list_filter({parts}, lambda p, i: i > 1 AND NOT {ends} AND NOT regexp_matches(p, '^( |\}}|& |[{_WORD}-]+(,|\])|[0-9]+mm)'))) > 0"
    return f"regexp_matches({_SEEN.get(r.id, '{0}').format(line)}, {sql_text(_pattern(r))})"


def hits_sql(lines: str, rules: list[L.Rule]) -> str:
    found = f"list_distinct(list_filter([{', '.join(f"CASE WHEN {hit_sql(r)} THEN '{r.id}' END" for r in rules)}], lambda x: x IS NOT NULL))"
    return f"SELECT doc_id, lang, line_no, unnest({found}) AS rule_id FROM ({lines}) l WHERE NOT starts_with(line, '%')"


def _split(rules: list[L.Rule]) -> list[list[L.Rule]]:
    return [rules[i : i + 10] for i in range(0, len(rules), 10)]


#: (in groups: one expression of all rules is more than DuckDB likes)
ALL_HITS = lambda lines: "SELECT DISTINCT * FROM (" + " UNION ALL ".join(hits_sql(lines, part) for part in _split(RULES)) + ")"
_DDS = r"regexp_matches(line, '\$\$') AND (regexp_matches(line, '\$\$\{#eq:[a-z0-9:-]+\}') OR NOT regexp_matches(line, '^( *|%)\$\$\n?$|^ *\$\$ \{#eq:[\pL\pN\pM_:-]+\}\n?$|^\$\$\{|^\}\$\$'))"
ALL_FOUND = lambda lines: (
    f"{ALL_HITS(lines)} UNION ALL SELECT doc_id, lang, line_no, 'lln' FROM ({lines}) WHERE length(line) > 120 AND NOT starts_with(line, '%') UNION ALL SELECT doc_id, lang, line_no, 'dds' FROM ({lines}) WHERE NOT starts_with(line, '%') AND {_DDS}"
)


@query(f"SELECT lang, rule_id, count(*) AS n FROM ({ALL_FOUND(DOC_LINES)}) GROUP BY ALL")
def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lint(doc_lines(spark, sf_dir), RULES).groupBy("lang", "rule_id").agg(F.count("*").alias("n"))


@query(ALL_FOUND(BAITED))
def lint_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lint(baited(spark, sf_dir), RULES).select("doc_id", "lang", "line_no", "rule_id")


#: Rules whose column the twin gets from the text before the first match: split there, and measured.
_BEFORE = [r for r in RULES if r.id not in ("pas", "sie", "eqs", "pws", "tak", "sws")]


def _col_sql(r: L.Rule) -> str:
    return f"SELECT doc_id, line_no, '{r.id}' AS rule_id, {sql_text(r.message)} AS message, (length(string_split_regex({_SEEN.get(r.id, '{0}').format('line')}, {sql_text(_pattern(r))})[1]) + {r.offset})::INT AS col FROM lines WHERE {hit_sql(r)}"


_PAS = r"CASE WHEN regexp_matches(line, '(\\left)?\( ') THEN length(string_split_regex(line, '(\\left)?\( ')[1]) ELSE length(string_split_regex(line, '[^ ] +(\\right)?\)')[1]) + 1 END"
_EVERY_COLUMN = " UNION ALL ".join(
    [
        *map(_col_sql, _BEFORE),
        rf"SELECT doc_id, line_no, 'pas', CASE WHEN regexp_matches(line, '(\\left)?\( ') THEN 'Space after left parenthesis' ELSE 'Space before right parenthesis' END, ({_PAS})::INT FROM lines WHERE regexp_matches(line, '(\\left)?\( |[^ ] +(\\right)?\)')",
        # the last command of those that may stand there, with its brace, begins where the braces' text before it ends
        r"SELECT doc_id, line_no, 'sie', 'Use e notation instead of TeX inside ' || regexp_extract(line, p, 1), (length(string_split_regex(line, p)[1]) + length(regexp_extract(line, p, 1)) + 1)::INT FROM (SELECT *, '(\\ang|\\SI|\\SIlist|\\SIrange)\{[^}]*(\\cdot|\\times|\^)[^}]*\}' AS p FROM lines) WHERE regexp_matches(line, p)",
        # a plus sign that no blank, quote or bracket touches on either side
        "SELECT doc_id, line_no, 'pws', 'Spaces missing around \"+\"', (list_min(list_filter(range(1, length(line) + 1), lambda i: line[i] = '+' AND NOT (i > 1 AND line[i - 1] IN (' ', '\"', '(', '[', '{', '$')) AND line[i + 1] NOT IN (' ', '\"', ')', ']', '}'))) - 2)::INT FROM lines WHERE "
        + hit_sql(next(r for r in RULES if r.id == "pws")),
    ]
)


@query(f"WITH lines AS (SELECT * FROM ({BAITED}) WHERE NOT starts_with(line, '%')) {_EVERY_COLUMN}")
def lint_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and columns of the rules that SQL can place (eqs, tak and sws are tested on examples)."""
    rules = [r for r in RULES if r in _BEFORE or r.id in ("pas", "sie", "pws")]
    return L.lint(baited(spark, sf_dir), rules, extra=False).select("doc_id", "line_no", "rule_id", "message", "col")


@query(f"SELECT d.doc_id, count(b.line_no) = 0 AS ok, count(b.line_no) AS bad_lines, min(b.line_no) AS first_line FROM (SELECT DISTINCT doc_id FROM ({DOC_LINES})) d LEFT JOIN (SELECT DISTINCT doc_id, line_no FROM ({ALL_FOUND(DOC_LINES)})) b ON b.doc_id = d.doc_id GROUP BY d.doc_id")
def lint_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.verdicts(doc_lines(spark, sf_dir), "doc_id", rules=RULES).select("doc_id", "ok", "bad_lines", "first_line")


@query(f"SELECT rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({hits_sql(BAITED, [r for r in RULES if r.id in ('cws', 'uni', 'tab')])}) GROUP BY rule_id")
def lint_only_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = L.selected(only=["cws", "uni", "tab", "osi"], ignore=["osi"])
    return L.lint(baited(spark, sf_dir), rules, extra=False).groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT lang, count(*) AS lines, count(*) FILTER (length(line) > 120) AS long_lines, max(length(line))::INT AS longest FROM ({DOC_LINES}) GROUP BY lang")
def line_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("line")
    return doc_lines(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("lines"), F.count_if(n > L.LONGEST_LINE).alias("long_lines"), F.max(n).alias("longest"))


FILES = "(SELECT DISTINCT file_id, problem_id, filename, content FROM problem_files WHERE content IS NOT NULL)"
_FILE_LINES = lines_sql(FILES, "file_id", "content", "problem_id", "filename")


def _file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "problem_files").where("content is not null").dropDuplicates(["file_id"])
    return split_lines(files, "content", "file_id", "problem_id", "filename")


@query(
    f"SELECT file_id, line_no, 'rfc' AS rule_id FROM (SELECT *, regexp_extract(line, '\\{{#(eq|fig|tbl):([^}}]+)\\}}', 2) AS label FROM ({_FILE_LINES}) WHERE NOT starts_with(line, '%') AND regexp_matches(line, '\\{{#(eq|fig|tbl):([^}}]+)\\}}')) "
    "WHERE NOT CASE WHEN filename = 'problem.md' THEN starts_with(label, problem_id) ELSE starts_with(label, problem_id || ':') AND regexp_matches(label[length(problem_id) + 2:], '^[a-zA-Z0-9_]') END"
)
def lint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.replace(F.col("filename"), F.lit(".md"), F.lit(""))
    d = _file_lines(spark, sf_dir).where(~F.startswith(F.col("line"), F.lit("%")))
    return d.select("file_id", "line_no", L.label_rule(F.col("line"), kind, F.col("problem_id")).alias("f")).where("f is not null").select("file_id", "line_no", "f.rule_id")


#: Labels that derived lines end with, by file and line; {0} is the problem's id.
_LABELS = ("{{#eq:}}", "{{-#fig:}}", "{{#eq:{0}x}}", "{{@sec:{0}:}}", "{{#eq:{0}}}", "{{#tbl:{0}:a}}", "\\frac12", "")
_LABELLED = f"SELECT file_id, problem_id, stem, line_no, rtrim(line, chr(10)) || replace(([{', '.join(sql_text(x.format('(id)')) for x in _LABELS)}])[(file_id + line_no) % {len(_LABELS)} + 1], '(id)', problem_id) AS line FROM (SELECT *, (['problem', 'solution', 'answer'])[file_id % 3 + 1] AS stem FROM ({_FILE_LINES}))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _file_lines(spark, sf_dir)
    mark = F.get(F.array(*[F.lit(x.format("(id)")) for x in _LABELS]), ((F.col("file_id") + F.col("line_no")) % len(_LABELS)).cast("int"))
    stem = F.get(F.array(*[F.lit(x) for x in ("problem", "solution", "answer")]), (F.col("file_id") % 3).cast("int"))
    return d.withColumn("line", F.concat(F.regexp_replace("line", "\n$", ""), F.replace(mark, F.lit("(id)"), F.col("problem_id")))).withColumn("stem", stem)


_AT = "length(string_split_regex(line, {0})[1])::INT"
_LFN = "CASE stem WHEN 'problem' THEN '\\{-?[#@](eq|fig|sec):\\}' WHEN 'solution' THEN '\\{[#@](eq|fig|sec):\\}' END"
_LNE = "CASE stem WHEN 'problem' THEN '\\{-?[#@](eq|fig|sec):' || regexp_escape(problem_id) || '[^ ]\\}' WHEN 'solution' THEN '\\{[#@](eq|fig|sec):' || regexp_escape(problem_id) || '[^:]\\}' END"


@query(
    f"WITH lines AS (SELECT *, {_LFN} AS lfn, {_LNE} AS lne FROM ({_LABELLED}) WHERE NOT starts_with(line, '%')) SELECT file_id, line_no, 'lfn' AS rule_id, 'Label does not match file name' AS message, {_AT.format('lfn')} AS col FROM lines WHERE regexp_matches(line, lfn) "
    f"UNION ALL SELECT file_id, line_no, 'lne', CASE stem WHEN 'problem' THEN 'Non-empty label in problem' ELSE 'Empty or mismatching label in solution' END, {_AT.format('lne')} FROM lines WHERE regexp_matches(line, lne) "
    f"UNION ALL SELECT file_id, line_no, 'fra', 'Use \\dfrac in answers', {_AT.format(chr(39) + chr(92) * 2 + 'frac([^' + _WORD + ']|$)' + chr(39))} FROM lines WHERE stem = 'answer' AND regexp_matches(line, '\\\\frac([^{_WORD}]|$)')"
)
def lint_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that depend on the kind of file and on its problem's id."""
    line = F.col("line")
    found = L.findings(line, [], False, L.file_rules(line, F.col("stem"), F.col("problem_id")))
    return _labelled(spark, sf_dir).select("file_id", "line_no", F.explode(found).alias("f")).select("file_id", "line_no", "f.rule_id", "f.message", "f.col")


@query(
    f"SELECT file_id, line_no, 'Nonconforming label' AS message, (length(string_split_regex(line, '\\{{#(eq|fig|tbl):[^}}]+\\}}')[1]) + 6)::INT AS col FROM ({_LABELLED}) WHERE NOT starts_with(line, '%') AND regexp_matches(line, '\\{{#(eq|fig|tbl):([^}}]+)\\}}') "
    f"AND NOT regexp_matches(regexp_extract(line, '\\{{#(eq|fig|tbl):([^}}]+)\\}}', 2), '^' || regexp_escape(problem_id) || ':[{_WORD}]')"
)
def lint_seminar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    found = L.findings(line, [], False, [L.label_rule(line, F.col("stem"), F.col("problem_id"), "seminar")])
    return _labelled(spark, sf_dir).select("file_id", "line_no", F.explode(found).alias("f")).select("file_id", "line_no", "f.message", "f.col")


@query(
    f"SELECT doc_id, line_no, 'File ' || doc_id || ' line ' || line_no || ': Comma not followed by whitespace' || chr(10) || rtrim(rtrim(line, chr(10))) || chr(10) || repeat('-', strpos(line, regexp_extract(line, ',[^\\s\\pZ\\x{{85}}^]')) - 1) || '^' AS report FROM ({DOC_LINES}) "
    "WHERE NOT starts_with(line, '%') AND regexp_matches(line, ',[^\\s\\pZ\\x{85}^]')"
)
def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.lint(doc_lines(spark, sf_dir), L.selected(only=["cws"]), extra=False).withColumn("path", F.col("doc_id").cast("string"))
    return L.report(d, "path").select("doc_id", "line_no", "report")


#: Tags that a derived first line begins with, by document.
TAGS = ("", "@L ", "@H ", "@E ", "@TODO ", "% ", "@T ")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.get(F.array(*[F.lit(t) for t in TAGS]), (F.col("doc_id") % len(TAGS)).cast("int"))
    return doc_lines(spark, sf_dir).withColumn("line", F.when(F.col("line_no") == 1, F.concat(tag, "line")).otherwise(F.col("line")))


_TAGGED = f"SELECT doc_id, line_no, CASE WHEN line_no = 1 THEN ([{', '.join(sql_text(t) for t in TAGS)}])[(doc_id % {len(TAGS)})::INT + 1] ELSE '' END || line AS line FROM ({DOC_LINES})"


def replaced_sql(lines: str, rules: list[tuple[str, str]]) -> str:
    """Nested regexp_replace for simple rules: Java's $1 becomes \\1."""
    import re

    expr = "line"
    for pattern, becomes in rules:
        new = re.sub(r"\\(.)", r"\1", becomes.replace("\\$", "\0"))
        new = re.sub(r"\$(\d)", r"\\\1", new.replace("\\", "\\\\")).replace("\0", "$")
        if re.search(r"(?<!\\)\$$", pattern) and not pattern.startswith("(?m)"):
            pattern = pattern[:-1] + r"(\n?)$"
        if pattern.endswith("(\\n?)$"):
            new += "\\" + str(pattern.count("(") - pattern.count("\\("))
        expr = f"regexp_replace({expr}, {sql_text(pattern)}, {sql_text(new)}, 'g')"
    return f"SELECT doc_id, line_no, {expr} AS line FROM ({lines})"


@query(replaced_sql(_TAGGED, R._rules(R.RULES, "pre", "latex")))
def rewrite_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("doc_id", "line_no", R.rewrite(F.col("line"), "pre", "latex").alias("line"))


@query(replaced_sql(_TAGGED, R._rules(R.RULES, "pre", "html")))
def rewrite_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("doc_id", "line_no", R.rewrite(F.col("line"), "pre", "html").alias("line"))


_PICTURE = 'regexp_replace(line, \'!\\[(.*)\\]\\((.*)\\)(\\{.*height=([0-9]+)mm\\})?\', \'<img src="\\2" style="height:\\4mm">\', \'g\')'


@query(
    replaced_sql(f"SELECT file_id AS doc_id, line_no, {_PICTURE} AS line FROM ({_FILE_LINES})", R._rules(R.RULES, "post", "html"))
)
def rewrite_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _file_lines(spark, sf_dir)
    img = F.regexp_replace("line", r"!\[(.*)\]\((.*)\)(\{.*height=([0-9]+)mm\})?", '<img src="$2" style="height:$4mm">')
    return d.select(F.col("file_id").alias("doc_id"), "line_no", R.rewrite(img, "post", "html").alias("line"))


@query(
    f"SELECT doc_id, line_no, list_filter([CASE WHEN regexp_matches(line, '<<<<<<<<|========|>>>>>>>>') THEN 'Git conflict markers present' END, CASE WHEN regexp_matches(line, '\\^\\\\circ|\\^\\{{\\\\circ\\}}') THEN 'No \\circ allowed in exponents' END], lambda x: x IS NOT NULL)[1] AS error FROM ({BAITED}) WHERE error IS NOT NULL"
)
def precheck_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = baited(spark, sf_dir).select("doc_id", "line_no", R.violations(F.col("line"), "pre", "latex").alias("e"))
    return d.where(F.size("e") > 0).select("doc_id", "line_no", F.col("e")[0].alias("error"))


@query("SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_lines(doc_lines(spark, sf_dir), "doc_id")


_NEAR = [("'\"_'", "c || '_'"), (f"'\"([{_WORD}])'", "o || '\\1'"), (f"'([{_WORD}])\"'", "'\\1' || c"), (f"'([^{_WS}])\"'", "'\\1' || c"), (f"'\"([^{_WS}])'", "o || '\\1'")]
_QUOTED = "regexp_replace(line, '[„“”«»]', '\"', 'g')"
for _mark, _new in _NEAR:
    _QUOTED = f"regexp_replace({_QUOTED}, {_mark}, {_new}, 'g')"


@query(f"SELECT doc_id, line_no, {_QUOTED} AS line FROM (SELECT d.doc_id, d.line_no, d.line, l.quotes.open_mark AS o, l.quotes.close_mark AS c FROM ({DOC_LINES}) d JOIN locales l ON l.id = d.lang)")
def quotes_localised(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "locales").select(F.col("id").alias("lang"), F.col("quotes.open_mark").alias("o"), F.col("quotes.close_mark").alias("c"))
    plain = F.regexp_replace("line", "[„“”«»]", '"')
    d = doc_lines(spark, sf_dir).join(marks, "lang")
    return d.select("doc_id", "line_no", R.localise_quotes(plain, F.col("o"), F.col("c")).alias("line"))
