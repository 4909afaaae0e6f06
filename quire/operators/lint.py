"""Style rules for lines: one scan, every rule an expression, findings as rows.

Rules are an array of conditional structs over one projection, so their patterns are constants that are
compiled once and no join multiplies the lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """id; pattern in Java's syntax; message ({} is the text of the group `shown`); what is added to the match's
    start (0-based) for the column, or to the end of its text or group where `behind` says so."""

    id: str
    pattern: str
    message: str
    offset: int = 0
    shown: int = 0
    behind: bool = False
    severity: str = "error"
    kinds: tuple[str, ...] = ("problem", "solution", "answer")


# Identifiers, patterns and messages of the line rules. Lines hold their newline.
RULES = (
    Rule("tab", r"\t", "Tab instead of spaces"),
    Rule("cws", r",[^\s^]", "Comma not followed by whitespace"),
    Rule("sws", r"(?<!\\ang\{;{0,1}|\\qtylist\{[0-9.e;]{1,200}|\\Coord\{[0-9.e;]{1,200});[^\s]", "Semicolon not followed by whitespace"),
    Rule("pas", r"(\\left)?\( ", "Space after left parenthesis"),
    Rule("pas", r"[^ ] +(\\right)?\)", "Space before right parenthesis", 1),
    Rule("tws", r"(?! )[ \t]$", "Trailing whitespace"),
    Rule("spb", r"[^ ]\\\\$", "No space before ending \\\\", 1),
    Rule("frb", r"\\frac[^{]", "\\frac not followed by a brace", 5),
    Rule("csi", r"qty\{[^},]*,", "Comma in \\qty expression"),
    Rule("osi", r"\\SI", "Use \\qty instead of SI"),
    Rule("cnu", r"\\num\{[^},]*,", "Comma in \\num expression"),
    Rule("vep", r"\\varepsilon", "\\varepsilon is not allowed, use plain \\epsilon"),
    Rule("crc", r"\^\{?\\circ\}?", "\\circ is not allowed, use \\ang{...} instead", 2),
    Rule("lbw", r"(?<!\\text)\{\s+[^\s]", "Left brace { followed by whitespace"),
    Rule("rbw", r"[^\s]\s+\}", "Right brace } preceded by whitespace", 2),
    Rule("mzm", r"[Mm]ôžme", "It's spelled \"môžeme\"...", 2),
    Rule("tht", r"[Tt]ohoto", "It's spelled \"tohto\"...", 3),
    Rule("tgc", r"\\[,;.]", "You should not use typographic corrections"),
    Rule("thc", r"\\thinspace", "You should not use typographic corrections"),
    Rule("tjs", r"t\.j\.", "\"t.j.\" needs spaces (\"t. j.\")"),
    Rule("pun", r"\\text(rm)?\{[.,; ]+\}", "No need to enclose punctuation in \\text"),
    Rule("sum", r"\\sum\b", "Use \\Sum[]{} instead"),
    Rule("int", r"\\int\b", "Use \\Int[]{}{} instead"),
    Rule("imp", r"\\implies", "Use \\Implies instead"),
    Rule("rar", r"\\Rightarrow", "You probably want to use \\Implies instead"),
    Rule("txp", r"\\text(it|bf|sf)", "Do not use TeX font styling"),
    Rule("txs", r"\\(sub)?section", "Do not use TeX headings"),
    Rule("txf", r"\\footnote", "Do not use TeX footnotes"),
    Rule("lip", r"\\insertPicture", "Do not use legacy custom figure commands"),
    Rule("uni", r"[“”’–—~]", "Do not use fancy Unicode dashes or quotation marks in the source"),
    Rule("opa", r"\\((arc)?(cos|sin|tan|cot|log|ln))\{\((\\)?.+\)\}", "Omit parentheses in simple functions"),
    Rule("cmk", r"<<<<<<<|=======|>>>>>>>", "Git conflict markers found!"),
    Rule("eqs", r"(=|\\approx|\\doteq|\\geq|\\leq|\\gg|\\ll)(?! |\}|& |[\w-]+(,|\])|[0-9]+mm|$)", "Spaces missing around \"{}\"", -1, 0, True),
    Rule("cdt", r"[^ ]\\cdot[^$]", "Spaces missing around \\cdot", 1),
    Rule("sie", r"(\\ang|\\SI|\\SIlist|\\SIrange)\{[^}]*(\\cdot|\\times|\^)[^}]*\}", "Use e notation instead of TeX inside {}", 1, 1, True),
    Rule("pws", r"(?<! |\"|\(|\[|\{|\$)\+(?! |\"|\)|\]|\})", "Spaces missing around \"+\"", -1),
    Rule("tak", r"\btak\b(?!,)", "Do you really need this \"tak\" here?", 1, severity="warning"),
    Rule("fra", r"\\frac\b", "Use \\dfrac in answers", kinds=("answer",)),
)
LONGEST_LINE = 120
#: Text, or one of the texts, that a line must hold for a rule to match: a plain search that spares most lines the
#: pattern.
HINTS: dict[str, str | tuple[str, ...]] = {
    "pas": ("(", ")"), "tws": "\t", "cmk": ("<<<<<<<", "=======", ">>>>>>>"), "eqs": ("=", "\\"), "sie": "{",
    "tab": "\t", "cws": ",", "sws": ";", "spb": "\\\\", "frb": "\\frac", "csi": "qty{", "osi": "\\SI", "cnu": "\\num{", "vep": "\\varepsilon", "crc": "\\circ", "lbw": "{", "rbw": "}", "mzm": "ôžme", "tht": "ohoto", "thc": "\\thinspace", "tjs": "t.j.", "pun": "\\text",
    "tgc": "\\", "sum": "\\sum", "int": "\\int", "imp": "\\implies", "rar": "\\Rightarrow", "txp": "\\text", "txs": "section", "txf": "\\footnote", "lip": "\\insertPicture", "opa": "{(", "cdt": "\\cdot", "pws": "+", "tak": "tak", "fra": "\\frac",
}


def selected(only: list[str] | None = None, ignore: list[str] | None = None, warnings: bool = False, kind: str | None = None) -> list[Rule]:
    """The rules that apply. Unknown names in ignore raise KeyError; unknown names in only select nothing."""
    known = {r.id for r in RULES} | {"lln", "dds", "rfc", "lfn", "lne"}
    if missing := set(ignore or ()) - known:
        raise KeyError(sorted(missing)[0])
    return [r for r in RULES if (only is None or r.id in only) and r.id not in (ignore or ()) and (warnings or r.severity == "error") and (kind is None and len(r.kinds) > 1 or kind in r.kinds)]


def _struct(rule: str, severity: str, message: str | Column, col: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), col.cast("int").alias("col"))


def _flagged(pattern: str) -> str:
    """Classes (\\s, \\w, \\b) take in all of Unicode, and only a newline ends a line."""
    return ("(?Ud)" if re.search(r"\\[swb]", pattern) else "(?d)") + pattern


def _found(line: Column, pattern: str) -> Column:
    return F.rlike(line, F.lit(_flagged(pattern)))


def _first(line: Column, pattern: str) -> Column:
    """Start of the first match in characters, 0-based: the length of the shortest text that a match follows."""
    return F.length(F.regexp_extract(line, _flagged(rf"^([\s\S]*?)(?:{pattern})"), 1))


def _match_rule(line: Column, r: Rule) -> Column:
    """A rule's finding, or null. Everything but the test itself is computed for lines with a finding only."""
    at, message = _first(line, r.pattern) + r.offset, r.message
    if r.behind:
        text = F.regexp_extract(line, _flagged(r.pattern), r.shown)
        at, message = at + F.length(text), F.concat(*[text if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(\})", r.message))])
    hit = _found(line, r.pattern)
    if r.id in HINTS:
        some = HINTS[r.id] if isinstance(HINTS[r.id], tuple) else (HINTS[r.id],)
        hit = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in some]) & hit
    return F.when(hit, _struct(r.id, r.severity, message, at))


def _length_rule(line: Column) -> Column:
    return F.when(F.length(line) > LONGEST_LINE, _struct("lln", "error", "Line too long", F.lit(LONGEST_LINE - 1)))


# The accepted and the rejected forms of display-mathematics marks.
_NO_SPACE = r"\$\$\{#eq:[a-z0-9:-]+\}"
_GOOD = r"^( *|%)\$\$$|^ *\$\$ \{#eq:[\w:-]+\}$|^\$\$\{|^\}\$\$"
_OPEN, _CLOSE, _ANY = r"^\$\$ ?\\begin\{aligned\}", r"^\\end\{aligned\} ?\$\$", r"\$\$"


def _dollar_rule(line: Column) -> Column:
    f = lambda p: _found(line, p)
    rule = (
        F.when(f(_NO_SPACE), _struct("dds", "error", "Reference missing a space", _first(line, _NO_SPACE) + 4))
        .when(f(_GOOD), F.lit(None))
        .when(f(_OPEN), _struct("dds", "error", "\\begin{aligned} on the same line as $$", F.lit(0)))
        .when(f(_CLOSE), _struct("dds", "error", "\\end{aligned} on the same line as $$", F.lit(0)))
        .otherwise(_struct("dds", "error", "Double dollars within text", _first(line, _ANY)))
    )
    return F.when(F.contains(line, F.lit("$$")), rule)


_LABEL = r"\{#(?:eq|fig|tbl):([^}]+)\}"
MODULES = ("contest", "seminar")


def label_rule(line: Column, kind: Column, node: Column, module: str = "contest") -> Column:
    """A reference label has to name its file's node. contest: the node's id (problem), or the id, a colon and a name
    (solution). seminar: node (volume, semester, round and problem run together), a colon and a name, in any
    file. Another module raises ValueError."""
    if module not in MODULES:
        raise ValueError(f"unsupported module {module!r}")
    label = F.regexp_extract(line, _LABEL, 1)
    named = lambda letters: F.startswith(label, F.concat(node, F.lit(":"))) & F.rlike(F.substring(label, F.length(node) + 2, F.length(label)), F.lit(f"(?U)^{letters}"))
    if module == "seminar":
        ok, message = named(r"\w"), "Nonconforming label"
    else:
        ok, message = F.when(kind == "problem", F.startswith(label, node)).otherwise((kind == "solution") & named("[a-zA-Z0-9_]")), "Invalid label"
    return F.when(F.contains(line, F.lit("{#")) & F.rlike(line, F.lit(_LABEL)) & ~F.coalesce(ok, F.lit(False)), _struct("rfc", "error", message, _first(line, _LABEL) + 6))


def file_rules(line: Column, kind: Column, node: Column) -> list[Column]:
    """The rules of a kind of file (problem, solution, answer), each a finding or null.

    lfn: a label without a name; lne: a label of the node's id and one more character. Their patterns hold the id, so
    they are made for lines with such a label only.
    """
    mark = F.when(kind == "problem", r"\{-?(?:#|@)(?:eq|fig|sec):").when(kind == "solution", r"\{(?:#|@)(?:eq|fig|sec):")
    some = kind.isin("problem", "solution") & F.contains(line, F.lit("{")) & _found(line, r"\{-?[#@](?:eq|fig|sec):")
    empty = F.concat(mark, F.lit(r"\}"))
    longer = F.concat(mark, F.lit(r"\Q"), node, F.lit(r"\E"), F.when(kind == "problem", r"[^ ]\}").otherwise(r"[^:]\}"))
    start = lambda p: F.length(F.call_function("regexp_extract", line, F.concat(F.lit(r"(?Ud)^([\s\S]*?)(?:"), p, F.lit(")")), F.lit(1)))
    test = lambda p: some & F.rlike(line, F.concat(F.lit("(?Ud)"), p))
    lne = F.when(kind == "problem", "Non-empty label in problem").otherwise("Empty or mismatching label in solution")
    answer = [F.when(kind == "answer", _match_rule(line, r)) for r in RULES if r.kinds == ("answer",)]
    return [F.when(test(empty), _struct("lfn", "error", "Label does not match file name", start(empty))), F.when(test(longer), _struct("lne", "error", lne, start(longer))), *answer]


def findings(line: Column, rules: list[Rule] | None = None, extra: bool = True, of_file: list[Column] | None = None) -> Column:
    """Array of (rule_id, severity, message, col): at most one finding a rule. Comment lines (%) and null
    lines have none. col is 0-based. of_file: findings by the file (label_rule, file_rules). The whole array is one
    expression: no join, no Python."""
    by: dict[str, list[Column]] = {}
    for r in selected() if rules is None else rules:
        by.setdefault(r.id, []).append(_match_rule(line, r))
    made = [x[0] if len(x) == 1 else F.coalesce(*x) for x in by.values()]  # of a rule with two patterns the first
    if extra:
        made += [_length_rule(line), _dollar_rule(line)]
    made += of_file or []
    # groups of rules keep each generated method small
    groups = [F.array_compact(F.array(*made[i : i + 12])) for i in range(0, len(made), 12)]
    none = F.array().cast("array<struct<rule_id:string,severity:string,message:string,col:int>>")
    found = F.concat(*groups) if len(groups) > 1 else groups[0] if groups else none
    return F.when(line.isNull() | F.startswith(line, F.lit("%")), none).otherwise(found)


def lint(lines: DataFrame, rules: list[Rule] | None = None, extra: bool = True) -> DataFrame:
    """One row a finding: the columns of lines (line among them), rule_id, severity, message, col."""
    clash = {"rule_id", "severity", "message", "col", "_f"} & set(lines.columns)
    kept = [c for c in lines.columns if c not in clash]
    return lines.select(*kept, F.explode(findings(F.col("line"), rules, extra)).alias("_f")).select(*kept, "_f.*")


def verdicts(lines: DataFrame, *keys: str, rules: list[Rule] | None = None) -> DataFrame:
    """For each text whether no line has a finding, how many have, and the first (by line, then rule order)."""
    f = findings(F.col("line"), rules)
    d = lines.select(*keys, "line_no", f.alias("_f"))
    bad = F.size("_f") > 0
    first = F.min(F.when(bad, F.struct("line_no", F.col("_f")[0]["rule_id"].alias("rule_id"))))
    return d.groupBy(*keys).agg(F.bool_and(~bad).alias("ok"), F.count_if(bad).alias("bad_lines"), first["line_no"].alias("first_line"), first["rule_id"].alias("first_rule"))


def report(found: DataFrame, path: str) -> DataFrame:
    """Diagnostics as text: a heading, the line, and a caret under the column."""
    head = F.concat(F.lit("File "), F.col(path), F.lit(" line "), F.col("line_no").cast("string"), F.lit(": "), F.col("message"))
    body = F.concat_ws("\n", head, F.rtrim(F.regexp_replace("line", "\n$", "")), F.concat(F.repeat(F.lit("-"), F.greatest(F.col("col"), F.lit(0))), F.lit("^")))
    return found.withColumn("report", body)
