"""Ordered rewrite rules for lines, by phase and output format, as nested replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pattern and replacement (Java syntax) of the rewrites, in the order of application.
RULES: dict[tuple[str, str], tuple[tuple[str, str], ...]] = {
    ("pre", "all"): (
        (r"(?m)^%.*$", ""),
        (r"(^|\s*)\$\$\{", r"$1\$\$" + "\n" + r"$1\\begin{aligned}"),
        (r"(^|\s+)\}\$\$", r"$1\\end{aligned}" + "\n" + r"$1\$\$"),
    ),
    ("pre", "latex"): (
        (r"^@E\s*(.*)$", r"\\errorMessage{$1}"),
        (r"^@L\s*(.*)$", "$1"),
        (r"^@H\s*(.*)$", ""),
        (r"^@T([Oo][Dd][Oo])?\s*(.*)$", r"\\todoMessage{$2}"),
    ),
    ("pre", "html"): (
        (r"^@E\s*(.*)$", "Error: $1"),
        (r"^@L\s*(.*)$", ""),
        (r"^@H\s*(.*)$", "$1"),
        (r"^@T([Oo][Dd][Oo])?\s*(.*)$", "TODO: $2"),
        (r"\\qty", r"\\SI"),
        (r"\\unit", r"\\si"),
    ),
    ("post", "latex"): (
        (r"\\includegraphics(\[.*\])?\{(.*)\.(svg|gp|tikz)\}", r"\\insertPicture$1{$2.pdf}"),
        (r"\\includesvg\[(.*)\]\{(.*)\.(svg|gp)\}", r"\\begin{figure}\\centering\\insertPicture[$1]{$2.pdf}\\end{figure}"),
        (r"\\includegraphics\[(.*)\]\{(.*)\.(png|jpg|pdf)\}", r"\\insertPicture[$1]{$2.$3}"),
        (r"^\\caption\{\}(\\label\{.*\})?\n", ""),
    ),
    ("post", "html"): (
        (r'<img src="(.*)\.(jpg|png|svg)"', r'<img src="obrazky/$1.$2"'),
        (r'<img src="(.*)\.gp"', r'<img src="obrazky/$1.png"'),
        (r'style="height:([0-9.]*)mm"', r'style="max-width: 100%; max-height: calc(1.7 * $1mm); margin: auto; display: block;"'),
        (r"<figcaption>Obrázok (\d*):", r'<figcaption style="text-align: center;">Obrázok $1: <span style="font-style: italic;">'),
        (r"(\\num|\\SI)\{e", r"$1{1.e"),
        (r"(\\num|\\SI)\{([0-9])e", r"$1{$2.e"),
        (r"\\qty", r"\\SI"),
        (r"\\unit", r"\\si"),
    ),
}
# What must not be found before and after the rewrites, and the message.
CHECKS: dict[tuple[str, str], tuple[tuple[str, str], ...]] = {
    ("pre", "all"): ((r"<<<<<<<<|========|>>>>>>>>", "Git conflict markers present"), (r"\^\\circ|\^\{\\circ\}", "No \\circ allowed in exponents")),
    ("post", "html"): (
        (r'<img src="(?!obrazky)', "Caught an image without 'obrazky/'"),
        (r"\\includegraphics", "Caught an unconverted \\includegraphics"),
        (r"\\includesvg", "Caught an unconverted \\includesvg"),
        (r"@L", "LaTeX-only tag in HTML"),
    ),
    ("post", "latex"): ((r"@H", "HTML-only tag in LaTeX"),),
}
FORMATS = ("latex", "html")


def _rules(table: dict, phase: str, fmt: str) -> list[tuple[str, str]]:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    return [*table.get((phase, "all"), ()), *table.get((phase, fmt), ())]


def rewrite(line: Column, phase: str, fmt: str) -> Column:
    """The line after all rewrites of a phase, each applied to the result of the one before. Null stays null."""
    return reduce(lambda c, r: F.regexp_replace(c, F.lit("(?d)" + r[0]), F.lit(r[1])), _rules(RULES, phase, fmt), line)


def violations(line: Column, phase: str, fmt: str) -> Column:
    """Array of the messages of a phase's checks that the line fails; null lines fail none."""
    made = [F.when(F.rlike(line, F.lit("(?d)" + p)), F.lit(m)) for p, m in _rules(CHECKS, phase, fmt)]
    return F.array_compact(F.array(*made))


def convert(line: Column, fmt: str) -> Column:
    """Both phases of rewrites, without the Markdown conversion that lies between them elsewhere."""
    return rewrite(rewrite(line, "pre", fmt), "post", fmt)


def converted(lines: DataFrame, keys: list[str], fmt: str) -> DataFrame:
    """One row a text from its lines: the text after all rewrites, without newlines at its end, and the first error of its
    checks (by line; null if there is none). An error doesn't keep a text from being converted."""
    after = convert(F.col("line"), fmt)
    d = lines.select(*keys, "line_no", after.alias("_l"), F.concat(violations(F.col("line"), "pre", fmt), violations(after, "post", fmt)).alias("_e"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "_l")))
    error = F.min_by(F.col("_e")[0], F.when(F.size("_e") > 0, F.col("line_no")))
    d = d.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_l"]), "").alias("_t"), F.when(F.max(F.size("_e")) > 0, error).alias("error"))
    return d.select(*keys, F.rtrim("_t", F.lit("\n")).alias("text"), "error")


# Where a straight quotation mark stands, in the order of application, and which mark it becomes.
QUOTES = ((r'"(_)', "{close}$1"), (r'"(\b)', "{open}$1"), (r'(\b)"', "$1{close}"), (r'(\S)"', "$1{close}"), (r'"(\S)', "{open}$1"))


def localise_quotes(line: Column, opening: Column, closing: Column) -> Column:
    """Straight quotation marks to a locale's marks, by what stands beside them. Null marks give null."""
    for pattern, becomes in QUOTES:
        before, after = becomes.split("{open}" if "{open}" in becomes else "{close}")
        mark = opening if "{open}" in becomes else closing
        line = F.regexp_replace(line, F.lit("(?U)" + pattern), F.concat(F.lit(before), mark, F.lit(after)))
    return line
