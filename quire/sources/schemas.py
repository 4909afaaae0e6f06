"""Schemas of the structured documents, as Spark DDL, and reading documents by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import validate as V

_QUOTES = "STRUCT<open STRING, close STRING, babel_id STRING, extra STRING>"
_FORM = "STRUCT<singular STRING, plural STRING>"
_PERSON = "STRUCT<name STRING, gender STRING>"

# The fields of each kind of document.
SCHEMAS: dict[str, str] = {
    "locale": f"id STRING, full STRING, native STRING, locale STRING, quotes {_QUOTES}, cref MAP<STRING, {_FORM}>, rtl BOOLEAN, siunitx STRUCT<list_pair_separator STRING, list_final_separator STRING, output_decimal_marker STRING, units MAP<STRING, STRING>>",
    "constant": "name STRING, symbol STRING, magnitude DOUBLE, unit STRING, digits INT, aliases ARRAY<STRING>, exact BOOLEAN, force_f BOOLEAN, si_extra MAP<STRING, STRING>",
    "contest_competition": "id STRING, tearoff STRUCT<per_page INT, height INT, team_space INT, barcode_space INT, bottomsep INT, inner INT>, organisation STRUCT<name STRING, address STRING>, url STRING, hacks MAP<STRING, STRING>",
    "contest_volume": "id STRING, number INT, date DATE, authors STRUCT<problems ARRAY<STRING>, pictures ARRAY<STRING>, editors ARRAY<STRING>, head STRING>, workshop STRING, problems ARRAY<STRUCT<id STRING, number INT, tags ARRAY<STRING>, author ARRAY<STRING>>>, constants MAP<STRING, ARRAY<STRING>>, table INT, start INT",
    "contest_language": "id STRING, booklet STRUCT<contents STRUCT<intro BOOLEAN, problems BOOLEAN, solutions BOOLEAN, answers BOOLEAN>>, translators ARRAY<STRING>, name STRING, rtl BOOLEAN",
    "contest_venue": "id STRING, code STRING, name STRING, language STRING, orgs ARRAY<STRING>, evaluators INT, start INT",
    "team": "id INT, code STRING, contact_email STRING, contact_name STRING, contestants STRING, display_name STRING, in_school_symbol STRING, language STRING, name STRING, number STRING, school STRING, status STRING, venue STRING, venue_code STRING, venue_id INT",
    "build": "user STRING, tool STRUCT<hash STRING, branch STRING>, repo STRUCT<hash STRING, branch STRING>, timestamp TIMESTAMP",
    "seminar_competition": "id STRING, short STRING, full STRUCT<nominative STRING, genitive STRING, locative STRING>, urls STRUCT<web STRING, submit STRING>, language STRING, categories ARRAY<ARRAY<STRING>>, founded INT, email STRING, head STRUCT<name STRING, email STRING, phone STRING>",
    "seminar_volume": "id STRING, number INT, categories ARRAY<ARRAY<STRING>>",
    "seminar_semester": f"id STRING, number INT, neuter {_FORM.replace('singular', 'nominative').replace('plural', 'genitive')}, feminine {_FORM.replace('singular', 'nominative').replace('plural', 'genitive')}",
    "seminar_round": "deadline DATE, instagram STRUCT<skin STRING, text_colour STRING>, id STRING, number INT",
    "seminar_problem": f"title STRING, categories ARRAY<STRING>, number INT, id STRING, evaluation ARRAY<{_PERSON}>, solution ARRAY<{_PERSON}>, points STRUCT<description INT, code INT, extra INT>",
    "course": "id STRING, title STRING, language STRING",
    "year": "id STRING, number INT, teacher STRUCT<name STRING, email STRING>",
    "homework": "deadline DATE, id STRING, number INT, problems ARRAY<STRUCT<id STRING, title STRING, bonus BOOLEAN>>",
    "handout": "id STRING, number INT, title STRING, date DATE, problems ARRAY<STRUCT<id STRING>>",
    "standalone": "id STRING, values MAP<STRING, STRING>, eq MAP<STRING, STRING>",
}


def parse(df: DataFrame, json: str, kind: str, strict: bool = False, name: str = "document") -> DataFrame:
    """df with the JSON texts of a column as documents of a kind. Text that isn't such a document raises
    (strict) or gives a null document; null gives null; unknown fields are dropped."""
    return df.withColumn(name, F.from_json(F.col(json), SCHEMAS[kind], {"mode": "FAILFAST" if strict else "PERMISSIVE"}))


# The tags that a problem may carry.
TAGS = ("elegant", "troll", "trick", "silly", "unreal", "creative", "circuit", "resistance", "rlc", "elmag", "kinematics", "uam", "paaa", "cog", "calorimetry", "thermo-process", "optics", "blackbody", "nuclear")
_FORMS = ("figure", "table", "equation", "listing", "section")


def _present(d: Column, *paths: str) -> dict[str, Column]:
    def at(path: str) -> Column:
        c = d
        for step in path.split("."):
            c = c[step]
        return c

    return {p: at(p).isNotNull() for p in paths}


def _minute(c: Column) -> Column:
    return c.between(0, 1439)


def rules(kind: str, d: Column) -> dict[str, Column]:
    """What a document of a kind (a struct in the form of its schema) must fulfil, by name of the field.

    Fields that aren't optional must be there; texts that may not be empty, codes, ranges and lists of allowed
    values are tested. Kinds without further constraints need their id only.
    """
    some = V.not_empty
    language = lambda c: V.literal(c, *V.LANGUAGES)
    tags = lambda items: items.isNull() | V.each(items, lambda t: V.literal(t, *TAGS))
    if kind == "contest_competition":
        return {"id": some(d["id"]), "url": some(d["url"]), "hacks": d["hacks"].isNotNull(), "organisation.name": some(d["organisation"]["name"]), "organisation.address": some(d["organisation"]["address"])} | _present(d, *[f"tearoff.{x}" for x in ("per_page", "height", "team_space", "barcode_space", "bottomsep", "inner")])
    if kind == "contest_volume":
        problem = lambda p: V.all_of(V.matches(p["id"], "[a-z0-9-]+"), p["number"].isNotNull(), tags(p["author"]))
        return {"id": some(d["id"]), "number": d["number"] >= 0, "start": _minute(d["start"]), "problems": V.each(d["problems"], problem)} | _present(d, "date", "authors.problems", "authors.pictures", "authors.editors", "authors.head", "workshop", "constants", "table")
    if kind == "contest_language":
        return {"id": language(d["id"])} | _present(d, "name", "rtl", *[f"booklet.contents.{x}" for x in ("intro", "problems", "solutions", "answers")])
    if kind == "contest_venue":
        return {"id": some(d["id"]), "code": V.matches(d["code"], "[A-Z]{5}"), "name": some(d["name"]), "language": language(d["language"]), "orgs": V.optional(d["orgs"], V.each(d["orgs"], some)), "evaluators": d["evaluators"].isNotNull(), "start": _minute(d["start"])}
    if kind == "team":
        return {
            "id": d["id"].between(0, 9999), "contact_email": some(d["contact_email"]), "contact_name": some(d["contact_name"]), "display_name": some(d["display_name"]), "in_school_symbol": V.optional(d["in_school_symbol"], F.length(d["in_school_symbol"]) == 1),
            "language": language(d["language"]), "venue": some(d["venue"]), "venue_code": F.length(d["venue_code"]) == 5,
        } | _present(d, "code", "contestants", "school", "status", "venue_id")
    if kind == "locale":
        forms = {f"cref.{x}": d["cref"][x]["singular"].isNotNull() & d["cref"][x]["plural"].isNotNull() for x in _FORMS}
        return forms | _present(d, "id", "full", "native", "locale", "quotes.open", "quotes.close", "quotes.babel_id", "siunitx.list_pair_separator", "siunitx.list_final_separator", "siunitx.output_decimal_marker")
    if kind == "build":
        return {"user": some(d["user"])} | {f"{x}.hash": V.matches(d[x]["hash"], "[a-f0-9]+") for x in ("tool", "repo")} | _present(d, "tool.branch", "repo.branch", "timestamp")
    if kind == "constant":
        return {"name": some(d["name"])} | _present(d, "symbol", "magnitude", "digits")
    return {"id": some(d["id"])}


#: What a field that isn't given counts as, by kind.
DEFAULTS = {"contest_language": {"translators": "array()"}, "locale": {"rtl": "false"}, "constant": {"aliases": "array()", "exact": "false", "force_f": "false"}}


def with_defaults(df: DataFrame, kind: str, name: str = "document") -> DataFrame:
    """df with the defaults of a kind's fields filled in; a null document stays null."""
    d = F.col(name)
    fields = {k: F.coalesce(d[k], F.expr(v).cast(df.select(d[k].alias("x")).schema["x"].dataType)) for k, v in DEFAULTS.get(kind, {}).items()}
    return df.withColumn(name, F.when(d.isNotNull(), d.withField(next(iter(fields)), next(iter(fields.values()))) if len(fields) == 1 else _with(d, fields))) if fields else df


def _with(d: Column, fields: dict[str, Column]) -> Column:
    for k, v in fields.items():
        d = d.withField(k, v)
    return d


def invalid(df: DataFrame, kind: str, key: list[str], name: str = "document") -> DataFrame:
    """(key, rule): the fields of each document that break its kind's rules; a null document breaks them all."""
    return V.violations(df, key, rules(kind, F.col(name)))
