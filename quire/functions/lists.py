"""Lists, people and dates as text. All are Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "\\errorMessage{?}"


def render_list(items: Column, func: Callable[[Column], Column] | None = None, and_word: str | Column = "a", oxford: bool = False) -> Column:
    """x, y a z. An empty array gives '', a null one null; null items are left out."""
    x = F.array_compact(items)
    x = F.transform(x, func) if func else x
    n = F.size(x)
    word = F.concat(F.lit(" "), and_word if isinstance(and_word, Column) else F.lit(and_word), F.lit(" "))
    head = F.array_join(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), ", ")
    comma = F.when(n > 2, ",").otherwise("") if oxford else F.lit("")
    return F.when(items.isNull(), None).when(n == 0, "").when(n == 1, x[0]).otherwise(F.concat(head, comma, word, F.get(x, n - 1)))


def people(names: Column, genders: Column | None = None) -> Column:
    """Array of (name, gender) from an array of names; gender '?' where unknown."""
    g = genders if genders is not None else F.transform(names, lambda _: F.lit("?"))
    return F.zip_with(names, g, lambda n, x: F.struct(n.alias("name"), F.coalesce(x, F.lit("?")).alias("gender")))


def render_people(persons: Column, and_word: str = "a") -> Column:
    """The names of an array of (name, gender), listed; an empty or null name shows as an error message."""
    return render_list(F.transform(persons, lambda p: F.coalesce(F.nullif(p["name"], F.lit("")), F.lit(UNKNOWN))), None, and_word)


def gender_suffix(persons: Column) -> Column:
    """Ending of a past tense: i for several, '' a o for one man, woman, child; an error message for '?'."""
    g = persons[0]["gender"]
    one = F.when(g == "m", "").when(g == "f", "a").when(g == "n", "o").when(g == "?", UNKNOWN).otherwise(F.raise_error(F.concat(F.lit("unknown gender "), g)).cast("string"))
    return F.when(persons.isNull() | (F.size(persons) == 0), None).when(F.size(persons) > 1, "i").otherwise(one)


def isotex(day: Column) -> Column:
    """A date with TeX dashes."""
    return F.date_format(day, "yyyy'--'MM'--'dd")


def wrapped(command: str, s: Column) -> Column:
    """A TeX command around a text, as textit, textbf."""
    return F.concat(F.lit(f"\\{command}{{"), s, F.lit("}"))


def math_inline(content: Column) -> Column:
    """Within text; a newline at the end is dropped."""
    return F.concat(F.lit("$"), F.regexp_replace(content, r"\n\z", ""), F.lit("$"))


def math_aligned(content: Column, label: Column) -> Column:
    """A labelled display of aligned lines, each indented by four spaces."""
    body = F.regexp_replace(F.regexp_replace(content, r"\n\z", ""), r"(?m)^(?!\z)", "    ")
    return F.concat(F.lit("$${\n"), body, F.lit("\n}$$ {#eq:"), label, F.lit("}"))


def title(s: Column) -> Column:
    """Each word with a capital letter and small ones after it; words end at blanks and at -, (, {, [ and <."""
    words = F.split(F.lower(s), r"(?<=[-\s({\[<])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1_000_000))), "")


def math_display(content: Column, label: Column) -> Column:
    """A labelled display equation, each line of it indented by four spaces."""
    return F.concat(F.lit("$$\n"), F.regexp_replace(content, r"(?m)^(?!\z)", "    "), F.lit("\n$$ {#eq:"), label, F.lit("}"))


PERSON = "struct<name:string,gender:string>"


def people_of(json: Column) -> Column:
    """Array of (name, gender) from JSON: a name, an object with name and gender, or a list of either. A plain name has
    the gender '?'. Null gives null; what is none of these raises."""
    kind = F.substring(F.ltrim(json), 1, 1)
    fail = F.raise_error(F.concat(F.lit("no people: "), json)).cast(f"array<{PERSON}>")

    def one(text: Column) -> Column:
        made = F.from_json(text, "name STRING, gender STRING", {"mode": "PERMISSIVE"})
        plain = F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x")
        good = F.when(F.startswith(text, F.lit("{")) & made["name"].isNotNull() & made["gender"].isNotNull(), made).when(F.startswith(text, F.lit('"')), F.struct(plain.alias("name"), F.lit("?").alias("gender")))
        return F.coalesce(good, F.raise_error(F.concat(F.lit("no person: "), text)).cast(PERSON))

    # items of a list keep their JSON text where the list is read as texts; plain names lose their quotes
    items = F.from_json(json, "array<string>")
    listed = F.transform(items, lambda x: F.when(F.startswith(x, F.lit("{")), one(x)).otherwise(F.struct(x.alias("name"), F.lit("?").alias("gender"))))
    return F.when(json.isNull(), None).when((kind == '"') | (kind == "{"), F.array(one(F.trim(json)))).when((kind == "[") & items.isNotNull(), listed).otherwise(fail)
