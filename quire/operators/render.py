"""Documents put together from ordered fragments, and templates as projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def assemble(fragments: DataFrame, keys: list[str], order: str, text: str, sep: str = "\n") -> DataFrame:
    """One text a document from its fragments in order; null fragments are left out, ties go by text."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return fragments.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[text]), sep).alias("text"))


def override(base: DataFrame, child: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Fragments by block name: a child's block takes the place of the base's, new ones are added."""
    c = child.select(*keys, F.col(text).alias("_t"), F.lit(1).alias("_c"))
    return base.join(c, keys, "full_outer").withColumn(text, F.when(F.col("_c") == 1, F.col("_t")).otherwise(F.col(text))).drop("_t", "_c")


def fill(template: str, values: dict[str, Column], passes: int = 1) -> Column:
    """A template's text with (* name *) replaced by columns. A name that isn't among values raises KeyError;
    a null value makes the text null. With two passes, values may hold names themselves."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\(\*\s*(\w+)\s*\*\)", template):
        parts += [F.lit(template[at : m.start()]), values[m[1]].cast("string")]
        at = m.end()
    out = F.concat(*parts, F.lit(template[at:])) if parts else F.lit(template)
    for _ in range(passes - 1):
        for name, value in values.items():  # (in any spacing; a value's own $ and \\ are no marks)
            quoted = F.regexp_replace(value.cast("string"), r"([\\$])", r"\\$1")
            out = F.regexp_replace(out, F.lit(rf"\(\*\s*{name}\s*\*\)"), quoted)
    return out


# What a template's suffix becomes.
SUFFIXES = {".jtex": ".tex", ".jyaml": ".yaml"}


def target_name(template: Column) -> Column:
    """The name of what a template renders to; another suffix raises."""
    out = None
    for old, new in SUFFIXES.items():
        value = F.concat(F.regexp_replace(template, f"{re.escape(old)}\\z", ""), F.lit(new))
        out = F.when(F.endswith(template, F.lit(old)), value) if out is None else out.when(F.endswith(template, F.lit(old)), value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown suffix of "), template)).cast("string"))


def write_documents(documents: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One folder a document (name=...), with its text in one file, below path. A document is one row; its file ends in
    one newline more than the text, but for one that the text ends in itself."""
    value = F.regexp_replace(text, r"\n\z", "").alias("value")
    documents.select(name, value).repartition(name).write.mode("overwrite").partitionBy(name).text(path)


def passed(value: Column, kind: Column) -> Column:
    """The gate for values of templates, given their JSON text and kind (string, number, object): texts and numbers pass
    as they are, an object has to be a constant (magnitude and unit), anything else raises."""
    constant = F.from_json(value, "magnitude DOUBLE, unit STRING")
    ok = F.when(kind.isin("string", "number"), value).when((kind == "object") & constant["magnitude"].isNotNull() & F.get_json_object(value, "$.unit").isNotNull(), value)
    return F.coalesce(ok, F.raise_error(F.concat(F.lit("unsupported value: "), F.coalesce(value, F.lit("null")))).cast("string"))
