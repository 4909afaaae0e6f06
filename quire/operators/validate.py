"""Validation: constraints as columns, presence matrices, completeness, tree schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes of the languages that files are filed under.
LANGUAGES = ("cs", "de", "en", "es", "fa", "fr", "hu", "pl", "pt", "qq", "ru", "sk", "uk")


def all_of(*tests: Column) -> Column:
    """True if every test holds; a null test doesn't."""
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def any_of(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def matches(value: Column, pattern: str) -> Column:
    """Whole-string match; null doesn't match."""
    return F.coalesce(F.rlike(value, F.lit(f"^(?:{pattern})\\z")), F.lit(False))


def optional(value: Column, test: Column) -> Column:
    return value.isNull() | F.coalesce(test, F.lit(False))


def not_empty(value: Column) -> Column:
    return F.coalesce(F.length(value) > 0, F.lit(False))


def each(items: Column, test) -> Column:  # noqa: ANN001
    """Whether an array isn't null and the test holds for each item."""
    return items.isNotNull() & F.coalesce(F.forall(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row (key, rule) for each rule that a row breaks; one scan, no join."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, raising at the first row that breaks a rule."""
    test = F.lit(True)
    for name, ok in rules.items():
        test = test & F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"violated: {name}")).cast("boolean"))
    return df.where(test)


def presence_matrix(df: DataFrame, row: list[str], column: str, values: list[str]) -> DataFrame:
    """For each row key a 0/1 column for each of the given values. One aggregation with partial sums."""
    return df.groupBy(*row).agg(*[F.max(F.when(F.col(column) == v, 1).otherwise(0)).alias(v) for v in values])


def incomplete(matrix: DataFrame, values: list[str], optional_all: bool) -> DataFrame:
    """Rows that have some of the values but not all (or, unless optional_all, none)."""
    n = sum(F.col(f"`{v}`") for v in values)
    ok = (n == len(values)) | (F.lit(optional_all) & (n == 0))
    return matrix.withColumn("present", n.cast("bigint")).where(~ok)


def tree_check(files: DataFrame, node: list[str], name: str, required: list[str], optional_: list[str], forbidden: list[str]) -> DataFrame:
    """(node, problem, name): required names that a node misses, and names that are forbidden or unknown.

    Patterns match whole names. A node without any file isn't known here and can't be reported.
    """
    full = lambda p: F.rlike(F.col(name), F.lit(f"^(?:{p})\\z"))
    miss = F.array_compact(F.array(*[F.when(~F.bool_or(full(p)), F.lit(p)) for p in required]))
    missing = files.groupBy(*node).agg(miss.alias("_m")).select(*node, F.lit("missing").alias("problem"), F.explode("_m").alias("name"))
    known = any_of(*[full(p) for p in [*required, *optional_]])
    bad = F.when(any_of(*[full(p) for p in forbidden]), "forbidden").when(~known, "unexpected")
    odd = files.select(*node, bad.alias("problem"), F.col(name).alias("name")).where("problem is not null").distinct()
    return missing.unionByName(odd)


def literal(value: Column, *values: object) -> Column:
    """Whether the value is one of those given; null isn't."""
    return F.coalesce(value.isin(*values), F.lit(False))


def absent(value: Column) -> Column:
    """For fields that must not be there."""
    return value.isNull()


def use(value: Column, convert, test) -> Column:  # noqa: ANN001
    """Whether the value can be converted (convert gives null where not) and the result passes the test."""
    made = convert(value)
    return made.isNotNull() & F.coalesce(test(made), F.lit(False))


def entries(m: Column, key, value) -> Column:  # noqa: ANN001
    """Whether a map isn't null and each of its keys and values passes its test."""
    good = F.forall(F.map_entries(m), lambda e: F.coalesce(key(e["key"]) & value(e["value"]), F.lit(False)))
    return m.isNotNull() & F.coalesce(good, F.lit(False))


def union(*rules: dict[str, Column]) -> dict[str, Column]:
    """Rules of several schemas as one, the later rule of a name in place of the earlier."""
    out: dict[str, Column] = {}
    for r in rules:
        out |= r
    return out


@dataclass(frozen=True)
class Entry:
    """What a tree may or must hold: entries whose parent's path matches parent wholly, and whose name holds name."""

    parent: str
    name: str
    kinds: tuple[str, ...] = ("file",)
    required: bool = False
    forbidden: bool = False


_LANG = "^(" + "|".join(LANGUAGES) + ")$"
_FILE, _BOTH, _DIR = ("file",), ("file", "link"), ("dir",)
_HANDOUT = tuple(
    Entry(p, n, k, required=r)
    for p, n, k, r in (
        ("", r"[\w-]+\.(png|jpg|svg|gp|py|dat|tsv)", _BOTH, False), ("", r"[\w-]+", _DIR, False), ("", r"^text\.md$", _FILE, False), ("", r"^meta\.yaml$", _FILE, True),
        ("[^/]+", r"^problem\.md$", _FILE, False), ("[^/]+", r"^solution\.md$", _FILE, False), ("[^/]+", r"^meta\.yaml$", _FILE, False), ("[^/]+", r"[\w-]+\.(png|jpg|svg|gp|py|dat|tsv)", _BOTH, False), ("[^/]+", r"[\w-]+", _DIR, False),
        ("[^/]+/[^/]+", r"^problem\.md$", _FILE, False), ("[^/]+/[^/]+", r"^solution\.md$", _FILE, False), ("[^/]+/[^/]+", r"^meta\.yaml$", _FILE, True), ("[^/]+/[^/]+", r"[\w-]+\.(png|jpg|svg|gp|py|dat|tsv)", _BOTH, False),
    )
)
# The trees of a contest's volume, a seminar's round, a handout and a homework.
TREES: dict[str, tuple[Entry, ...]] = {
    "contest_volume": (
        Entry("", "^problems$", _DIR, True), Entry("", "^languages$", _DIR, True), Entry("", "^venues$", _DIR), Entry("", r"^meta\.yaml$", _FILE, True),
        Entry("problems", ".", _DIR, True), Entry("problems/[^/]+", _LANG, _DIR, True), Entry("problems/[^/]+", r"^answer\.md$", _FILE, True), *(Entry("problems/[^/]+", f"^{n}$") for n in (r"answer-also\.md", r"answer-interval\.md", r"meta\.yaml")),
        Entry("problems/[^/]+", r"\s", _FILE, forbidden=True), Entry("problems/[^/]+", r"[\w-]+\.(png|jpg|svg|gp|py|dat|tikz|tex|md)"),
        *(Entry("problems/[^/]+/[^/]+", f"^{n}$", _BOTH) for n in (r"problem\.md", r"problem-extra\.md", r"solution\.md", r"answer-extra\.md")),
        Entry("problems/[^/]+/[^/]+", r"[\w-]+\.(png|jpg|svg|gp|py|dat|tikz|tex)"), Entry("problems/[^/]+/[^/]+", r"\s", _FILE, forbidden=True),
        Entry("languages", _LANG, _DIR, True), Entry("languages/[^/]+", r"^meta\.yaml$", _FILE, True), Entry("languages/[^/]+", r"^intro\.jtex$", _BOTH, True), Entry("languages/[^/]+", r"^instructions-inner\.jtex$", _BOTH), Entry("languages/[^/]+", r"^evaluators\.jtex$", _BOTH), Entry("languages/[^/]+", "^online$", _DIR),
        *(Entry("languages/[^/]+/online", f"^{n}$", _BOTH, True) for n in (r"language\.png", r"signin\.png", r"welcome\.png", r"problems\.png", r"instructions-online-inner\.md")),
        Entry("venues", r"\w+", _DIR), Entry("venues/[^/]+", r"^meta\.yaml$", _FILE, True), Entry("venues/[^/]+", r"^instructions-inner\.tex$", _BOTH),
    ),
    "seminar_round": (
        Entry("", "0[1-8]", _DIR, True), Entry("", r"^meta\.yaml$", _FILE, True), *(Entry("[^/]+", f"^{n}$", _FILE, True) for n in (r"problem\.md", r"solution\.md", r"meta\.yaml")),
        Entry("[^/]+", r"[\w-]+\.(png|jpg|svg|gp|py|cpp|dat|pdf)"), Entry("[^/]+", r"\s", _FILE, forbidden=True),
    ),
    "handout": _HANDOUT,
    "homework": _HANDOUT,
}


def tree_violations(tree: DataFrame, root: list[str], schema: str | tuple[Entry, ...]) -> DataFrame:
    """(root, path, problem, name): what a tree (root, parent, name, kind) has that its schema doesn't allow (unexpected,
    forbidden), and what it misses (path is the folder, name the pattern). One scan and one aggregation by folder.

    A name is allowed if an entry's pattern is found in it; a forbidden pattern goes before. Null kinds are ignored.
    """
    rules = TREES[schema] if isinstance(schema, str) else schema
    here = lambda c, p: F.rlike(c, F.lit(f"^(?:{p})\\z"))
    t = tree.where("kind is not null").select(*root, "parent", "name", "kind")
    test = lambda r: here(F.col("parent"), r.parent) & F.rlike("name", F.lit(f"(?U){r.name}")) & F.col("kind").isin(*r.kinds)
    bad = F.when(any_of(*[test(r) for r in rules if r.forbidden]), "forbidden").when(~any_of(*[test(r) for r in rules if not r.forbidden]), "unexpected")
    odd = t.select(*root, F.col("parent").alias("path"), bad.alias("problem"), "name").where("problem is not null")
    # what each folder, the root included, has of what it must have
    path = F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws("/", "parent", "name"))
    folders = t.where("kind = 'dir'").select(*root, path.alias("path"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"))
    tops = t.select(*root, F.lit("").alias("path"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind")).distinct()
    must = [r for r in rules if r.required]
    both = folders.unionByName(tops).unionByName(t.select(*root, F.col("parent").alias("path"), "name", "kind"))
    has = both.groupBy(*root, "path").agg(*[F.coalesce(F.bool_or(F.rlike("name", F.lit(f"(?U){r.name}")) & F.col("kind").isin(*r.kinds)), F.lit(False)).alias(f"_{i}") for i, r in enumerate(must)])
    left = F.array_compact(F.array(*[F.when(here(F.col("path"), r.parent) & ~F.col(f"_{i}"), F.lit(r.name)) for i, r in enumerate(must)]))
    missing = has.select(*root, "path", F.lit("missing").alias("problem"), F.explode(left).alias("name"))
    return odd.unionByName(missing)
