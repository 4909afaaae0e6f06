"""Hierarchies as tables: paths, children, ancestors, existence, and merging of key-value documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded(n: Column, width: int = 2) -> Column:
    """A number with leading zeros, never cut."""
    return F.format_string(f"%0{width}d", n.cast("bigint"))


def path_of(*levels: Column) -> Column:
    """Levels joined by /, up to the first missing one; null if the first is missing."""
    known = F.lit(True)
    parts = []
    for x in levels:
        known = known & x.isNotNull()
        parts.append(F.when(known, x))
    return F.when(levels[0].isNotNull(), F.concat_ws("/", *parts))


def segment(path: Column, n: int) -> Column:
    """The n-th segment (from 1, negative from the end), '' beyond the path."""
    return F.split_part(path, F.lit("/"), F.lit(n))


def parent_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def with_children(parents: DataFrame, children: DataFrame, on: list[str], order: list[str], fields: list[str], name: str = "children") -> DataFrame:
    """Each parent with the ordered array of its children's fields, empty if it has none."""
    item = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *fields])])
    got = children.groupBy(*on).agg(F.array_sort(F.collect_list(item)).alias("_kids"))
    got = got.select(*on, F.transform("_kids", lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias(name))
    d = parents.join(got, on, "left")
    empty = F.array().cast(d.schema[name].dataType)
    return d.withColumn(name, F.coalesce(F.col(name), empty))


def existence(left: DataFrame, right: DataFrame, on: list[str], name: str = "present") -> DataFrame:
    """left with a flag whether right has the key; right's repeats don't multiply rows."""
    keys = right.select(*on).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])).distinct().withColumn(name, F.lit(True))
    return left.join(keys, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps, the right one's values first; null maps count as empty."""
    kind = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, kind), F.coalesce(right, kind)
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))


def merge_deep(left: DataFrame, right: DataFrame, keys: list[str], path: str = "path", value: str = "value") -> DataFrame:
    """Documents as (keys, path, value) rows: right's leaves win; a leaf replaces a whole subtree and the
    other way round, as a value and a tree can't both stand at a path."""
    r = right.select(*keys, path, F.col(value).alias("_v"), F.lit(1).alias("_r"))
    tops = right.select(*keys, F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.array_join(F.slice(F.split(path, "/"), 1, i), "/")), lambda p: p != F.col(path))).alias(path)).distinct()
    kept = left.join(tops, [*keys, path], "left_anti")  # a leaf where right has a tree goes
    prefixes = kept.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.array_join(F.slice(F.split(path, "/"), 1, i), "/"))).alias("_p"))
    under = prefixes.join(right.select(*keys, F.col(path).alias("_p")), [*keys, "_p"], "left_semi").where(F.col("_p") != F.col(path)).select(*keys, path).distinct()
    kept = kept.join(under, [*keys, path], "left_anti")  # a tree where right has a leaf goes
    d = kept.select(*keys, path, value).join(r, [*keys, path], "full_outer")
    return d.select(*keys, path, F.when(F.col("_r") == 1, F.col("_v")).otherwise(F.col(value)).alias(value))


def print_tree(path: Column) -> Column:
    """A path's last segment, indented by four spaces a level."""
    depth = F.size(F.split(path, "/")) - 1
    return F.concat(F.repeat(F.lit("    "), depth), F.substring_index(path, "/", -1))


def adopt(data: Column, key: str, child: Column) -> Column:
    """A map of maps with a child's map under a key: put there, or merged on one level into what is there, the child's
    values first. Null maps count as empty."""
    d = F.coalesce(data, F.create_map().cast("map<string,map<string,string>>"))
    others = F.map_filter(d, lambda k, _: k != key)
    return F.map_concat(others, F.create_map(F.lit(key), merge_maps(d[key], child)))


def catalogue(leaves: DataFrame, defaults: str = "default") -> DataFrame:
    """Each two-letter document (file, path, value) merged deeply over the default one; documents of other names are
    none. A default leaf counts where the document has none at its path; a null value counts as one."""
    two = leaves.where(F.rlike("file", F.lit("^[a-z]{2}$")))
    base = leaves.where(F.col("file") == defaults).select("path", "value")
    # the defaults are one document: one row of its leaves, which every file is joined with by the document's name
    whole = base.groupBy(F.lit(defaults).alias("_of")).agg(F.collect_list(F.struct("path", "value")).alias("_b"))
    left = two.select("file").distinct().withColumn("_of", F.lit(defaults)).join(whole, "_of").select("file", F.explode("_b").alias("x")).select("file", "x.*")
    return merge_deep(left, two, ["file"])


def stale(edges: DataFrame, times: DataFrame) -> DataFrame:
    """Targets that have to be made again: not there yet, older than a source, or made from such a target, to the end.

    edges: target, source; times: node, at (null or absent: not there). Each round joins the targets found last with
    the edges once more; there are as many rounds as the longest chain is long. Cycles end.
    """
    from quire.runtime import cut, release

    at = times.groupBy("node").agg(F.max("at").alias("at"))
    e = edges.select("target", "source").distinct()
    t = e.join(at.withColumnRenamed("node", "target").withColumnRenamed("at", "_t"), "target", "left").join(at.withColumnRenamed("node", "source").withColumnRenamed("at", "_s"), "source", "left")
    found = cut(t.where("_t is null or _s > _t").select("target").distinct())
    new = found
    while new.take(1):
        more = e.join(new.select(F.col("target").alias("source")), "source", "left_semi").select("target").distinct().join(found, "target", "left_anti")
        new = cut(more)
        both = cut(found.union(new))
        release(found)
        found = both
    return found
