"""The queries of the operators on training data, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import cut, table


def problem_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem.md rows with content (a file delivered twice is still there twice)."""
    return table(spark, sf_dir, "problem_files").where("filename = 'problem.md' and content is not null")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import confusables as C

    files = C.look_alike_pairs(cut(C.looks(problem_texts(spark, sf_dir), "content", ("file_id",))), "file_id")
    quotes = C.quote_pairs(table(spark, sf_dir, "locale_overrides"), table(spark, sf_dir, "locales"))
    kinds = [("file", files), ("quotes", quotes)]
    a, b = (d.select(F.lit(k).alias("record_kind"), F.col("id_a").cast("bigint").alias("id_a"), F.col("id_b").cast("bigint").alias("id_b")) for k, d in kinds)
    return a.unionByName(b)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import confusables as C

    return C.look_alike_classes(cut(C.looks(problem_texts(spark, sf_dir), "content", ("file_id",))), "file_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import encode as E

    return E.encode(table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import encode as E

    return E.token_counts(table(spark, sf_dir, "documents"), keys=("doc_id", "source"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import mixing as M

    return M.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import mixing as M

    return M.shares_report(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_classes, p6_ids, p7_mix, p7_shares)}

#: DuckDB twins, where SQL can express the result.
ORACLE: dict[str, str] = {}


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "volumes")
    lists = [v.select(F.explode(f"authors.{k}").alias("name")) for k in ("problems", "pictures", "editors")]
    lists += [v.select(F.col("authors.head").alias("name"))]
    lists += [table(spark, sf_dir, "languages").select(F.explode("translators").alias("name")), table(spark, sf_dir, "venues").select(F.explode("orgs").alias("name"))]
    d = lists[0]
    for x in lists[1:]:
        d = d.unionByName(x)
    return d


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import names as N

    return N.pairs_of(cut(N.entities(_names(spark, sf_dir))))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import names as N

    d = cut(N.entities(_names(spark, sf_dir)))
    return d.join(d.groupBy("entity").agg(F.min("name").alias("class_id"), (F.count("*") - 1).alias("n_links")), "entity").select("name", "class_id", "n_links")


QUERIES |= {f.__name__: f for f in (p5_found, p5_entities)}


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of problem_files with content (a file delivered twice is still there twice)."""
    return table(spark, sf_dir, "problem_files").where("content is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import garbled as G

    files = all_files(spark, sf_dir)
    return G.find(files, G.learn(files)).select(F.col("file_id").cast("bigint").alias("file_id"), "line_no").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import garbled as G

    files = all_files(spark, sf_dir)
    return G.find(files, G.learn(files), restore=True).dropDuplicates(["file_id", "line_no"])


QUERIES |= {f.__name__: f for f in (p4_found, p4_restored)}


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import language as L

    files = problem_texts(spark, sf_dir)
    return L.detect(files, L.train(files)).dropDuplicates(["file_id", "line_no"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p3_languages(spark, sf_dir).where("lang is not null and (line_no > 0 or not labelled)")
    return found.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("line_no").cast("bigint").alias("line_no"), "lang")


QUERIES |= {f.__name__: f for f in (p3_found, p3_languages)}


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import align as A

    return A.links(all_files(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = p1_links(spark, sf_dir).where("line_t is not null and line_o is not null")
    first = F.col("translation") < F.col("origin")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return d.select(pick("translation", "origin").alias("file_a"), pick("line_t", "line_o").alias("line_a"), pick("origin", "translation").alias("file_b"), pick("line_o", "line_t").alias("line_b"))


QUERIES |= {f.__name__: f for f in (p1_found, p1_links)}


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import reading as R

    return R.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "reading_level")


QUERIES |= {f.__name__: f for f in (p8_found, p8_levels)}
