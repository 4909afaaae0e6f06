"""Texts as tables of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_lines(df: DataFrame, text: str, *keep: str | Column, keep_end: bool = True) -> DataFrame:
    """One row a line: the kept columns, line_no from 1, and line with its newline (all but the last).

    Carriage returns before a newline are dropped. A null text has no lines, an empty one a single empty
    line. No shuffle: rows stay where their text is.
    """
    flat = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    parts = df.select(*keep, F.split(flat, "\n", -1).alias("_parts"))
    names = parts.columns[:-1]
    out = parts.select(*names, F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_pos", "_line"))
    line = F.when(F.col("_pos") + 1 < F.col("_n"), F.concat("_line", F.lit("\n"))).otherwise(F.col("_line")) if keep_end else F.col("_line")
    return out.select(*names, (F.col("_pos") + 1).cast("bigint").alias("line_no"), line.alias("line"))


def join_lines(df: DataFrame, *keys: str) -> DataFrame:
    """The inverse of split_lines with keep_end: texts from their lines, in the order of line_no."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "").alias("text"))
