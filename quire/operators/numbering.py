"""Numbering, bucketing and neighbours within a parent. Windows are always partitioned by the parent, so no
step gathers a whole table; a parent's children are what one person lists by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(parent: list[str], order: list[str]):  # noqa: ANN202
    return Window.partitionBy(*parent).orderBy(*order)


def number(df: DataFrame, parent: list[str], order: list[str], start: int = 0, name: str = "number") -> DataFrame:
    """Consecutive numbers from start within each parent. Ties in order are numbered in no fixed order."""
    return df.withColumn(name, (F.row_number().over(_window(parent, order)) - 1 + start).cast("bigint"))


def split_mod(df: DataFrame, parent: list[str], order: list[str], count: int, first: int = 0, name: str = "bin") -> DataFrame:
    """Dealt out in turn to count bins, the first item to bin first."""
    if count < 1:
        raise ValueError("count has to be positive")
    return df.withColumn(name, F.pmod(F.row_number().over(_window(parent, order)) - 1 + first, F.lit(count)).cast("bigint"))


def split_div(df: DataFrame, parent: list[str], order: list[str], size: int, name: str = "batch") -> DataFrame:
    """Consecutive batches of size items, the last one may be short."""
    if size < 1:
        raise ValueError("size has to be positive")
    return df.withColumn(name, F.floor((F.row_number().over(_window(parent, order)) - 1) / size).cast("bigint"))


def split_by(df: DataFrame, parent: list[str], order: list[str], bin_of: Callable[[Column], Column], count: int, name: str = "bin") -> DataFrame:
    """The bin is a function of the item's index from 0; a bin beyond count raises, a negative one counts from the end."""
    at = bin_of((F.row_number().over(_window(parent, order)) - 1).cast("bigint"))
    wrapped = F.when(at < 0, at + count).otherwise(at)
    return df.withColumn(name, F.when((wrapped >= 0) & (wrapped < count), wrapped).otherwise(F.raise_error(F.concat(F.lit("no bin "), at.cast("string"))).cast("bigint")).cast("bigint"))


def all_bins(binned: DataFrame, parent: list[str], count: int, name: str = "bin") -> DataFrame:
    """How many items each bin of each parent has, empty bins included."""
    parents = binned.select(*parent).distinct()
    every = parents.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))))
    n = binned.groupBy(*parent, name).agg(F.count("*").alias("items"))
    return every.join(n, [*parent, name], "left").withColumn("items", F.coalesce("items", F.lit(0)))


def neighbours(df: DataFrame, parent: list[str], order: list[str], value: str) -> DataFrame:
    """The value before, whether it differs (null-safe; false for the first), and first and last flags."""
    w = _window(parent, order)
    d = df.withColumn("before", F.lag(value).over(w)).withColumn("is_first", F.lag(F.lit(1)).over(w).isNull()).withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())
    return d.withColumn("differs", ~F.col("is_first") & ~F.col("before").eqNullSafe(F.col(value)))


def padding(n: Column, multiple: int = 3) -> Column:
    """Items that are added to fill up: one if n is no multiple, else none."""
    return F.when(n % multiple == 0, 0).otherwise(1)


def number_by(df: DataFrame, parent: list[str], order: list[str], numbers: DataFrame, name: str = "number") -> DataFrame:
    """Numbers from any sequence: numbers has place (from 0) and number. An item beyond its end raises."""
    d = number(df, parent, order, 0, "_place").join(numbers.select(F.col("place").cast("bigint").alias("_place"), F.col("number").alias("_number")), "_place", "left")
    checked = F.coalesce(F.col("_number"), F.raise_error(F.concat(F.lit("no number for place "), F.col("_place").cast("string"))).cast("bigint"))
    return d.withColumn(name, checked).drop("_place", "_number")


def primes(count: int) -> list[int]:
    made: list[int] = []
    n = 2
    while len(made) < count:
        if all(n % p for p in made if p * p <= n):
            made.append(n)
        n += 1
    return made


def padded(df: DataFrame, parent: list[str], order: str, multiple: int = 3) -> DataFrame:
    """df with one more row (null but for the parent; column added) for each parent whose items are no multiple."""
    n = df.groupBy(*parent).agg(F.count("*").alias("_n")).where(padding(F.col("_n"), multiple) == 1).select(*parent, F.lit(True).alias("added"))
    return df.withColumn("added", F.lit(False)).unionByName(n, allowMissingColumns=True)
