"""Incremental lint: new files of a folder are linted once, as they come. An extension: batch operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.lines import split_lines
from quire.operators.lint import lint


def findings_of(stream: DataFrame, text: str, *keys: str) -> DataFrame:
    """The findings of a stream (or table) of texts; stateless, so it needs no watermark."""
    return lint(split_lines(stream, text, *keys))


def counts_by_window(stream: DataFrame, text: str, time: str, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """Findings by rule and window of event time; rows later than the watermark are left out by Spark."""
    d = stream.withWatermark(time, late) if stream.isStreaming else stream
    found = lint(split_lines(d, text, time))
    return found.groupBy(F.window(time, every), "rule_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "rule_id", "n")


def run_available(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, text: str, *keys: str) -> None:
    """Lint what has come to the parquet folder source since the last call, append to sink, and return."""
    stream = spark.readStream.schema(schema).parquet(source)
    q = findings_of(stream, text, *keys).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()
