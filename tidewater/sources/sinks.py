"""Sinks: the line store, NDJSON and text exports."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.functions.format import utc_text
from tidewater.functions.parse import sample


def with_day(lines: DataFrame) -> DataFrame:
    return lines.withColumn("day", F.to_date(utc_text(F.col("ts_ns"), "yyyy-MM-dd")))


def arranged(lines: DataFrame) -> DataFrame:
    """By day and host, so that a query's name and time predicates prune files. A host's day of any size is split over tasks, and small ones
    share one: partitions are rebalanced to the session's advisory size by what they turn out to hold."""
    return lines.hint("rebalance", F.col("day"), F.col("host")).sortWithinPartitions("host", "day", "name", "ts_ns")


def append_lines(lines: DataFrame, path: str) -> None:
    arranged(with_day(lines)).write.mode("append").partitionBy("day").parquet(path)


def ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_text(entries: DataFrame, path: str) -> None:
    text_lines(entries).write.mode("overwrite").text(path)


def text_lines(entries: DataFrame) -> DataFrame:
    """`[ts] [LEVEL] message`."""
    at = F.coalesce(utc_text(F.col("ts_ns"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    return entries.select(F.concat(F.lit("["), at, F.lit("] ["), F.col("level"), F.lit("] "), sample(F.col("message"), F.col("raw"))).alias("value"))
