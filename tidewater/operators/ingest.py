"""Ingestion: deduplicating insert, generation upsert, watermarks, resume points, removal marks."""
from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.format import whole

IDENTITY = ["host", "container_id", "ts_ns", "stream", "raw"]
OVERLAP_NS, DAY_NS = 2_000_000_000, 86_400_000_000_000
MOST_DAYS = 1000


def day_of(ns: int) -> date:
    return (datetime(1970, 1, 1) + timedelta(microseconds=ns // 1000)).date()


def on_days(lines: DataFrame, since_ns: int | None, until_ns: int | None) -> DataFrame:
    """Of lines that are stored by day, those of the days between two times; other lines as they are."""
    if "day" not in lines.columns:
        return lines
    if since_ns is not None:
        lines = lines.filter(F.col("day") >= F.lit(day_of(since_ns)))
    return lines.filter(F.col("day") <= F.lit(day_of(until_ns))) if until_ns is not None else lines


def new_lines(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Lines of the batch that are neither repeated in it nor stored already; late ones are as welcome as others."""
    span = batch.agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi")).first()
    if span and span.lo is not None:
        stored = on_days(stored, span.lo, span.hi).filter(F.col("ts_ns").between(span.lo, span.hi))  # reaches folders and statistics
        if "day" in stored.columns:  # a late line opens its own day, not all since
            days = [r.day for r in batch.select(F.date_from_unix_date(whole(F.col("ts_ns"), DAY_NS).cast("int")).alias("day")).distinct().limit(MOST_DAYS + 1).collect()]
            stored = stored.filter(F.col("day").isin(sorted(d for d in days if d is not None))) if len(days) <= MOST_DAYS else stored
    old = stored.select(*IDENTITY)
    return batch.dropDuplicates(IDENTITY).join(old, IDENTITY, "left_anti")


def line_facts(lines: DataFrame) -> DataFrame:
    """Per generation: bytes, lines, and the highest time of each stream (0: none)."""
    mark = lambda s: F.coalesce(F.max(F.when(F.col("stream") == s, F.col("ts_ns"))), F.lit(0))
    return lines.groupBy("host", "container_id").agg(F.sum(F.octet_length("raw")).alias("stored_bytes"), F.count("*").alias("n_lines"),
        mark(0).alias("stdout_wm_ns"), mark(1).alias("stderr_wm_ns"))


def upsert_generations(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """stored and seen: host, container_id, name, compose_project, image, seen_ms. An empty value never replaces one."""
    both = stored.withColumn("new_", F.lit(0)).unionByName(seen.withColumn("new_", F.lit(1)))
    latest = lambda c: F.coalesce(F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("new_", "seen_ms"))), F.lit("")).alias(c)
    return both.groupBy("host", "container_id").agg(latest("name"), latest("compose_project"), latest("image"),
        F.min("seen_ms").alias("first_seen_ms"), F.max("seen_ms").alias("last_seen_ms"))


def watermark(stdout: Column, stderr: Column) -> Column:
    """The lower of the marks that have advanced; 0 if none has."""
    return F.coalesce(F.least(F.nullif(stdout, F.lit(0)), F.nullif(stderr, F.lit(0))), F.lit(0))


def resume_points(generations: DataFrame, gaps: DataFrame) -> DataFrame:
    """since_ns per generation: watermark less the overlap, or creation; an older gap wins."""
    g = generations.join(gaps.select("host", "container_id", "gap_ns"), ["host", "container_id"], "left")
    wm = watermark(F.col("stdout_wm_ns"), F.col("stderr_wm_ns"))
    since = F.when(wm != 0, wm - OVERLAP_NS).otherwise(F.col("created_s").cast("bigint") * 1_000_000_000)
    return g.select("host", "container_id", F.least(since, F.nullif("gap_ns", F.lit(0)) - OVERLAP_NS).alias("since_ns"))


def earliest_gaps(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy("host", "container_id").agg(F.min("ts_ns").alias("gap_ns"))


def newly_removed(stored: DataFrame, listed: DataFrame, failed_hosts: DataFrame) -> DataFrame:
    """Live stored generations that their host no longer lists; hosts that failed to list are left out."""
    live = stored.filter("removed_ms IS NULL")
    return live.join(listed.select("host", "container_id"), ["host", "container_id"], "left_anti").join(failed_hosts.select("host"), "host", "left_anti")
