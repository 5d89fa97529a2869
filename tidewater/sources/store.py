"""The line store as a folder of Parquet files by day: retention, purge, compaction and backfill rewrite or append to it.

A day is rewritten whole: what stays is written beside the store first, then takes the day's place by a dynamic partition overwrite,
and a day that is left empty goes. Other days aren't touched. One writer at a time may rewrite. A reader whose listing is older than a
rewrite fails with a missing file and has to list again. What the store holds is known from its registry (`sources.registry`), so
retention opens only the days that it cuts.
"""
from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidewater.operators import ingest, retention
from tidewater.operators.fold import KEY

from . import registry, skips
from .readers import stored_lines
from .scratch import children, delete, new_path
from .sinks import arranged


def _replace_days(spark: SparkSession, store: str, kept: DataFrame, days: list[date]) -> None:
    """kept: all that stays of these days."""
    beside = new_path(spark, "days")
    arranged(kept.filter(_of(days))).write.partitionBy("day").parquet(beside)
    staged = stored_lines(spark, beside)
    left = {r.day for r in staged.select("day").distinct().collect()}
    if left:
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(store)
    for day in set(days) - left:
        delete(spark, f"{store}/day={day or '__HIVE_DEFAULT_PARTITION__'}")
    delete(spark, beside)
    registry.days_rewritten(spark, store, days)


def _changed(lines: DataFrame, kept: DataFrame) -> list[date]:
    before, after = lines.groupBy("day").agg(F.count("*").alias("n")), kept.groupBy(F.col("day").alias("day_")).agg(F.count("*").alias("left"))
    return [r.day for r in before.join(after, F.col("day").eqNullSafe(F.col("day_")), "left").filter(~F.col("n").eqNullSafe(F.col("left"))).select("day").collect()]


def _days_over_cap(daily: DataFrame, each_bytes: int) -> list[date]:
    """Days that hold what containers have in excess, their oldest bytes. daily: the registry by logical container and day."""
    w = W.partitionBy(*KEY)
    over = F.sum("bytes").over(w) - each_bytes
    before = F.coalesce(F.sum("bytes").over(w.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a day
    return [r.day for r in daily.withColumns({"over_": over, "before_": before}).filter((F.col("over_") > F.col("before_")) & (F.col("bytes") > 0)).select("day").distinct().collect()]


def _days_over_total(daily: DataFrame, excess: int, chunk_rows: int) -> list[date]:
    """The oldest days that hold `excess` bytes, and what follows of the chunks that begin in them."""
    days = daily.groupBy("day").agg(F.sum("bytes").alias("b")).orderBy(F.col("day").asc_nulls_first()).collect()  # a row a day
    older, last = 0, None
    for r in days:
        older, last = older + r.b, r.day
        if older >= excess:
            break
    old = F.col("day").isNull() | (F.col("day") <= F.lit(last)) if last is not None else F.col("day").isNull()
    w = W.partitionBy(*KEY)
    ends = F.ceil(F.sum(F.when(old, F.col("n_lines")).otherwise(0)).over(w) / chunk_rows) * chunk_rows
    before = F.coalesce(F.sum("n_lines").over(w.orderBy(F.col("day").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return [r.day for r in daily.withColumns({"ends_": ends, "before_": before}).filter(old | (F.col("before_") < F.col("ends_"))).select("day").distinct().collect()]


def _trim_days(spark: SparkSession, store: str, days: list[date], kept) -> list[date]:
    """Rewrites those of the days that `kept` takes lines from."""
    if not days:
        return []
    lines = stored_lines(spark, store).filter(_of(days))
    staged = new_path(spark, "kept")
    kept(lines).write.parquet(staged)
    left = stored_lines(spark, staged)
    cut = _changed(lines, left)
    if cut:
        _replace_days(spark, store, left, cut)
    delete(spark, staged)
    return cut


def _of(days: list[date]) -> Column:
    some = F.col("day").isin([d for d in days if d is not None])
    return some | F.col("day").isNull() if None in days else some


def trim(spark: SparkSession, store: str, each_bytes: int, total_bytes: int, chunk_rows: int = retention.CHUNK_ROWS) -> int:
    """Evicts what is over the caps, oldest first; the number of days rewritten. Which days to open comes from the registry."""
    daily = lambda: registry.registry(spark, store).groupBy(*KEY, "day").agg(F.sum("bytes").alias("bytes"), F.sum("n_lines").alias("n_lines"))
    now = daily()
    over = now.groupBy(*KEY).agg((F.sum("bytes") - each_bytes).alias("excess_")).filter("excess_ > 0")
    first = _trim_days(spark, store, _days_over_cap(now, each_bytes), lambda lines: retention.trim_excess(lines, over))
    excess = (daily().agg(F.sum("bytes")).first()[0] or 0) - total_bytes
    second = []
    if excess > 0:
        second = _trim_days(spark, store, _days_over_total(daily(), excess, chunk_rows), lambda lines: retention.trim_total(lines, 0, chunk_rows, excess))
    return len({*first, *second})


def retain(spark: SparkSession, store: str, per_container_mb: int, total_mb: int) -> int:
    retention.check_limits(per_container_mb, total_mb)
    return trim(spark, store, per_container_mb * retention.MB, total_mb * retention.MB)


def purge(spark: SparkSession, store: str, host: str, name: str) -> int:
    """Deletes a logical container's lines; how many there were. An unknown one is an error."""
    gone = (F.col("host") == host) & (F.col("name") == name)
    lines = stored_lines(spark, store)
    found = lines.filter(gone).groupBy("day").agg(F.count("*").alias("n")).collect()  # a row a day
    if not found:
        raise LookupError(f"no stored container {host}/{name}")
    _replace_days(spark, store, lines.filter(~gone), [r.day for r in found])
    return sum(r.n for r in found)


def stored_days(spark: SparkSession, store: str) -> list[date]:
    """From the folder's names: no file is opened."""
    names = [x.removeprefix("day=") for x in children(spark, store) if x.startswith("day=")]
    return [None if x == "__HIVE_DEFAULT_PARTITION__" else date.fromisoformat(x) for x in names]


def compact(spark: SparkSession, store: str, days: list[date] | None = None) -> None:
    """Rewrites days whose many small files came from short triggers, and writes down what searches may skip them by."""
    lines = stored_lines(spark, store)
    days = days if days is not None else stored_days(spark, store)
    _replace_days(spark, store, lines, days)
    skips.write(spark, store, days)


def backfill(spark: SparkSession, store: str, fetched: DataFrame, generations: DataFrame, gaps: DataFrame) -> int:
    """Appends what was read again from each generation's resume point on and isn't stored yet; the number of lines."""
    since = ingest.resume_points(generations, gaps)
    again = fetched.join(since, ["host", "container_id"]).filter(F.col("ts_ns") >= F.col("since_ns")).select(*fetched.columns)
    before = registry.registry(spark, store).agg(F.sum("n_lines")).first()[0] or 0
    registry.append_batch(spark, store, again, f"backfill-{uuid.uuid4().hex[:12]}", 0)
    return registry.registry(spark, store).agg(F.sum("n_lines")).first()[0] - before


def resolvable(lines: DataFrame, generations: DataFrame) -> DataFrame:
    """Without lines whose generation isn't known."""
    return lines.join(generations.select("host", "container_id"), ["host", "container_id"], "left_semi")
