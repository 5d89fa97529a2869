"""Byte-capped retention, oldest first. Bytes are those of the raw line in UTF-8; the unit is the logical container (host, name).

Running sums are taken over slices of time: no container's lines are sorted in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .fold import KEY
from .running import DAY_NS, running_sum

MB = 1 << 20
CHUNK_ROWS = 5000


def line_bytes(raw: str = "raw") -> Column:
    return F.coalesce(F.octet_length(raw), F.lit(0)).cast("bigint")


def group_bytes(lines: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return lines.groupBy(*keys).agg(F.sum(line_bytes()).alias("bytes"), F.count("*").alias("n_lines"), F.min("ts_ns").alias("oldest_ns"))


def evicted_by_cap(lines: DataFrame, cap: int | Column, keys: list[str] = KEY, slice_ns: int = DAY_NS) -> DataFrame:
    """Lines with `evict`: true where the bytes before the line are fewer than what its container has in excess of the cap."""
    d = running_sum(lines, keys, None, ["ts_ns", "rowid"], line_bytes(), "before_bytes_", "all_bytes_", slice_ns)
    return d.withColumn("evict", F.col("before_bytes_") < F.col("all_bytes_") - cap).drop("before_bytes_", "all_bytes_")


def trim_each(lines: DataFrame, cap: int, slice_ns: int = DAY_NS) -> DataFrame:
    return evicted_by_cap(lines, cap, slice_ns=slice_ns).filter(~F.col("evict")).drop("evict")


def trim_excess(lines: DataFrame, over: DataFrame) -> DataFrame:
    """Without the oldest lines of the containers in `over` (host, name, excess_: bytes to evict at least). Lines need only hold these."""
    d = running_sum(lines, KEY, None, ["ts_ns", "rowid"], line_bytes(), "before_bytes_")
    o = over.select(*[F.col(k).alias(f"{k}_") for k in KEY], "excess_")
    d = d.join(o, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in KEY], "left")
    return d.filter(F.coalesce(F.col("before_bytes_") >= F.col("excess_"), F.lit(True))).select(*lines.columns)


def trim_total(lines: DataFrame, cap: int, chunk_rows: int = CHUNK_ROWS, excess: int | None = None) -> DataFrame:
    """excess: how many bytes are to go, where lines are only the oldest of the store. While the whole is over the cap: the container with the oldest line loses its oldest lines, chunk by chunk.

    Every container's lines are cut into chunks of chunk_rows, oldest first. Chunks go in the order of their first times, so one
    ordered pass over the chunks replaces the loop; only the last chunk is cut by line.
    """
    d = running_sum(lines, KEY, None, ["ts_ns", "rowid"], F.lit(1), "row_")
    d = d.withColumns({"bytes_": line_bytes(), "chunk_": F.floor(F.col("row_") / chunk_rows)}).drop("row_")
    chunks = d.groupBy(*KEY, "chunk_").agg(F.sum("bytes_").alias("b_"), F.min("ts_ns").alias("t_"))
    chunks = running_sum(chunks, [], None, ["t_", *KEY, "chunk_"], F.col("b_"), "older_", "total_bytes_")
    chunks = chunks.withColumn("left_", (F.col("total_bytes_") - F.lit(cap) if excess is None else F.lit(excess)) - F.col("older_"))
    chunks = chunks.select(*[F.col(k).alias(f"{k}_") for k in KEY], F.col("chunk_").alias("chunk2_"), "left_")
    d = d.join(chunks, [F.col(k) == F.col(f"{k}_") for k in KEY] + [F.col("chunk_") == F.col("chunk2_")])
    within = W.partitionBy(*KEY, "chunk_").orderBy("ts_ns", "rowid").rowsBetween(W.unboundedPreceding, -1)
    return d.withColumn("sum_", F.coalesce(F.sum("bytes_").over(within), F.lit(0))).filter(F.col("sum_") >= F.col("left_")).select(*lines.columns)


def retain(lines: DataFrame, per_container_mb: int, total_mb: int) -> DataFrame:
    check_limits(per_container_mb, total_mb)
    return trim_total(trim_each(lines, per_container_mb * MB), total_mb * MB)


def check_limits(per_container_mb: int, total_mb: int) -> None:
    if not (1 <= per_container_mb <= 1_048_576 and 1 <= total_mb <= 1_048_576 and per_container_mb <= total_mb):
        raise ValueError("limits must be 1 to 1048576 MB, the container's no larger than the total")


def prune_empty(generations: DataFrame, lines: DataFrame) -> DataFrame:
    """Without removed generations that have no lines left."""
    empty = generations.filter("removed_ms IS NOT NULL").join(lines.select("host", "container_id").distinct(), ["host", "container_id"], "left_anti")
    return generations.join(empty.select("host", "container_id"), ["host", "container_id"], "left_anti")


def purge(lines: DataFrame, host: str, name: str) -> tuple[DataFrame, int]:
    """Lines without a logical container's, and how many went; an unknown one is an error."""
    gone = (F.col("host") == host) & (F.col("name") == name)
    n = lines.filter(gone).count()
    if not n:
        raise LookupError(f"no stored container {host}/{name}")
    return lines.filter(~gone), n
