"""Which generations to read again, as a table that is carried from sync to sync: one row a generation, so all of them are judged by joins.

A generation is read once. A read that fails is tried again, MOST_ATTEMPTS times in all; a permanent failure excludes it with its reason.
A new gap (lines that were dropped while ingesting) makes it eligible again with a fresh budget, whatever became of it before.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value.
MOST_ATTEMPTS = 3
STATE = "host string, container_id string, attempts int, done boolean, in_flight boolean, healing_ns bigint, excluded_reason string"
KEYS = ["host", "container_id"]


def schedule(state: DataFrame, listed: DataFrame, gaps: DataFrame) -> DataFrame:
    """The state of the listed generations, and `due`: whether to read now; a due one is in flight then. Generations that aren't listed keep
    their state. gaps: host, container_id, gap_ns, a row for each generation that has one."""
    new = listed.select(*KEYS).distinct()
    d = state.join(new.withColumn("listed_", F.lit(True)), KEYS, "full").join(gaps.select(*KEYS, "gap_ns"), KEYS, "left")
    fresh = F.coalesce("gap_ns", F.lit(0)) != 0
    fresh = fresh & (F.col("gap_ns") != F.coalesce("healing_ns", F.lit(0))) & F.col("listed_").isNotNull()
    d = d.select(*KEYS, "listed_", F.when(fresh, 0).otherwise(F.coalesce("attempts", F.lit(0))).alias("attempts"), (F.coalesce("done", F.lit(False)) & ~fresh).alias("done"),
        F.coalesce("in_flight", F.lit(False)).alias("in_flight"), F.when(fresh, F.col("gap_ns")).otherwise(F.coalesce("healing_ns", F.lit(0))).alias("healing_ns"), "excluded_reason")
    due = F.col("listed_").isNotNull() & F.col("excluded_reason").isNull() & ~F.col("in_flight") & ~F.col("done") & (F.col("attempts") < MOST_ATTEMPTS)
    return d.withColumn("due", due).withColumn("in_flight", F.col("in_flight") | F.col("due")).drop("listed_")


def finished(state: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """outcomes: host, container_id, error (null: read), permanent. The state after these reads, and the gaps they healed (host, container_id,
    gap_ns)."""
    d = state.drop("due").join(outcomes.select(*KEYS, "error", "permanent", F.lit(True).alias("ended_")), KEYS, "left")
    read = F.col("ended_").isNotNull() & F.col("error").isNull()
    failed = F.col("ended_").isNotNull() & F.col("error").isNotNull()
    healed = d.filter(read & (F.col("healing_ns") != 0)).select(*KEYS, F.col("healing_ns").alias("gap_ns"))
    after = d.select(*KEYS, F.when(read, 0).when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), (F.col("done") | read).alias("done"),
        (F.col("in_flight") & F.col("ended_").isNull()).alias("in_flight"), F.when(read, 0).otherwise(F.col("healing_ns")).cast("bigint").alias("healing_ns"),
        F.when(failed & F.coalesce("permanent", F.lit(False)), F.col("error")).otherwise(F.col("excluded_reason")).alias("excluded_reason"))
    return after, healed
