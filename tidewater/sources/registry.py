"""What a line store holds, kept up to date as lines come: per generation and day its bytes, lines and span, and its marks.

Nothing that is stored is read again to know this. Each ingested batch adds a delta (`_registry/deltas/<source>-<batch>`), written before its
lines are appended; a batch that is run again writes the same delta. Rewritten days are counted anew, and only they: a new base replaces the
old one and the deltas it has taken in, and notes up to which batch of each source. Marks outlive the lines they came from.

A batch goes through these steps: its new lines are staged, the delta is written from what is staged, the lines are appended, the staged
lines go. Wherever it fails, running it again gives the same store and the same registry. One writer at a time, as for the store itself.
"""
from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.operators.ingest import new_lines

from .readers import stored_lines
from .scratch import children, delete, exists
from .sinks import append_lines, with_day

REGISTRY = ("host string, container_id string, name string, compose_project string, day date, bytes bigint, n_lines bigint, lo_ns bigint, hi_ns bigint, "
            "stdout_wm_ns bigint, stderr_wm_ns bigint")
APPLIED = "source string, batch bigint"
KEYS = ["host", "container_id", "day"]


def daily_facts(lines: DataFrame) -> DataFrame:
    """Of lines with their day: a row for each generation and day, by partial sums; nothing is sorted."""
    mark = lambda s: F.coalesce(F.max(F.when(F.col("stream") == s, F.col("ts_ns"))), F.lit(0))
    return lines.groupBy(*KEYS).agg(F.max("name").alias("name"), F.max("compose_project").alias("compose_project"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes"),
        F.count("*").alias("n_lines"), F.min("ts_ns").alias("lo_ns"), F.max("ts_ns").alias("hi_ns"), mark(0).alias("stdout_wm_ns"), mark(1).alias("stderr_wm_ns")).select(*_names())


def _names() -> list[str]:
    return [x.split()[0] for x in REGISTRY.split(", ")]


def _home(store: str) -> str:
    return f"{store}/_registry"


def _merged(rows: DataFrame) -> DataFrame:
    total = lambda c: F.sum(c).alias(c)
    most = lambda c: F.max(c).alias(c)
    return rows.groupBy(*KEYS).agg(most("name"), most("compose_project"), total("bytes"), total("n_lines"), F.min("lo_ns").alias("lo_ns"), most("hi_ns"),
        most("stdout_wm_ns"), most("stderr_wm_ns")).select(*_names())


def _base(spark: SparkSession, store: str) -> str | None:
    """The newest complete base; each is a folder of its own, so that a reader's listing stays valid while the next one is written."""
    numbers = [int(x.removeprefix("base-")) for x in children(spark, _home(store)) if x.startswith("base-") and exists(spark, f"{_home(store)}/{x}/applied/_SUCCESS")]
    return f"{_home(store)}/base-{max(numbers)}" if numbers else None


def _applied(spark: SparkSession, base: str | None) -> dict[str, int]:
    if base is None:
        return {}
    return {r.source: r.batch for r in spark.read.schema(APPLIED).parquet(f"{base}/applied").collect()}  # a row for each source


def _deltas(spark: SparkSession, store: str, applied: dict[str, int]) -> list[tuple[str, int]]:
    """(source, batch) of the complete deltas that the base hasn't taken in."""
    found = []
    for x in children(spark, f"{_home(store)}/deltas"):
        source, _, batch = x.rpartition("-")
        if int(batch) > applied.get(source, -1) and exists(spark, f"{_home(store)}/deltas/{x}/_SUCCESS"):
            found.append((source, int(batch)))
    return found


def registry(spark: SparkSession, store: str) -> DataFrame:
    """A row for each generation and day. A store without a registry is counted once."""
    base = _base(spark, store)
    if base is None and not _deltas(spark, store, {}):
        if not exists(spark, store):
            return spark.createDataFrame([], REGISTRY)
        rebase(spark, store, daily_facts(stored_lines(spark, store)))
        base = _base(spark, store)
    paths = [f"{_home(store)}/deltas/{s}-{b}" for s, b in _deltas(spark, store, _applied(spark, base))] + ([f"{base}/rows"] if base else [])
    return _merged(spark.read.schema(REGISTRY).parquet(*paths))


def rebase(spark: SparkSession, store: str, rows: DataFrame) -> None:
    """Replaces base and deltas. rows: all of the registry."""
    old = _base(spark, store)
    applied = _applied(spark, old)
    deltas = _deltas(spark, store, applied)
    for source, batch in deltas:
        applied[source] = max(batch, applied.get(source, -1))
    new = f"{_home(store)}/base-{int(old.rpartition('-')[2]) + 1 if old else 0}"
    rows.write.mode("overwrite").parquet(f"{new}/rows")
    spark.createDataFrame(list(applied.items()), APPLIED).coalesce(1).write.mode("overwrite").parquet(f"{new}/applied")
    for source, batch in deltas:
        delete(spark, f"{_home(store)}/deltas/{source}-{batch}")
    if old:
        delete(spark, old)


def days_rewritten(spark: SparkSession, store: str, days: list[date]) -> None:
    """Counts these days anew, after they were rewritten; marks stay."""
    known = registry(spark, store)
    of = F.col("day").isin(days) | F.col("day").isNull() if None in days else F.col("day").isin(days)
    zero = F.lit(0).cast("bigint")
    marks = known.filter(of).withColumns({"bytes": zero, "n_lines": zero, "lo_ns": F.lit(None).cast("bigint"), "hi_ns": F.lit(None).cast("bigint")})
    now = daily_facts(stored_lines(spark, store).filter(of))
    rebase(spark, store, _merged(known.filter(~F.coalesce(of, F.lit(False))).unionByName(marks).unionByName(now)))


def append_batch(spark: SparkSession, store: str, batch: DataFrame, source: str, number: int) -> None:
    """Appends the batch's lines that the store doesn't have, and counts them, once however often it is run."""
    delta, staged = f"{_home(store)}/deltas/{source}-{number}", f"{_home(store)}/staged/{source}-{number}"
    complete = exists(spark, f"{staged}/_SUCCESS")
    if not complete and (exists(spark, f"{delta}/_SUCCESS") or _applied(spark, _base(spark, store)).get(source, -1) >= number):
        return  # done before
    if exists(spark, store) and _base(spark, store) is None and not _deltas(spark, store, {}) and any(x.startswith("day=") for x in children(spark, store)):
        registry(spark, store)  # lines that were stored without a registry are counted first
    have = lambda: stored_lines(spark, store) if any(x.startswith("day=") for x in children(spark, store)) else batch.limit(0)
    if not complete:
        batch = batch.persist()
        new_lines(batch, have()).write.mode("overwrite").parquet(staged)
        batch.unpersist()
    lines = spark.read.schema(batch.schema).parquet(staged)
    daily_facts(with_day(lines)).coalesce(1).write.mode("overwrite").parquet(delta)
    append_lines(new_lines(lines, have()) if complete else lines, store)
    delete(spark, staged)


def line_facts(spark: SparkSession, store: str) -> DataFrame:
    """Per generation what operators.ingest.line_facts gives, without reading a line."""
    g = registry(spark, store).groupBy("host", "container_id")
    return g.agg(F.sum("bytes").alias("stored_bytes"), F.sum("n_lines").alias("n_lines"), F.max("stdout_wm_ns").alias("stdout_wm_ns"), F.max("stderr_wm_ns").alias("stderr_wm_ns"))
