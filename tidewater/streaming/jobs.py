"""Structured Streaming: ingestion with deduplication, live filters, and alert state."""
from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tidewater.functions.format import whole
from tidewater.operators.alerts import (LIFECYCLE_ACTIONS, OOM_DIE_S, RuleWindow, alert_rows, append_history, compiled, log_matches, log_reason,
    map_events)
from tidewater.operators.fold import parse
from tidewater.operators.live import DEFAULT_TAIL, keep, live_match, of_targets, tail
from tidewater.schemas import LOG_LINES
from tidewater.sources import registry, store
from tidewater.sources.readers import follow, listed, stored_lines
from tidewater.sources.scratch import written

IDLE_MS, MOST_COLLECT_S, LATENESS = 24 * 3600 * 1000, 15.0, "10 seconds"


def ingest(lines: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, caps_mb: tuple[int, int] | None = None, retain_every: int = 5):
    """Appends lines that the store doesn't have yet and keeps its registry. A batch that is run again after a failure adds and counts
    nothing twice. With caps (MB per container, MB in all), retention runs every `retain_every` batches; it asks the registry and opens only
    days that it cuts."""
    source = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        registry.append_batch(spark, path, batch, source, k)
        if caps_mb and (k + 1) % retain_every == 0:
            store.retain(spark, path, *caps_mb)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "250 milliseconds"})).start()


def hand_over(spark: SparkSession, path: str, wanted: list[tuple[str, str, str]], n: int = DEFAULT_TAIL) -> tuple[DataFrame, DataFrame]:
    """History and live of up to MOST_TARGETS targets, without a gap or a repeat: the last n stored lines of each, and a stream of the
    lines that are stored afterwards, late ones too. The seam is the state of the folder, not a time: history has the lines of the files
    that there are now, live those of the other files. Days that are rewritten meanwhile (retention, compaction) are other files, whose
    lines older than the history's come again."""
    files = listed(spark, path).select(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"))
    newest = files.agg(F.max("t")).first()[0]
    same = [r.f for r in files.filter(F.col("t") == F.lit(newest)).collect()] if newest is not None else []  # files of one instant
    at, name = F.col("_metadata.file_modification_time"), F.col("_metadata.file_path")
    there = (at < F.lit(newest)) | ((at == F.lit(newest)) & name.isin(same)) if newest is not None else F.lit(False)
    seen, _ = written(tail(of_targets(stored_lines(spark, path).filter(there), wanted), n, ["host", "container_id"], ["ts_ns", "rowid"]), "history")
    live = follow(spark, path, LOG_LINES + ", day date").filter(~there)
    here = reduce(Column.__or__, [(F.col("host") == host) & (F.col("container_id") == container) for host, container, _ in wanted])
    return seen, live.filter(here)


def lifecycle(raw: DataFrame) -> DataFrame:
    """The stream of container events that users follow."""
    return map_events(raw, LIFECYCLE_ACTIONS)


def collected(stream: DataFrame, path: str, seconds: float = 3.0) -> DataFrame:
    """What a stream brings within a time box (15 seconds at most)."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(processingTime="100 milliseconds").start()
    try:
        q.awaitTermination(min(seconds, MOST_COLLECT_S))
    finally:
        q.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def follow_parsed(lines: DataFrame, level: str = "", search: str = "") -> DataFrame:
    """A live stream's lines are parsed and filtered one by one; they are never folded."""
    return keep(parse(lines), live_match(level, search))


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then hands them on by time. What comes of them is the same for every order
    of arrival within the watermark's delay; rows that come later still are dropped, as Spark does with late rows."""

    order: list[str] = ["at_s"]

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", StructType([StructField("rows", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for d in rows:
            if len(d):
                self.held.appendValue((pickle.dumps({c: d[c].tolist() for c in self.columns}),))
                first = min(int(d["at_s"].min()), first) if first is not None else int(d["at_s"].min())
        if first is not None:
            self.handle.registerTimer(first * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts = [pd.DataFrame(pickle.loads(x[0]), columns=self.columns) for x in self.held.get()] if self.held.exists() else []
        if parts:
            d = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            due = d["at_s"] * 1000 <= now
            if due.any():
                later = d[~due]
                if len(later):
                    self.held.put([(pickle.dumps({c: later[c].tolist() for c in self.columns}),)])
                    self.handle.registerTimer(int(later["at_s"].min()) * 1000)
                else:
                    self.held.clear()
                yield self.due(key, d[due].sort_values(self.order, kind="stable"))
                return
        self.idle(now, bool(parts))

    def due(self, key, d: pd.DataFrame) -> pd.DataFrame:
        """Rows by time; called once for each row."""
        raise NotImplementedError

    def idle(self, now_ms: int, holding: bool) -> None:
        """A timer without rows that are due."""

    def close(self) -> None:
        pass


class AlertState(InOrder):
    """One rule and container. The key holds a hash of the rule, so a changed rule starts anew; state that is idle for a day goes."""

    order = ["at_s", "match_id"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("window", StructType([StructField("times", ArrayType(LongType())), StructField("last", LongType()),
            StructField("swallowed", LongType()), StructField("seen", LongType())]))

    def due(self, key, d: pd.DataFrame) -> pd.DataFrame:
        times, last, swallowed, _ = self.state.get() if self.state.exists() else ([], None, 0, 0)
        w = RuleWindow(int(d.threshold.iloc[0]), int(d.window_s.iloc[0]), int(d.cooldown_s.iloc[0]), times, last, swallowed)
        said = [w.match(int(at)) for at in d.at_s]
        seen = int(d.at_s.iloc[-1])
        self.state.update((list(w.times), w.last, w.swallowed, seen))
        self.handle.registerTimer(seen * 1000 + IDLE_MS)
        fired = [x is not None for x in said]
        return d[fired].assign(suppressed=pd.array([x for x in said if x is not None], dtype="int32"))

    def idle(self, now_ms: int, holding: bool) -> None:
        if not holding and self.state.exists() and self.state.get()[3] * 1000 + IDLE_MS <= now_ms:
            self.state.clear()


def _watermarked(df: DataFrame, lateness: str) -> DataFrame:
    return df.withColumn("event_time_", F.timestamp_seconds("at_s")).withWatermark("event_time_", lateness)


def fire(matches: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Streaming form of operators.alerts.fire, over event time: the matches that fire, with all their columns and `suppressed`. An alert comes
    when the watermark, `lateness` behind the newest match, has passed it. A rule that is changed in any of its parts starts with new state,
    others keep theirs. Needs the RocksDB state store."""
    version = F.col("rule_version") if "rule_version" in matches.columns else F.xxhash64("threshold", "window_s", "cooldown_s")
    m = _watermarked(matches.withColumn("state_key_", F.concat_ws("#", "key", version)), lateness)
    schema = StructType([*matches.schema.fields, StructField("suppressed", IntegerType())])
    return m.groupBy("state_key_").transformWithStateInPandas(AlertState(matches.columns), schema, "Append", "EventTime")


class OomState(InOrder):
    """Ooms of a container's last OOM_DIE_S seconds; each event takes the newest of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ooms = handle.getListState("ooms", StructType([StructField("at_s", LongType())]))

    def due(self, key, d: pd.DataFrame) -> pd.DataFrame:
        at = d["at_s"].to_numpy("int64")
        before = [x[0] for x in self.ooms.get()] if self.ooms.exists() else []
        ooms = np.unique(np.array([*before, *at[(d["what"] == "oom").to_numpy()]], "int64"))
        k = np.searchsorted(ooms, at, side="right") - 1
        last = np.where(k >= 0, ooms[np.maximum(k, 0)], at - OOM_DIE_S - 1) if len(ooms) else at - OOM_DIE_S - 1
        recent = ooms[ooms >= at[-1] - OOM_DIE_S].tolist()
        if recent:
            self.ooms.put([(x,) for x in recent])
            self.handle.registerTimer((recent[-1] + OOM_DIE_S + 1) * 1000)
        elif self.ooms.exists():
            self.ooms.clear()
        return d.assign(last_oom=pd.Series(last, index=d.index, dtype="Int64").mask(at - last > OOM_DIE_S))

    def idle(self, now_ms: int, holding: bool) -> None:
        if not holding and self.ooms.exists() and (max(x[0] for x in self.ooms.get()) + OOM_DIE_S) * 1000 < now_ms:
            self.ooms.clear()


def with_last_oom(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Streaming form of operators.alerts.with_last_oom, over event time: events come when the watermark has passed them."""
    schema = StructType([*events.schema.fields, StructField("last_oom", LongType())])
    return _watermarked(events, lateness).groupBy("host", "container_id").transformWithStateInPandas(OomState(events.columns), schema, "Append", "EventTime")


def match_stream(lines: DataFrame, rules: Callable[[], DataFrame], path: str, checkpoint: str, trigger: dict | None = None):
    """Matches of a stream of lines with the rules as they are at each micro-batch, as a folder for `alert_stream`. Lines: parsed, with
    container_name, labels, match_id and at_s. A batch that is run again replaces what it wrote."""
    def write(batch: DataFrame, k: int) -> None:
        log_matches(rules(), batch).write.mode("overwrite").parquet(f"{path}/batch={k}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def alert_stream(spark: SparkSession, matches: str, schema: str | StructType, rules: Callable[[], DataFrame], path: str, checkpoint: str,
                 trigger: dict | None = None, lateness: str = LATENESS):
    """Alerts of the matches' folder, as a history. Unchanged rules keep their state; an alert of a rule that has been changed, disabled or
    deleted since its match is dropped."""
    fired = fire(spark.readStream.schema(schema).parquet(matches), lateness)

    def write(batch: DataFrame, k: int) -> None:
        now = [r.rule_version for r in compiled(rules(), "log").select("rule_version").collect()]  # MOST_RULES at most
        reason = log_reason(F.col("threshold"), F.col("min_level"), F.col("pattern"), F.col("window_s"))
        append_history(alert_rows(batch.filter(F.col("rule_version").isin(now)), reason), path, k)

    return fired.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def line_counts(parsed: DataFrame, lateness: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Lines per container, level and window of event time."""
    d = parsed.withColumn("at", F.timestamp_micros(whole(F.col("ts_ns"), 1000)))
    return d.withWatermark("at", lateness).groupBy(F.window("at", width), "host", "name", "level").agg(F.count("*").alias("n"))
