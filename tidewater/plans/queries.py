"""The registered queries of the log engine, and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import format as fmt, parse as p
from tidewater.operators import alerts, fold as fold_, ingest, inventory, limits, live, retention, subscriptions as subscriptions_
from tidewater.plans.history import HistoryQuery, page, stored_containers
from tidewater.sources import adapters as a, frames as frames_, readers, registry, scratch, skips, store
from tidewater.sources.adapters import LINES_SQL as L, table
from tidewater.sources.readers import stored_lines
from tidewater.sources.sinks import append_lines, ndjson

SINCE, UNTIL = 1704672000000000000, 1705881600000000000  # 2024-01-08 and 2024-01-22
SCALE = 100_000
MIDDLE = 1705276800000000000  # 2024-01-15: the scenarios below take what is older as stored already


def _parsed(spark, d):
    return fold_.parse(a.log_lines(spark, d))


def parse_levels(spark, d):
    return _parsed(spark, d).groupBy("host", "name", "level").agg(F.count("*").alias("n"), F.sum(F.col("severity").cast("int")).alias("sum_severity"))


def parse_timestamps(spark, d):
    return p.with_timestamp(a.log_lines(spark, d)).select("rowid", "parsed_ns", "rest")


def folded_entries(spark, d):
    e = fold_.folded(a.log_lines(spark, d))
    return e.select("host", "name", "rowid", "ts_ns", "level", "message", "continuation_count", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("keys"))


def history_page(spark, d):
    q = HistoryQuery("svc-1", since_ns=SINCE, until_ns=UNTIL, levels=["error", "PANIC"], limit=200)
    return page(a.log_lines(spark, d), q).select("ts_ns", "rowid", "host", "container_id", "level", "message", "continuation_count")


def history_substring(spark, d):
    return page(a.log_lines(spark, d), HistoryQuery("svc-2", host="h1", search="ALICE", limit=1000)).select("ts_ns", "rowid", "level", "message")


def history_regex(spark, d):
    return page(a.log_lines(spark, d), HistoryQuery("svc-3", host="h0", search="slow|boom$", regex=True, limit=1000)).select("ts_ns", "rowid", "level", "message")


def history_containers(spark, d):
    return stored_containers(a.log_lines(spark, d), a.generations(spark, d))


def tail_per_container(spark, d):
    return live.tail(a.log_lines(spark, d), 10, ["host", "name"], ["ts_ns", "rowid"]).select("host", "name", "rowid", "raw")


def live_search(spark, d):
    return live.keep(_parsed(spark, d).filter(live.streams(stdout=True, stderr=False)), live.live_match("error", "failed|boom")).select("rowid", "level", "message")


def excluded_matches(spark, d):
    return live.keep(_parsed(spark, d), live.exclude("slow|alice")).groupBy("level").agg(F.count("*").alias("n"))


def grep(spark, d):
    lines = live.tail(a.log_lines(spark, d), 1000, ["host", "container_id"], ["ts_ns", "rowid"])
    return live.keep(fold_.parse(lines), F.col("message").rlike("boom|trouble|order")).select("host", "container_id", "rowid", "ts_ns", "level", "message")


def merged_targets(spark, d):
    lines = live.of_targets(a.log_lines(spark, d), live.targets("h0~svc-1-g0~one,h1~svc-1-g1~two,h2~svc-4-g0~three"))
    lines = lines.withColumnRenamed("rowid", "ord")
    return live.merge_targets(lines).select("target_idx", "target_name", "ord", "ts_ns")


def match_positions(spark, d):
    m = live.match_positions(_parsed(spark, d), "o[a-z]+", ["ts_ns", "rowid"], ["host", "name"])
    return m.select("host", "name", "position", F.array_join("spans", "|").alias("spans"))


def raw_ranges(spark, d):
    e = fold_.folded(a.log_lines(spark, d)).select("host", "name", "ts_ns", "rowid", "continuation_count")
    e = live.raw_ranges(e, ["host", "name"], ["ts_ns", "rowid"])
    return e.select("host", "name", "rowid", "raw_first", "raw_last")


def retention_each(spark, d):
    return retention.evicted_by_cap(a.log_lines(spark, d), 20_000).select("host", "name", "rowid", "evict")


def retention_total(spark, d):
    return retention.trim_total(a.log_lines(spark, d), 300_000, chunk_rows=50).groupBy("host", "name").agg(F.count("*").alias("n"), F.min("rowid").alias("first_row"))


def retention_groups(spark, d):
    return retention.group_bytes(a.log_lines(spark, d))


def purge_container(spark, d):
    left, n = retention.purge(a.log_lines(spark, d), "h0", "svc-1")
    return left.groupBy("host", "name").agg(F.count("*").alias("n")).withColumn("purged", F.lit(n).cast("long"))


def ingest_dedup(spark, d):
    """All lines come twice; the older half is stored already."""
    lines = a.log_lines(spark, d)
    return ingest.new_lines(lines.unionByName(lines), lines.filter(F.col("ts_ns") < MIDDLE)).select("host", "container_id", "rowid")


def ingest_marks(spark, d):
    return ingest.line_facts(a.log_lines(spark, d))


def resume_points(spark, d):
    g = ingest.line_facts(a.log_lines(spark, d)).withColumn("created_s", F.lit(1_700_000_000))
    gaps = ingest.earliest_gaps(a.log_lines(spark, d).filter("stream = 1 AND host <> 'h0'"))  # what a host failed to take in
    return ingest.resume_points(g, gaps)


def newly_removed(spark, d):
    g = a.generations(spark, d)
    listed = g.filter("name <> 'svc-2'").select("host", "container_id")
    return ingest.newly_removed(g, listed, g.select("host").filter("host = 'h2'").distinct()).select("host", "container_id")


def prune_empty(spark, d):
    return retention.prune_empty(a.generations(spark, d), a.log_lines(spark, d).filter("name <> 'svc-3'")).select("host", "container_id")


def stack_summary(spark, d):
    return inventory.stacks(a.containers(spark, d)).withColumn("hosts", F.array_join("hosts", ","))


def container_states(spark, d):
    return inventory.state_counts(a.containers(spark, d))


def projects_standalone(spark, d):
    return inventory.by_project(a.containers(spark, d))


def dashboard(spark, d):
    return a.containers(spark, d).filter(inventory.dashboard(search="C1", host="h1", created_from=10)).select("created", "state", "host")


def resolve_name(spark, d):
    return inventory.resolve(a.containers(spark, d), "c7").select("created", "host")


def cpu_deltas(spark, d):
    return inventory.cpu_between_polls(a.cpu_samples(spark, d), most_age_s=10**9, slice_width=86_400 * SCALE).select("event_id", F.round("cpu_percent", 6).alias("cpu_percent"))


def percentiles(spark, d):
    return inventory.nearest_rank(table(spark, d, "events"), "value", ["event_type"])


def alert_log_matches(spark, d):
    r = _parsed(spark, d).withColumns({"container_name": F.col("name"), "labels": F.create_map(F.lit("com.docker.compose.project"), F.col("compose_project"))})
    return alerts.log_matches(a.rules(spark), r).groupBy("rule_id", "host", "container_name").agg(F.count("*").alias("n"), F.min("rowid").alias("first_row"))


def alert_fired(spark, d):
    """Alerts of the state machine, whose SQL goes step by step through each key's matches."""
    r = _parsed(spark, d).withColumns({"container_name": F.col("name"), "labels": F.create_map(F.lit("com.docker.compose.project"), F.col("compose_project"))})
    number = F.substring("rule_id", 2, 1).cast("bigint")
    m = alerts.log_matches(a.rules(spark), r).withColumns({"match_id": F.col("rowid") * 10 + number, "at_s": fmt.whole(F.col("ts_ns"), 1_000_000_000)})
    m, _ = scratch.written(m.drop("raw", "message", "labels"), "log_matches")  # firing reads them, and the alerts do: lines are parsed once
    reason = alerts.log_reason(F.col("threshold"), F.col("min_level"), F.col("pattern"), F.col("window_s"))
    return alerts.alerts(m, alerts.fire(m), reason)


def alert_window(spark, d):
    """Three events of one kind and user within four days; event_id makes times distinct."""
    m = table(spark, d, "events").select(
        F.concat_ws("|", "user_id", "event_type").alias("key"), (F.floor(a.epoch_us() / 1_000_000) * SCALE + F.col("event_id")).alias("at_s"),
        F.lit(3).alias("threshold"), F.lit(4 * 86_400 * SCALE).alias("window_s"), F.col("event_id").alias("match_id"), "event_id")
    return alerts.count_in_window(m, slice_s=86_400 * SCALE).select("event_id", "trips")


def oom_pairs(spark, d):
    """Deaths and ooms of a user's container; a death within ten seconds after an oom has its time."""
    e = table(spark, d, "events")
    e = e.select("event_id", F.col("user_id").cast("string").alias("container_id"),
        F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"),
        F.when(F.col("event_type") == "error", "oom").otherwise("die").alias("what"), F.floor(F.col("event_id") / 3).alias("at_s"))
    e = e.withColumn("container_id", F.col("host"))
    return alerts.with_last_oom(e).select("event_id", "last_oom")


def lifecycle_events(spark, d):
    e = alerts.map_events(a.engine_events(spark, d), alerts.LIFECYCLE_ACTIONS)
    return e.groupBy("host", "action", "exit_code", "health_status").agg(F.count("*").alias("n"))


def level_values(spark, d):
    return inventory.distinct_values(_parsed(spark, d), "level")


def scalar_formats(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id") * F.col("event_id") * 37
    return e.select("event_id", fmt.human_bytes(n).alias("bytes"), fmt.human_age(F.col("event_id") * 61).alias("age"),
        fmt.memory_bytes(F.concat((F.col("event_id") % 512).cast("string"), F.lit("m"))).alias("memory"),
        fmt.duration_seconds(F.concat((F.col("event_id") % 90).cast("string"), F.lit("m"))).alias("seconds"),
        fmt.exact_bytes(F.col("event_id") * 1024).alias("exact"))


def conversation_levels(spark, d):
    """Levels of free text, line by line."""
    c = live.split_lines(table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("value")))
    return c.withColumn("level", p.detect_level(F.col("raw"))).groupBy("level").agg(F.count("*").alias("n"))


def events_alertable(spark, d):
    e = alerts.alertable(alerts.map_events(a.engine_events(spark, d)), a.inspected(spark, d))
    return e.groupBy("host", "what", "exit_code").agg(F.count("*").alias("n"))


def recent_samples(spark, d):
    return inventory.recent_samples(a.cpu_samples(spark, d).withColumn("at_s", F.floor(F.col("event_id") / 50)), 5).groupBy("host", "id").agg(F.count("*").alias("n"))


def sparkline(spark, d):
    s = inventory.sparkline(table(spark, d, "events").select("event_id", F.col("user_id").alias("host"), F.col("event_type").alias("id"), "value"), "value")
    return s.select("event_id", F.round("level", 6).alias("level"))


def counter_rates(spark, d):
    r = inventory.rates(table(spark, d, "events").withColumn("at", F.col("event_id") * 2), "value", "at", ["event_type"])
    return r.select("event_id", "rate")


def dropped_by_ring(spark, d):
    r = live.newest_with_dropped(a.log_lines(spark, d), ["host", "name"], ["ts_ns", "rowid"], 100)
    return r.groupBy("host", "name").agg(F.count("*").alias("n"), F.max("dropped").alias("dropped"))


def upserted_generations(spark, d):
    """What was seen before the middle is stored; lines of stderr name no container."""
    g = a.log_lines(spark, d).select("host", "container_id", F.when(F.col("stream") == 0, F.col("name")).otherwise("").alias("name"),
        F.lit("").alias("compose_project"), F.concat(F.lit("img"), (F.col("rowid") % 7).cast("string")).alias("image"),
        F.col("rowid").alias("seen_ms"), "ts_ns")
    old, new = g.filter(F.col("ts_ns") < MIDDLE).drop("ts_ns"), g.filter(F.col("ts_ns") >= MIDDLE).drop("ts_ns")
    return ingest.upsert_generations(old, new)


def removed_containers(spark, d):
    s = stored_containers(a.log_lines(spark, d), a.generations(spark, d)).withColumn("removed", F.col("name") != "svc-1")
    live_ = spark.createDataFrame([("h0", ["/svc-0"])], "host string, names array<string>")
    return inventory.removed_rows(s, live_).select("id", "host", "state", "image", "stored_bytes")


def exported_text(spark, d):
    from tidewater.sources.sinks import text_lines

    return text_lines(_parsed(spark, d))


def dashboard_page(spark, d):
    c = a.containers(spark, d).filter(inventory.dashboard(state="running")).orderBy(F.desc("created"))
    rows, lo, hi, total = inventory.offset_page(c, 2, 10)
    return rows.select("created", F.lit(lo).alias("first"), F.lit(hi).alias("last"), F.lit(total).alias("total"))


def _stored(spark, d):
    path = scratch.new_path(spark, "store")
    append_lines(a.log_lines(spark, d), path)
    return path


def _counted(spark, path):
    return stored_lines(spark, path).groupBy("host", "name").agg(F.count("*").alias("n"), F.min("rowid").alias("first_row"), F.max("rowid").alias("last_row"))


def stored_retention(spark, d):
    """A store's folder after its caps were applied: 20,000 bytes a container, 200,000 in all."""
    path = _stored(spark, d)
    store.trim(spark, path, 20_000, 200_000)
    return _counted(spark, path)


def stored_purge(spark, d):
    path = _stored(spark, d)
    n = store.purge(spark, path, "h0", "svc-1")
    return _counted(spark, path).withColumn("purged", F.lit(n).cast("long"))


def stored_backfill(spark, d):
    """The store has the older half; all is read again from where each generation resumes."""
    lines, path = a.log_lines(spark, d), scratch.new_path(spark, "store")
    half = lines.filter(F.col("ts_ns") < MIDDLE)
    append_lines(half, path)
    known = ingest.line_facts(lines).select("host", "container_id").join(ingest.line_facts(half), ["host", "container_id"],
        "left").fillna(0).withColumn("created_s", F.lit(1_700_000_000))
    store.backfill(spark, path, lines, known, ingest.earliest_gaps(half.limit(0)))
    return _counted(spark, path)


def history_stored(spark, d):
    """A page of a stored folder, from its newest days on."""
    path = _stored(spark, d)
    store.compact(spark, path)
    return page(stored_lines(spark, path), HistoryQuery("svc-1", until_ns=UNTIL, levels=["error"], limit=50)).select("ts_ns", "rowid", "host",
        "level", "message", "continuation_count")


def history_skipped(spark, d):
    """A text search over a stored folder that opens only days whose messages may hold the text."""
    path = _stored(spark, d)
    skips.write(spark, path)
    q = HistoryQuery("svc-2", search=r"main\.go:\d+ \+0x", regex=True, limit=1000)
    return page(stored_lines(spark, path), q).select("ts_ns", "rowid", "host", "level", "message", "continuation_count")


def _log_records(spark, d):
    return _parsed(spark, d).withColumns({"container_name": F.col("name"), "labels": F.create_map(F.lit("com.docker.compose.project"), F.col("compose_project"))})


def alert_patterns(spark, d):
    """Rules in RE2's own syntax; the invalid one stops no other."""
    r = alerts.log_matches(a.pattern_rules(spark), _log_records(spark, d))
    return r.groupBy("rule_id", "host").agg(F.count("*").alias("n"), F.min("rowid").alias("first_row"))


def alert_fired_noisy(spark, d):
    """alert_fired, where every key of over 25 matches is a noisy one."""
    number = F.substring("rule_id", 2, 1).cast("bigint")
    m = alerts.log_matches(a.rules(spark), _log_records(spark, d)).withColumns({"match_id": F.col("rowid") * 10 + number, "at_s": fmt.whole(F.col("ts_ns"), 1_000_000_000)})
    return alerts.fire(m, chunk=25).select("key", "at_s", "suppressed")


def rate_limited(spark, d):
    """Users may do two things a day, the day beginning with the first thing after the last one ended."""
    hits = table(spark, d, "events").select(F.col("user_id").alias("key"), F.floor(a.epoch_us() / 1_000_000).alias("at"), F.col("event_id").alias("hit_id"))
    return limits.fixed_windows(hits, 2, 86_400, chunk=40).select("hit_id", "window_start", "hit_no", "allowed")


def subscriptions(spark, d):
    """Every customer subscribes to lines by host, name or project."""
    k = F.col("c_custkey")
    one = lambda on, text: F.when(on, F.array(text)).otherwise(F.array().cast("array<string>"))
    specs = table(spark, d, "customer").select(k.alias("spec_id"), one(k % 2 == 0, F.concat(F.lit("h"), (k % 3).cast("string"))).alias("hosts"),
        one(k % 5 < 3, F.concat(F.lit("svc-"), (k % 5).cast("string"))).alias("containers"), one(k % 4 == 1, F.concat(F.lit("p"), (k % 2).cast("string"))).alias("projects"))
    lines = a.log_lines(spark, d).select("host", F.col("name").alias("container_name"), F.create_map(F.lit("com.docker.compose.project"), F.col("compose_project")).alias("labels"), "rowid")
    return subscriptions_.tallies(lines, specs, "rowid").withColumnRenamed("first", "first_row")


def registry_facts(spark, d):
    """What the registry says after three batches that overlap, each run twice; no line is read for it."""
    lines, path = a.log_lines(spark, d), scratch.new_path(spark, "store")
    for k, (lo, hi) in enumerate(((None, SINCE), (SINCE - 1, UNTIL), (MIDDLE, None))):
        batch = lines.filter((F.lit(lo is None) | (F.col("ts_ns") > F.lit(lo))) & (F.lit(hi is None) | (F.col("ts_ns") <= F.lit(hi))))
        for _ in range(2):
            registry.append_batch(spark, path, batch, "query", k)
    return registry.line_facts(spark, path)


def hosts_listed(spark, d):
    """Containers of the hosts that answered, and the error of the one that did not."""
    c = a.containers(spark, d)
    rows, errors = inventory.all_hosts([("h0", c.filter("host = 'h0'").drop("host"), ""), ("h1", c.filter("host = 'h1'").drop("host"), ""), ("h2", None, "timeout")])
    return rows.groupBy("host").agg(F.count("*").alias("n")).withColumn("error", F.lit(None).cast("string")).unionByName(
        spark.createDataFrame([(h, None, e) for h, e in errors], "host string, n bigint, error string"))


def hosts_info(spark, d):
    n = table(spark, d, "nation")
    hosts = n.select(F.col("n_name").alias("host"), F.col("n_nationkey").alias("position"))
    return inventory.host_info(hosts, n.filter("n_regionkey < 3").select(F.col("n_name").alias("host"), F.concat(F.lit("e"), F.col("n_regionkey").cast("string")).alias("engine")))


def text_filtered(spark, d):
    return inventory.text_filter(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "L")


def own_environment(spark, d):
    return inventory.own_env(table(spark, d, "events").select("event_id", F.col("event_type").alias("key"), F.col("props").alias("value")), ["error", "view"])


def inspect_fields(spark, d):
    return table(spark, d, "events").select("event_id", inventory.dig(F.col("props"), "k").alias("k"), inventory.dig(F.col("props"), "none", "deep").alias("none"))


def _failures(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0"))).alias("error"))


def host_outcomes(spark, d):
    return inventory.host_outcome(_failures(spark, d).withColumnRenamed("user_id", "project"))


def alert_deliveries(spark, d):
    return alerts.deliveries(_failures(spark, d).withColumnsRenamed({"user_id": "alert_id", "event_id": "position"}))


def used_share(spark, d):
    return inventory.used_percent(a.generations(spark, d), 1024).select(F.round("used_percent", 9).alias("used_percent"))


def named_stats(spark, d):
    """Samples of every third container have no inventory row."""
    c = a.containers(spark, d)
    stats = c.select("host", "id", "created")
    return inventory.stats_with_names(stats, c.filter("created % 3 <> 0")).select("created", "name")


def ndjson_again(spark, d):
    """Events written as NDJSON and read back."""
    path = scratch.new_path(spark, "ndjson")
    ndjson(table(spark, d, "events").select("event_id", "user_id", "event_type", "props"), path)
    return readers.ndjson(spark, path, "event_id bigint, user_id bigint, event_type string, props string")


def pin_indices(spark, d):
    """Places of lines in all of a container's and among its errors."""
    m = live.index_maps(_parsed(spark, d), F.col("level") == "ERROR", ["ts_ns", "rowid"], ["host", "name"])
    return m.select("rowid", "original_index", "filtered_index")


def projects_of_page(spark, d):
    rows, *_ = inventory.offset_page(a.containers(spark, d).orderBy(F.desc("created")), 2, 100)
    return inventory.by_project(rows)


def framed_lines(spark, d):
    """Lines in an engine's frames: up to 100 of a user are a captured stream, each line cut into two frames."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.concat("event_type", F.lit(" "), "props", F.lit("\r\n")).cast("binary").alias("b"))
    part = lambda x: F.concat(F.when(F.col("event_type") == "error", F.unhex(F.lit("02000000"))).otherwise(F.unhex(F.lit("01000000"))), F.unhex(F.lpad(F.hex(F.length(x)), 8, "0")), x)
    frames = F.concat(part(F.substring("b", F.lit(1), F.lit(5))), part(F.substring("b", F.lit(6), F.length("b"))))
    files = e.groupBy(F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 100)).alias("path")).agg(F.array_sort(F.collect_list(F.struct("event_id", frames.alias("f")))).alias("x")).select("path",
        F.aggregate("x", F.lit(b""), lambda acc, y: F.concat(acc, y["f"])).alias("content"))
    return frames_.lines_of(files).select("path", "line_no", F.col("stream").cast("int").alias("stream"), "raw")


QUERIES = {f.__name__: f for f in (
    parse_levels, parse_timestamps, folded_entries, history_page, history_substring, history_regex, history_containers, tail_per_container, live_search, excluded_matches, grep,
    merged_targets, match_positions, raw_ranges, retention_each, retention_total, retention_groups, purge_container, ingest_dedup, ingest_marks, resume_points, newly_removed,
    prune_empty, stack_summary, container_states, projects_standalone, dashboard, resolve_name, cpu_deltas, percentiles, alert_log_matches,
        alert_fired, alert_window, oom_pairs, lifecycle_events, level_values, stored_retention, stored_purge, stored_backfill, history_stored, history_skipped,
    scalar_formats, conversation_levels, events_alertable, recent_samples, sparkline, counter_rates, dropped_by_ring, upserted_generations,
        removed_containers, exported_text, dashboard_page,
    alert_patterns, alert_fired_noisy, rate_limited, subscriptions, registry_facts, hosts_listed, hosts_info, text_filtered, own_environment, inspect_fields, host_outcomes,
        alert_deliveries, used_share, named_stats, ndjson_again, framed_lines, pin_indices, projects_of_page,
)}


def _fold_sql(keys: str, source: str) -> str:
    """entries with host, container_id, ts_ns, rowid, level, message, continuation_count and keys."""
    return f"""
a AS (SELECT *, kind = 4 AS field, kind IN (5, 9, 12) AS stack FROM {source}),
b AS (SELECT *, lag(container_id) OVER w IS DISTINCT FROM container_id OR level <> 'UNKNOWN' OR NOT (field OR stack) AS sure FROM a WINDOW w AS (PARTITION BY {keys} ORDER BY ts_ns, rowid)),
c AS (SELECT *, last_value(CASE WHEN sure THEN level END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY ts_ns, rowid ROWS UNBOUNDED PRECEDING) AS anchor FROM b),
d AS (SELECT *, sum(CASE WHEN sure OR (stack AND anchor NOT IN ('WARN', 'ERROR', 'FATAL', 'PANIC')) THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts_ns, rowid ROWS UNBOUNDED PRECEDING) AS entry FROM c),
e AS (SELECT {keys}, entry, first(host ORDER BY ts_ns, rowid) AS host_, first(container_id ORDER BY ts_ns, rowid) AS container_id, min(ts_ns) AS ts_ns, first(rowid ORDER BY ts_ns, rowid) AS rowid, first(level ORDER BY ts_ns, rowid) AS level,
 string_agg(body, chr(10) ORDER BY ts_ns, rowid) AS message, CAST(count(*) - 1 AS INT) AS continuation_count, count(*) FILTER (field) AS n_fields, first(field ORDER BY ts_ns, rowid) AS head_field FROM d GROUP BY {keys}, entry)"""


def _history(where: str, keep: str, cols: str, keys: str, limit: int) -> str:
    return f"WITH {_fold_sql(keys, f'(SELECT * FROM {L} WHERE {where})')} SELECT {cols} FROM e WHERE {keep} ORDER BY ts_ns DESC, rowid DESC LIMIT {limit}"


_PROJECT = "CASE WHEN c_custkey % 4 IN (0, 1) THEN 'p' || (c_custkey % 5) END"
_STATE = "['running', 'exited', 'paused', 'restarting', 'dead', 'removed', 'created'][c_custkey % 7 + 1]"
_RULE_MATCHES = f"""SELECT 'r1' AS rule_id, * FROM {L} WHERE level IN ('ERROR', 'FATAL', 'PANIC')
 UNION ALL SELECT 'r2', * FROM {L} WHERE host = 'h0' AND regexp_matches(raw, 'slow|late') UNION ALL SELECT 'r4', * FROM {L} WHERE name = 'svc-1' AND level IN ('WARN', 'ERROR', 'FATAL', 'PANIC')"""

_FAILED = "SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'e' || lpad(CAST(event_id AS VARCHAR), 9, '0') END AS error FROM events"

ORACLES = {
    # DuckDB's patterns are RE2's
    "alert_patterns": " UNION ALL ".join(f"SELECT '{r[0]}' AS rule_id, host, count(*) AS n, min(rowid) AS first_row FROM {L} WHERE regexp_matches(body, '{r[9]}') OR regexp_matches(raw, '{r[9]}') GROUP BY host"
        for r in a.PATTERN_RULES if r[9] != "("),
    # each step finds the window after the last one of every user
    "rate_limited": """WITH RECURSIVE h AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, event_id FROM events),
w AS (SELECT user_id, min(t) AS start FROM h GROUP BY user_id UNION ALL SELECT w.user_id, min(t) FROM w JOIN h ON h.user_id = w.user_id AND t >= start + 86400 GROUP BY w.user_id),
n AS (SELECT h.*, start, row_number() OVER (PARTITION BY h.user_id, start ORDER BY t, event_id) AS hit_no FROM h JOIN w ON h.user_id = w.user_id AND t >= start AND t < start + 86400)
SELECT event_id AS hit_id, start AS window_start, hit_no, hit_no <= 2 AS allowed FROM n""",
    "subscriptions": f"""WITH s AS (SELECT c_custkey AS spec_id, CASE WHEN c_custkey % 2 = 0 THEN 'h' || (c_custkey % 3) END AS h, CASE WHEN c_custkey % 5 < 3 THEN 'svc-' || (c_custkey % 5) END AS n,
  CASE WHEN c_custkey % 4 = 1 THEN 'p' || (c_custkey % 2) END AS p FROM customer)
SELECT spec_id, count(*) AS n, min(rowid) AS first_row FROM s JOIN {L} l ON (h IS NULL OR h = host) AND ((n IS NULL AND p IS NULL) OR coalesce(n = name, false) OR coalesce(p = compose_project, false)) GROUP BY spec_id""",
    "hosts_listed": """SELECT 'h' || (c_custkey % 3) AS host, count(*) AS n, CAST(NULL AS VARCHAR) AS error FROM customer WHERE c_custkey % 3 < 2 GROUP BY 1 UNION ALL SELECT 'h2', NULL, 'timeout'""",
    "hosts_info": """SELECT n_name AS host, n_nationkey AS position, CASE WHEN n_regionkey < 3 THEN 'e' || n_regionkey END AS engine, CASE WHEN n_regionkey >= 3 THEN 'unavailable' END AS error FROM nation""",
    "text_filtered": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_custkey || ' ' || c_name || ' ' || c_mktsegment), 'l')",
    "own_environment": "SELECT event_id, event_type AS key, props AS value FROM events WHERE event_type NOT IN ('error', 'view')",
    "inspect_fields": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS none FROM events",
    "host_outcomes": f"""SELECT user_id AS project, count(*) FILTER (error IS NULL) AS succeeded, count(error) AS failed, coalesce(string_agg(error, '; ' ORDER BY error), '') AS errors FROM ({_FAILED}) GROUP BY 1""",
    "alert_deliveries": f"""SELECT user_id AS alert_id, count(error) = 0 AS ok, coalesce(string_agg(error, '; ' ORDER BY event_id), '') AS errors FROM ({_FAILED}) GROUP BY 1""",
    "used_share": f"SELECT round(sum(strlen(raw)) / 1073741824.0 * 100, 9) AS used_percent FROM {L}",
    "named_stats": """SELECT c_custkey AS created, CASE WHEN c_custkey % 3 <> 0 THEN 'c' || c_custkey ELSE substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12) END AS name FROM customer""",
    "pin_indices": f"""SELECT rowid, row_number() OVER w - 1 AS original_index, CASE WHEN level = 'ERROR' THEN count(*) FILTER (level = 'ERROR') OVER w - 1 ELSE -1 END AS filtered_index FROM {L}
  WINDOW w AS (PARTITION BY host, name ORDER BY ts_ns, rowid)""",
    "projects_of_page": f"""SELECT coalesce({_PROJECT}, 'Standalone') AS project, count(*) AS n FROM (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 100 OFFSET 100) GROUP BY 1""",
    "ndjson_again": "SELECT event_id, user_id, event_type, props FROM events",
    "framed_lines": """SELECT user_id || '-' || (event_id // 100) AS path, row_number() OVER (PARTITION BY user_id, event_id // 100 ORDER BY event_id) - 1 AS line_no, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS stream,
  event_type || ' ' || props AS raw FROM events""",
    "parse_levels": f"""SELECT host, name, level, count(*) AS n,
  CAST(sum(list_position(['UNKNOWN','TRACE','DEBUG','INFO','WARN','ERROR','FATAL','PANIC'], level) - 1) AS BIGINT) AS sum_severity FROM {L}
  GROUP BY ALL""",
    "parse_timestamps": f"SELECT rowid, ts_ns AS parsed_ns, body AS rest FROM {L}",
    "folded_entries": f"""WITH {_fold_sql('host, name', L)} SELECT host, name, rowid, ts_ns, level, message, continuation_count, CASE WHEN n_fields >
  CASE WHEN head_field THEN 1 ELSE 0 END THEN 'user' ELSE '' END AS keys FROM e""",
    "history_page": _history(f"name = 'svc-1' AND ts_ns BETWEEN {SINCE} AND {UNTIL}", "level IN ('ERROR', 'PANIC')",
        "ts_ns, rowid, host_ AS host, container_id, level, message, continuation_count", "name", 200),
    "history_substring": _history("name = 'svc-2' AND host = 'h1'", "contains(lower(message), 'alice')", "ts_ns, rowid, level, message", "host, name", 1000),
    "history_regex": _history("name = 'svc-3' AND host = 'h0'", "regexp_matches(message, '(?i)slow|boom\\z')", "ts_ns, rowid, level, message", "host, name", 1000),
    "history_containers": f"""WITH g AS (SELECT host, container_id, name, max(compose_project) AS compose_project, min(ts_ns) // 1000000 AS first_seen, sum(strlen(raw)) AS bytes, min(ts_ns) AS lo, max(ts_ns) AS hi
  FROM {L} GROUP BY ALL)
SELECT host, name,
  CAST(sum(bytes) AS BIGINT) AS stored_bytes, min(lo) AS oldest_ns, max(hi) AS newest_ns, arg_max(container_id, (first_seen, container_id)) LIKE '%-g0' AS removed, 'img/' || name AS image,
 arg_max(compose_project, (first_seen, container_id)) AS compose_project, CAST(NULL AS VARCHAR) AS excluded_reason, count(*) AS n_generations FROM g
  GROUP BY host, name""",
    "tail_per_container": f"SELECT host, name, rowid, raw FROM {L} QUALIFY row_number() OVER (PARTITION BY host, name ORDER BY ts_ns DESC, rowid DESC) <= 10",
    "live_search": f"SELECT rowid, level, body AS message FROM {L} WHERE level = 'ERROR' AND regexp_matches(raw, 'failed|boom') AND stream = 0",
    "excluded_matches": f"SELECT level, count(*) AS n FROM {L} WHERE NOT regexp_matches(body, '(?i)slow|alice') GROUP BY level",
    "grep": f"""SELECT host, container_id, rowid, ts_ns, level, body AS message FROM (SELECT * FROM {L} QUALIFY row_number()
  OVER (PARTITION BY host, container_id ORDER BY ts_ns DESC, rowid DESC) <= 1000) WHERE regexp_matches(body, 'boom|trouble|order')""",
    "merged_targets": f"""SELECT CAST(idx AS INT) AS target_idx, target_name, rowid AS ord, ts_ns FROM {L}
  JOIN (VALUES (0, 'h0', 'svc-1-g0', 'one'), (1, 'h1', 'svc-1-g1', 'two'), (2, 'h2', 'svc-4-g0', 'three')) t(idx, host, container_id, target_name) USING (host, container_id)""",
    "match_positions": f"""SELECT host, name,
  CAST(position AS INT) AS position, array_to_string(regexp_extract_all(body, '(?i)o[a-z]+'), '|') AS spans FROM (SELECT *, row_number()
  OVER (PARTITION BY host, name ORDER BY ts_ns, rowid) - 1 AS position FROM {L}) WHERE regexp_matches(body, '(?i)o[a-z]+')""",
    "raw_ranges": f"""WITH {_fold_sql('host, name', L)}, f AS (SELECT host, name, rowid, continuation_count, CAST(sum(1 + continuation_count)
  OVER (PARTITION BY host, name ORDER BY ts_ns, rowid ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS raw_last FROM e)
  SELECT host, name, rowid, raw_last - continuation_count AS raw_first, raw_last FROM f""",
    "retention_each": f"""SELECT host, name, rowid, coalesce(sum(strlen(raw)) OVER (PARTITION BY host, name
  ORDER BY ts_ns, rowid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < sum(strlen(raw)) OVER (PARTITION BY host, name) - 20000 AS evict
  FROM {L}""",
    "retention_total": f"""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY host, name ORDER BY ts_ns, rowid) - 1) // 50 AS chunk, strlen(raw) AS b FROM {L}),
c AS (SELECT host, name, chunk, sum(b) AS b, min(ts_ns) AS t FROM n GROUP BY ALL), r AS (SELECT *, (SELECT sum(b) FROM n) - 300000 - coalesce(sum(b)
  OVER (ORDER BY t, host, name, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS excess FROM c),
k AS (SELECT n.*, excess, coalesce(sum(n.b) OVER (PARTITION BY n.host, n.name, n.chunk ORDER BY ts_ns, rowid ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS before FROM n JOIN r USING (host, name, chunk))
SELECT host, name, count(*) AS n, min(rowid) AS first_row FROM k WHERE before >= excess GROUP BY host, name""",
    "retention_groups": f"SELECT host, name, CAST(sum(strlen(raw)) AS BIGINT) AS bytes, count(*) AS n_lines, min(ts_ns) AS oldest_ns FROM {L} GROUP BY host, name",
    "purge_container": f"""SELECT host, name, count(*) AS n, (SELECT count(*) FROM {L} WHERE host = 'h0' AND name = 'svc-1') AS purged FROM {L}
  WHERE NOT (host = 'h0' AND name = 'svc-1') GROUP BY host, name""",
    "ingest_dedup": f"SELECT host, container_id, rowid FROM {L} WHERE ts_ns >= {MIDDLE}",
    "ingest_marks": f"""SELECT host, container_id, CAST(sum(strlen(raw)) AS BIGINT) AS stored_bytes, count(*) AS n_lines,
  coalesce(max(ts_ns) FILTER (stream = 0), 0) AS stdout_wm_ns, coalesce(max(ts_ns) FILTER (stream = 1), 0) AS stderr_wm_ns FROM {L} GROUP BY ALL""",
    "resume_points": f"""WITH m AS (SELECT host, container_id, max(ts_ns) FILTER (stream = 0) AS o, max(ts_ns) FILTER (stream = 1) AS e, min(ts_ns) FILTER (stream = 1
  AND host <> 'h0') AS gap FROM {L} GROUP BY ALL)
SELECT host, container_id, least(least(o, e) - 2000000000, gap - 2000000000) AS since_ns FROM m""",
    "newly_removed": f"SELECT DISTINCT host, container_id FROM {L} WHERE name = 'svc-2' AND host <> 'h2' AND container_id NOT LIKE '%-g0'",
    "prune_empty": f"SELECT DISTINCT host, container_id FROM {L} WHERE NOT (name = 'svc-3' AND container_id LIKE '%-g0')",
    "stack_summary": f"""SELECT {_PROJECT} AS project, count(*) AS containers, count(*) FILTER ({_STATE} = 'running') AS running, string_agg(DISTINCT 'h' || (c_custkey % 3), ','
  ORDER BY 'h' || (c_custkey % 3)) AS hosts FROM customer WHERE {_PROJECT} IS NOT NULL GROUP BY 1""",
    "container_states": f"""SELECT {', '.join(f'count(*) FILTER ({_STATE} = {chr(39)}{s}{chr(39)}) AS {s}' for s in ('running', 'exited', 'paused', 'restarting', 'dead', 'removed'))}, count(*) FILTER ({_STATE} = 'created') AS other, count(*) AS total
  FROM customer""",
    "projects_standalone": f"SELECT coalesce({_PROJECT}, 'Standalone') AS project, count(*) AS n FROM customer GROUP BY 1",
    "dashboard": f"""SELECT c_custkey AS created, {_STATE} AS state, 'h1' AS host FROM customer WHERE c_custkey % 3 = 1 AND c_custkey >= 10
  AND {_STATE} <> 'removed' AND (starts_with(sha256(CAST(c_custkey AS VARCHAR)), 'c1') OR contains('/c' || c_custkey, 'c1'))""",
    "resolve_name": "SELECT c_custkey AS created, 'h' || (c_custkey % 3) AS host FROM customer WHERE c_custkey = 7",
    "cpu_deltas": """WITH s AS (SELECT event_id, 'h' || (user_id % 3) AS host, CAST(user_id AS VARCHAR) AS id, epoch_us(ts) // 1000000 AS t
  FROM events), c AS (SELECT *, t * 100000 + event_id AS at_s, event_id * 7 % 1000 + t AS total, t * 4 + event_id % 3 AS sys FROM s),
p AS (SELECT *, lag(total) OVER w AS pt, lag(sys) OVER w AS ps, lag(at_s) OVER w AS pa FROM c WINDOW w AS (PARTITION BY host, id ORDER BY at_s))
SELECT event_id, round(CASE WHEN pa IS NOT NULL AND at_s - pa < 1000000000 AND total >= pt AND sys > ps THEN (total - pt) / (sys - ps) * 2 * 100.0
  ELSE CASE WHEN total > 0 AND sys > 0 THEN total / sys * 2.0 * 100.0 ELSE 0 END END, 6) AS cpu_percent FROM p""",
    "percentiles": """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max, count(value) AS n
  FROM events GROUP BY event_type""",
    "alert_log_matches": f"SELECT rule_id, host, name AS container_name, count(*) AS n, min(rowid) AS first_row FROM ({_RULE_MATCHES}) GROUP BY ALL",
    "alert_window": """SELECT event_id, coalesce(at_s - lag(at_s, 2) OVER (PARTITION BY user_id, event_type
  ORDER BY at_s) <= 34560000000, false) AS trips FROM (SELECT user_id, event_type, event_id, epoch_us(ts) // 1000000 * 100000 + event_id AS at_s
  FROM events)""",
    # each step takes every key's next match and its state: the last times, the last alert, trips that the cooldown swallowed
    "alert_fired": f"""WITH RECURSIVE rule(rule_id, rule_name, threshold, window_s, cooldown_s, reason) AS (VALUES ('r1', 'errors', 3, 3600, 7200, '3 matches (level >= ERROR) within 3600s'),
 ('r2', 'slow on h0', 1, 60, 300, '1 match (pattern "slow|late") within 60s'), ('r4', 'svc-1 warnings', 2, 86400, 3600, '2 matches (level >= WARN) within 86400s')),
m AS (SELECT rule_id, host, name, container_id, body, ts_ns // 1000000000 AS sec, row_number() OVER (PARTITION BY rule_id, host, name
  ORDER BY ts_ns // 1000000000, rowid) AS i FROM ({_RULE_MATCHES})),
s AS (SELECT DISTINCT rule_id, host, name, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS times,
  CAST(NULL AS BIGINT) AS fired_last, 0 AS swallowed, false AS fired, 0 AS suppressed FROM m
 UNION ALL SELECT rule_id, host, name, i, CASE WHEN fires THEN [] ELSE t END, CASE WHEN fires THEN sec ELSE fired_last END, CASE WHEN fires THEN 0
  WHEN trips THEN swallowed + 1 ELSE swallowed END, fires, swallowed
 FROM (SELECT *, trips AND (fired_last IS NULL OR sec - fired_last >= cooldown_s) AS fires FROM (SELECT *, len(t) >= threshold AND sec - t[1] <= window_s AS trips

  FROM (SELECT s.rule_id, s.host, s.name, m.i, m.sec, list_append(s.times, m.sec)[-threshold:] AS t, s.fired_last, s.swallowed, threshold, window_s, cooldown_s
  FROM s JOIN m ON s.rule_id = m.rule_id AND s.host = m.host AND s.name = m.name AND m.i = s.i + 1 JOIN rule ON rule.rule_id = s.rule_id))))
SELECT substr(sha256(rule_id || '|' || host || '|' || name || '|' || sec), 1, 8) AS id, rule_id, rule_name, 'log' AS type, host, container_id, name AS container_name, reason, body AS sample, threshold AS count, suppressed, sec AS fired_at
FROM s JOIN m USING (rule_id, host, name, i) JOIN rule USING (rule_id) WHERE fired""",
    "oom_pairs": """WITH e AS (SELECT event_id, 'h' || (user_id % 3) AS host, event_type = 'error' AS oom, event_id // 3 AS at FROM events)
SELECT e.event_id, max(o.at) AS last_oom FROM e LEFT JOIN e o ON o.oom AND o.host = e.host AND o.at <= e.at AND e.at - o.at <= 10 GROUP BY e.event_id""",
    "lifecycle_events": """WITH e AS (SELECT *, 'h' || (user_id % 3) AS host, event_id % 4 AS kind, event_id % 5 AS k5 FROM events)
SELECT host, CASE WHEN kind = 0 THEN 'die' WHEN k5 = 2 THEN 'health_status' WHEN k5 = 3 THEN 'health_status: healthy' ELSE 'health_status: unhealthy' END AS action,
 CASE WHEN kind = 0 AND k5 <> 1 THEN CAST(k5 AS VARCHAR) ELSE '' END AS exit_code, CASE WHEN kind = 0 OR k5 = 2 THEN '' WHEN k5 = 3 THEN 'healthy'
  ELSE 'unhealthy' END AS health_status, count(*) AS n FROM e WHERE kind IN (0, 2) GROUP BY ALL""",
    "level_values": f"SELECT DISTINCT level FROM {L}",
    "stored_retention": f"""WITH k AS (SELECT *, coalesce(sum(strlen(raw)) OVER (PARTITION BY host, name
  ORDER BY ts_ns, rowid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= sum(strlen(raw)) OVER (PARTITION BY host, name) - 20000 AS keep
  FROM {L}),
n AS (SELECT *, (row_number() OVER (PARTITION BY host, name ORDER BY ts_ns, rowid) - 1) // 5000 AS chunk, strlen(raw) AS b FROM k WHERE keep),
c AS (SELECT host, name, chunk, sum(b) AS b, min(ts_ns) AS t FROM n GROUP BY ALL), r AS (SELECT *, (SELECT sum(b) FROM n) - 200000 - coalesce(sum(b)
  OVER (ORDER BY t, host, name, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS excess FROM c),
x AS (SELECT n.*, excess, coalesce(sum(n.b) OVER (PARTITION BY n.host, n.name, n.chunk ORDER BY ts_ns, rowid ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS before FROM n JOIN r USING (host, name, chunk))
SELECT host, name, count(*) AS n, min(rowid) AS first_row, max(rowid) AS last_row FROM x WHERE before >= excess GROUP BY host, name""",
    "stored_purge": f"""SELECT host, name, count(*) AS n, min(rowid) AS first_row, max(rowid) AS last_row, (SELECT count(*) FROM {L} WHERE host = 'h0'
  AND name = 'svc-1') AS purged FROM {L} WHERE NOT (host = 'h0' AND name = 'svc-1') GROUP BY host, name""",
    "stored_backfill": f"SELECT host, name, count(*) AS n, min(rowid) AS first_row, max(rowid) AS last_row FROM {L} GROUP BY host, name",
    "history_stored": _history(f"name = 'svc-1' AND ts_ns <= {UNTIL}", "level = 'ERROR'", "ts_ns, rowid, host_ AS host, level, message, continuation_count", "name", 50),
    "history_skipped": _history("name = 'svc-2'", "regexp_matches(message, 'main\\.go:[0-9]+ \\+0x')", "ts_ns, rowid, host_ AS host, level, message, continuation_count", "name", 1000),
    "scalar_formats": """WITH n AS (SELECT event_id, event_id * event_id * 37 AS n, event_id * 61 AS s FROM events)
SELECT event_id, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN format('{:.1f}KiB', n / 1024)
  WHEN n < 1073741824 THEN format('{:.1f}MiB', n / 1048576) WHEN n < 1099511627776 THEN format('{:.1f}GiB', n / 1073741824)
  WHEN n < 1125899906842624 THEN format('{:.1f}TiB', n / 1099511627776) ELSE format('{:.1f}PiB', n / 1125899906842624) END AS bytes,
 CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago'
  ELSE s // 86400 || 'd ago' END AS age, (event_id % 512) * 1048576 AS memory, (event_id % 90) * 60.0::DOUBLE AS seconds,
 CASE WHEN event_id = 0 THEN '0' WHEN event_id % 1048576 = 0 THEN event_id // 1048576 || 'g' WHEN event_id % 1024 = 0 THEN event_id // 1024 || 'm'
  ELSE event_id || 'k' END AS exact FROM n""",
    # turns hold no JSON and no keyed levels, so keywords decide
    "conversation_levels": """SELECT
  CASE WHEN regexp_matches(line, '(?i)\\b(?:panic|emergency)\\b') THEN 'PANIC' WHEN regexp_matches(line, '(?i)\\b(?:fatal|critical|crit)\\b') THEN 'FATAL'
  WHEN regexp_matches(line, '(?i)\\b(?:error|err|fail|failed|exception)\\b') THEN 'ERROR' WHEN regexp_matches(line, '(?i)\\b(?:warn|warning|wrn)\\b') THEN 'WARN'
  WHEN regexp_matches(line, '(?i)\\b(?:info|inf|notice|log)\\b') THEN 'INFO' WHEN regexp_matches(line, '(?i)\\b(?:debug|dbg)\\b') THEN 'DEBUG'
  WHEN regexp_matches(line, '(?i)\\b(?:trace|trc)\\b') THEN 'TRACE'
  ELSE 'UNKNOWN' END AS level, count(*) AS n
 FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE line <> '' GROUP BY 1""",
    "events_alertable": """WITH e AS (SELECT *, 'h' || (user_id % 3) AS host, event_id % 4 AS kind, event_id % 5 AS k5 FROM events),
r AS (SELECT host, CASE WHEN kind = 0 THEN 'die' WHEN kind = 1 THEN 'oom' WHEN kind = 2 AND k5 <> 3 THEN 'unhealthy' END AS what, CASE
  WHEN kind = 0 THEN CASE WHEN k5 = 0 THEN '0' WHEN k5 = 1 THEN 'unknown' ELSE CAST(k5 AS VARCHAR) END ELSE '' END AS exit_code FROM e)
SELECT host, what, exit_code, count(*) AS n FROM r WHERE what IS NOT NULL AND exit_code <> '0' GROUP BY ALL""",
    "recent_samples": """WITH s AS (SELECT 'h' || (user_id % 3) AS host, CAST(user_id AS VARCHAR) AS id, event_id // 50 AS at_s FROM events)
SELECT host, id, least(count(*), 5) AS n FROM s WHERE (host, id) IN (SELECT (host, id) FROM s WHERE at_s = (SELECT max(at_s) FROM s)) GROUP BY ALL""",
    "sparkline": """SELECT event_id, round((value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, 2.0), 6) AS level FROM events
  WINDOW w AS (PARTITION BY user_id, event_type)""",
    "counter_rates": """SELECT event_id, (value - lag(value) OVER w) / nullif(event_id * 2 - lag(event_id * 2) OVER w, 0) AS rate FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""",
    "dropped_by_ring": f"SELECT host, name, least(count(*), 100) AS n, greatest(count(*) - 100, 0) AS dropped FROM {L} GROUP BY ALL",
    "upserted_generations": f"""WITH g AS (SELECT host, container_id, name, rowid, stream, ts_ns >= {MIDDLE} AS new FROM {L})
SELECT host, container_id,
  coalesce(max(name) FILTER (stream = 0), '') AS name, '' AS compose_project, 'img' || (arg_max(rowid, (new, rowid)) % 7) AS image, min(rowid) AS first_seen_ms, max(rowid) AS last_seen_ms
  FROM g GROUP BY ALL""",
    "removed_containers": f"""SELECT 'removed:' || name AS id, host, 'removed' AS state, 'img/' || name AS image,
  CAST(sum(strlen(raw)) AS BIGINT) AS stored_bytes FROM {L} WHERE name <> 'svc-1' AND NOT (host = 'h0' AND name = 'svc-0') GROUP BY host, name""",
    "exported_text": f"""SELECT '[' || strftime(date_trunc('millisecond', make_timestamp(ts_ns // 1000)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z] [' || level || '] ' || body AS value
  FROM {L}""",
    "dashboard_page": f"""SELECT c_custkey AS created, 11 AS first, least(20, total) AS last, total FROM (SELECT c_custkey, CAST(count(*)
  OVER () AS INT) AS total FROM customer WHERE {_STATE} = 'running') ORDER BY c_custkey DESC LIMIT 10 OFFSET 10""",
}
ORACLES["registry_facts"] = ORACLES["ingest_marks"]
ORACLES["alert_fired_noisy"] = ORACLES["alert_fired"].rsplit("SELECT substr(", 1)[0] + "SELECT rule_id || '|' || host || '|' || name AS key, sec AS at_s, suppressed FROM s JOIN m USING (rule_id, host, name, i) WHERE fired"
