"""Alert rules: predicates, count in a window with a cooldown, reasons, history. Event time is used, so a replay gives the same alerts."""
from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewater.functions.format import in_project, stable_id, whole
from tidewater.functions.parse import LEVELS, sample, severity
from tidewater.functions.patterns import re2_to_java

from tidewater.sources.scratch import delete, written

from .chains import CHUNK, chain
from .running import SLICE_ROWS, running_sum

# Defaults and limits of rules.
DEFAULT_WINDOW_S, DEFAULT_COOLDOWN_S, OOM_DIE_S = 60, 300, 10
MOST_RULES, MOST_NAME, MOST_THRESHOLD, WINDOW_S, MOST_COOLDOWN_S, MOST_CHANNELS = 50, 64, 1000, (5, 3600), 86_400, 20
EVENT_ACTIONS = ["start", "die", "oom", "destroy", "rename", "health_status"]
# Actions of the lifecycle stream.
LIFECYCLE_ACTIONS = ["create", "start", "stop", "die", "restart", "pause", "unpause", "destroy", "rename", "health_status"]
MOST_ALERTS = 500
# columns of a compiled rule
RULE_COLUMNS = ("id string, name string, enabled boolean, type string, hosts array<string>, containers array<string>, projects array<string>, events array<string>, "
                "min_level string, pattern string, threshold int, window_s int, cooldown_s int, rule_version bigint")


def check_rules(rules: list[dict]) -> list[dict]:
    """Rules as they are stored, or an error."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    out = []
    for r in rules:
        r = dict(r, threshold=r.get("threshold") or 1, window_s=r.get("window_s") or DEFAULT_WINDOW_S, cooldown_s=r.get("cooldown_s") or 0)
        if not r.get("name") or len(r["name"]) > MOST_NAME:
            raise ValueError("a rule needs a name of up to 64 characters")
        if not 1 <= r["threshold"] <= MOST_THRESHOLD or not WINDOW_S[0] <= r["window_s"] <= WINDOW_S[1] or not 0 <= r["cooldown_s"] <= MOST_COOLDOWN_S:
            raise ValueError(f"rule {r['name']!r}: threshold, window or cooldown is out of range")
        if r.get("pattern"):
            re2_to_java(r["pattern"])
        out.append(r)
    return out


def at_most(df: DataFrame, n: int, what: str) -> None:
    if df.limit(n + 1).count() > n:
        raise ValueError(f"over {n} {what}")


def compiled(rules: DataFrame, kind: str) -> DataFrame:
    """Enabled rules of a kind with their defaults; over MOST_RULES rules are an error."""
    at_most(rules, MOST_RULES, "rules")
    d = rules.filter((F.col("enabled")) & (F.col("type") == kind))
    whole_rule = ("type", "hosts", "containers", "projects", "events", "min_level", "pattern", "threshold", "window_s", "cooldown_s")
    return d.withColumn("rule_version", F.xxhash64(*whole_rule)).withColumns({
        "threshold": F.greatest(F.coalesce("threshold", F.lit(1)), F.lit(1)),
        "window_s": F.coalesce(F.nullif("window_s", F.lit(0)), F.lit(DEFAULT_WINDOW_S)), "cooldown_s": F.coalesce(F.nullif("cooldown_s", F.lit(0)), F.lit(DEFAULT_COOLDOWN_S)),
    })


def _usable(rules: DataFrame, kind: str) -> tuple[list[Row], list[str | None], list[tuple[str, str]]]:
    """Rules of a kind, their patterns in Java's dialect, and (id, reason) of those whose pattern is none: they are left out, others go on."""
    good, patterns, bad = [], [], []
    for r in compiled(rules, kind).collect():  # MOST_RULES at most
        try:
            patterns.append(re2_to_java(r.pattern) if r.pattern else None)
            good.append(r)
        except ValueError as e:
            bad.append((r.id, str(e)))
    return good, patterns, bad


def rejected_rules(rules: DataFrame) -> DataFrame:
    """rule_id and reason of enabled rules that can't be used, as their pattern is no pattern."""
    bad = [x for kind in ("log", "event") for x in _usable(rules, kind)[2]]
    return rules.sparkSession.createDataFrame(bad, "rule_id string, reason string")


def target_matches(hosts: list[str], names: list[str], projects: list[str], host: Column, name: Column, labels: Column) -> Column:
    """Hosts AND (names OR projects); an empty dimension matches all."""
    cond = host.isin(hosts) if hosts else F.lit(True)
    of = [name.isin(names)] if names else []
    of += [in_project(labels, F.lit(x)) for x in projects]
    return cond & reduce(Column.__or__, of) if of else cond


def entry_matches(min_level: str | None, pattern: str | None, level: Column, message: Column, raw: Column) -> Column:
    """pattern: in Java's dialect. It is a literal, so it is compiled once and not for each row."""
    cond = F.lit(True)
    if min_level:
        floor = LEVELS.index(min_level) if min_level in LEVELS else 0
        cond = severity(level) >= F.lit(max(floor, 1)).cast("tinyint")
    return cond & (message.rlike(pattern) | raw.rlike(pattern)) if pattern else cond


def _by_rule(d: DataFrame, rules: list[Row], conditions: list[Column], columns: dict[str, str]) -> DataFrame:
    """A row for each row of d and rule that matches it, with the rule's columns. Conditions are evaluated in one pass."""
    spark, schema = d.sparkSession, [x.strip() for x in RULE_COLUMNS.split(",")]
    table = spark.createDataFrame([(i, *[getattr(r, c.split()[0]) for c in schema]) for i, r in enumerate(rules)], f"rule_no_ int, {RULE_COLUMNS}")
    numbers = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])) if rules else F.array().cast("array<int>")
    d = d.select("*", F.explode(numbers).alias("rule_no_"))
    return d.join(F.broadcast(table.withColumnsRenamed(columns)), "rule_no_").drop("rule_no_")  # MOST_RULES rows at most


def log_matches(rules: DataFrame, records: DataFrame) -> DataFrame:
    """Physical lines, never folded, against every log rule; a rule whose pattern is invalid matches nothing (see rejected_rules)."""
    good, patterns, _ = _usable(rules, "log")
    on = [target_matches(r.hosts, r.containers, r.projects, F.col("host"), F.col("container_name"), F.col("labels"))
          & entry_matches(r.min_level, p, F.col("level"), F.col("message"), F.col("raw")) for r, p in zip(good, patterns)]
    d = _by_rule(records, good, on, {"id": "rule_id", "name": "rule_name"})
    return d.withColumn("sample", sample(F.col("message"), F.col("raw"))).withColumn("key", F.concat_ws("|", "rule_id", "host", "container_name"))


def event_base(action: Column) -> Column:
    return F.split_part(action, F.lit(": "), F.lit(1))


def map_events(raw: DataFrame, actions: list[str] = EVENT_ACTIONS) -> DataFrame:
    """type, action, attributes, time_s, time_ns, id, host as an engine gives them, to the events that are watched: those that alerts
    look at, or LIFECYCLE_ACTIONS for the stream that users follow."""
    base = event_base(F.col("action"))
    attr = lambda k: F.try_element_at("attributes", F.lit(k))
    return raw.filter((F.col("type") == "container") & base.isin(actions)).select(
        "host", F.col("id").alias("container_id"), F.coalesce(attr("name"), F.lit("")).alias("container_name"), "action", base.alias("base"),
        F.when(base == "die", F.coalesce(attr("exitCode"), F.lit(""))).otherwise("").alias("exit_code"),
        F.when(base == "health_status", F.split_part("action", F.lit(": "), F.lit(2))).otherwise("").alias("health_status"),
        F.col("attributes").alias("labels"),
            F.when((F.col("time_s") == 0) & (F.col("time_ns") > 0), whole(F.col("time_ns"), 1_000_000_000)).otherwise(F.col("time_s")).alias("at_s"),
    )


def alertable(events: DataFrame, inspected: DataFrame) -> DataFrame:
    """Events that can fire: die with an exit code other than 0, oom, unhealthy. What an event lacks is looked up in
    inspected (host, container_id, exit_code, oom_killed, health); a failed look-up is exit `unknown`, and no health alert."""
    look = inspected.select("host", "container_id", F.col("exit_code").alias("i_exit"), F.col("oom_killed").alias("i_oom"), F.col("health").alias("i_health"))
    d = events.join(look, ["host", "container_id"], "left")
    missing = F.col("exit_code") == ""
    code = F.when(~missing, F.col("exit_code")).otherwise(F.coalesce("i_exit", F.lit("unknown")))
    die = (F.col("base") == "die") & ((code != "0") | (missing & F.coalesce("i_oom", F.lit(False))))
    health = F.coalesce(F.nullif("health_status", F.lit("")), F.col("i_health"))
    what = F.when(die, "die").when(F.col("base") == "oom", "oom").when((F.col("base") == "health_status") & (health == "unhealthy"), "unhealthy")
    return d.withColumn("what", what).withColumn("exit_code", F.when(what == "die", code).otherwise("")).filter("what IS NOT NULL").drop("i_exit", "i_oom", "i_health")


def with_last_oom(events: DataFrame) -> DataFrame:
    """Adds last_oom: when the container last had one, if at most OOM_DIE_S before. An equality join: times are cut into runs of
    OOM_DIE_S, and an oom counts for its own run and the next."""
    own = whole(F.col("at_s"), OOM_DIE_S)
    ooms = events.filter(F.col("what") == "oom").select(F.col("host").alias("host_"), F.col("container_id").alias("container_"), own.alias("run_"), F.col("at_s").alias("oom_"))
    ooms = ooms.groupBy("host_", "container_", "run_").agg(F.array_sort(F.collect_set("oom_")).alias("ooms_"))  # OOM_DIE_S times at most
    ooms = ooms.select("host_", "container_", F.explode(F.array(F.col("run_"), F.col("run_") + 1)).alias("run_"), "ooms_")
    ooms = ooms.groupBy("host_", "container_", "run_").agg(F.flatten(F.collect_list("ooms_")).alias("ooms_"))
    d = events.withColumn("run_own_", own).join(ooms,
        (F.col("host") == F.col("host_")) & (F.col("container_id") == F.col("container_")) & (F.col("run_own_") == F.col("run_")), "left")
    before = F.filter("ooms_", lambda t: (t <= F.col("at_s")) & (F.col("at_s") - t <= OOM_DIE_S))
    return d.withColumn("last_oom", F.array_max(before)).drop("run_own_", "host_", "container_", "run_", "ooms_")


def event_matches(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Alertable events against event rules. A die within OOM_DIE_S after an oom of the same container is one incident with it, for
    rules that watch both. Events that come with last_oom (the streaming form adds it) are taken as they are."""
    d = events if "last_oom" in events.columns else with_last_oom(events)
    d = d.withColumn("container_name", F.regexp_replace("container_name", "^/", ""))
    good, _, _ = _usable(rules, "event")
    on = [F.col("what").isin(r.events) & target_matches(r.hosts, r.containers, r.projects, F.col("host"), F.col("container_name"), F.col("labels")) for r in good]
    d = _by_rule(d, good, on, {"id": "rule_id", "name": "rule_name", "events": "watched"})
    pair = (F.col("what") == "die") & F.array_contains("watched", F.lit("oom")) & F.col("last_oom").isNotNull()
    return d.filter(~pair).withColumn("key", F.concat_ws("|", "rule_id", "host", "container_name"))


def numbered(matches: DataFrame, at: str = "at_s", tie: str = "match_id", slice_s: int = 86_400) -> DataFrame:
    """Adds no_, a match's number within its key by time, from 0, and trips: whether the threshold-th last match lies within the window.
    Each match is joined with the one `threshold` - 1 before it by number, so a noisy key is spread like any other."""
    d = running_sum(matches, ["key"], None, [at, tie], F.lit(1), "no_", unit=slice_s)
    then = d.select(F.col("key").alias("key_"), (F.col("no_") + F.col("threshold") - 1).alias("no2_"), F.col(at).alias("then_"))
    d = d.join(then, (F.col("key") == F.col("key_")) & (F.col("no_") == F.col("no2_")), "left")
    return d.withColumn("trips", F.coalesce(F.col(at) - F.col("then_") <= F.col("window_s"), F.lit(False))).drop("key_", "no2_", "then_")


def count_in_window(matches: DataFrame, at: str = "at_s", tie: str = "match_id", slice_s: int = 86_400) -> DataFrame:
    """Without a cooldown: whether the threshold-th last match lies within the window."""
    return numbered(matches, at, tie, slice_s).drop("no_")


class RuleWindow:
    """State of one rule and container: the last matches, the last alert, and trips that the cooldown has swallowed."""

    def __init__(self, threshold: int, window: int, cooldown: int, times=(), last=None, swallowed: int = 0):
        self.threshold, self.window, self.cooldown = threshold, window, cooldown
        self.times, self.last, self.swallowed = deque(times, threshold), last, swallowed

    def match(self, now: int) -> int | None:
        """The swallowed count if this match fires, else None."""
        self.times.append(now)
        if len(self.times) < self.threshold or now - self.times[0] > self.window:
            return None
        if self.last is not None and now - self.last < self.cooldown:
            self.swallowed += 1
            return None
        out, self.last, self.swallowed = self.swallowed, now, 0
        self.times.clear()
        return out


FIRED = "key string, at_s bigint, suppressed int, match_id bigint"


def _fire(batches):
    """Matches sorted by key and time, streamed: a key's state passes from batch to batch, its rows are never held together."""
    key, state = None, None
    for b in batches:
        out = []
        for k, at, i, n, window, cooldown in zip(b["key"], b["at_s"], b["match_id"], b["threshold"], b["window_s"], b["cooldown_s"]):
            if k != key:
                key, state = k, RuleWindow(int(n), int(window), int(cooldown))
            if (swallowed := state.match(int(at))) is not None:
                out.append((k, int(at), swallowed, int(i)))
        yield pd.DataFrame(out, columns=["key", "at_s", "suppressed", "match_id"]).astype({"at_s": "int64", "suppressed": "int32", "match_id": "int64"})


def fire(matches: DataFrame, slice_s: int = 86_400, chunk: int = CHUNK) -> DataFrame:
    """matches: key, at_s, match_id, threshold, window_s, cooldown_s. The matches that fire, and the trips swallowed before each.

    Keys of up to `chunk` matches are gone through one by one; a key that holds more is `fire_by_pointers`' work.
    """
    m, _ = written(matches.select("key", "at_s", "match_id", "threshold", "window_s", "cooldown_s"), "matches")
    noisy, _ = written(m.groupBy("key").count().filter(F.col("count") > chunk).select("key"), "noisy")
    step = lambda d: d.repartition("key").sortWithinPartitions("key", "at_s", "match_id").mapInPandas(_fire, FIRED)
    if noisy.isEmpty():
        return step(m)
    return step(m.join(noisy, "key", "left_anti")).unionByName(fire_by_pointers(m.join(noisy, "key", "left_semi"), slice_s, chunk))


def fire_by_pointers(m: DataFrame, slice_s: int = 86_400, chunk: int = CHUNK) -> DataFrame:
    """The same, without going through a key in one task. After an alert at match i, the next one is the first match that trips, is at least
    `threshold` matches after i (the window begins anew) and at least the cooldown later; the trips between were swallowed. So each trip has
    a pointer to the trip that would follow it if it were an alert, and the alerts are the chain of pointers from the key's first trip
    (`chains.chain`). Pointers come from running counts of trips over slices: by number for the threshold, by time for the cooldown.
    """
    trips = numbered(m, slice_s=slice_s).filter("trips").select("key", "at_s", "match_id", "no_", "threshold", "cooldown_s")
    trips, _ = written(trips, "trips")
    row = lambda kind, pos, n: trips.select("key", "no_", F.lit(kind).alias("kind_"), pos.cast("bigint").alias("pos_"), F.lit(n).alias("n_"))
    by_number = row("rank_", F.col("no_"), 1).unionByName(row("window_", F.col("no_") + F.col("threshold"), 0))
    by_time = row("at_", F.col("at_s"), 1).unionByName(row("cool_", F.col("at_s") + F.col("cooldown_s"), 0))
    # at an equal place, what asks comes before the trips it asks for
    count = lambda d, unit: running_sum(d, ["key"], None, ["pos_", "n_", "no_"], F.col("n_"), "earlier_", "all_", unit)
    asked = count(by_number, SLICE_ROWS).unionByName(count(by_time, slice_s)).filter("kind_ <> 'at_'")
    of = lambda kind: F.max(F.when(F.col("kind_") == kind, F.col("earlier_")))
    ranked = asked.groupBy("key", "no_").agg(of("rank_").alias("rank"), of("window_").alias("free_"), of("cool_").alias("cool_"), F.max("all_").alias("all_"))
    follows = F.greatest("free_", "cool_")
    d = ranked.select(F.col("key").alias("key_"), F.col("no_").alias("no2_"), "rank", F.when(follows < F.col("all_"), follows).alias("next"),
        (follows - F.col("free_")).alias("between"))
    d = trips.select("key", "no_", "at_s", "match_id").join(d, (F.col("key") == F.col("key_")) & (F.col("no_") == F.col("no2_"))).drop("key_", "no2_", "no_")
    return chain(d, chunk).select("key", "at_s", F.coalesce("carried", F.lit(0)).cast("int").alias("suppressed"), "match_id")


# The reasons' texts.
def log_reason(threshold: Column, min_level: Column, pattern: Column, window_s: Column) -> Column:
    level = F.when(F.coalesce(min_level, F.lit("")) != "", F.concat(F.lit("level >= "), min_level))
    like = F.when(F.coalesce(pattern, F.lit("")) != "", F.concat(F.lit('pattern "'), pattern, F.lit('"')))
    conds = F.concat_ws(", ", level, like)
    cond = F.when(conds != "", F.concat(F.lit(" ("), conds, F.lit(")"))).otherwise("")
    return F.concat(threshold.cast("string"), F.when(threshold == 1, " match").otherwise(" matches"), cond, F.lit(" within "), window_s.cast("string"), F.lit("s"))


def event_reason(threshold: Column, what: Column, exit_code: Column, window_s: Column) -> Column:
    within = F.concat(F.lit(" within "), window_s.cast("string"), F.lit("s"))
    one = F.when(what == "oom", "container OOM-killed").when(what == "unhealthy",
        "container became unhealthy").otherwise(F.concat(F.lit("container died (exit "), exit_code, F.lit(")")))
    n = threshold.cast("string")
    many = F.when(what == "oom", F.concat(n, F.lit(" OOM kills"), within)).when(what == "unhealthy",
        F.concat(n, F.lit(" unhealthy transitions"), within)).otherwise(F.concat(n, F.lit(" container deaths"), within, F.lit(" (last exit "),
        exit_code, F.lit(")")))
    return F.when(threshold <= 1, one).otherwise(many)


def alerts(matches: DataFrame, fired: DataFrame, reason: Column) -> DataFrame:
    """Alert rows. The count is the rule's threshold, as the window is reset when it fires."""
    return alert_rows(matches.join(fired.select("match_id", "suppressed"), "match_id"), reason)


def alert_rows(fired: DataFrame, reason: Column) -> DataFrame:
    """Of matches that fired, with all their columns and `suppressed`."""
    return fired.select(stable_id(F.col("key"), F.col("at_s")).alias("id"), "rule_id", "rule_name", "type", "host", "container_id", "container_name",
        reason.alias("reason"), "sample", F.col("threshold").alias("count"), "suppressed", F.col("at_s").alias("fired_at"))


def append_history(alert_rows: DataFrame, path: str, batch: int, most: int = MOST_ALERTS) -> None:
    """Adds a batch's alerts to the history. A batch that is run again replaces what it wrote. Batches that hold none of the newest `most`
    alerts go, so the history stays small."""
    spark = alert_rows.sparkSession
    alert_rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    rows = spark.read.schema(StructType([*alert_rows.schema.fields, StructField("batch", LongType())])).parquet(path)
    newest = rows.orderBy(F.desc("fired_at"), "id").limit(most).agg(F.min("fired_at").alias("since"), F.count("*").alias("n")).first()
    if newest.n == most:
        for r in rows.groupBy("batch").agg(F.max("fired_at").alias("last")).filter(F.col("last") < newest.since).collect():  # a row a batch
            delete(spark, f"{path}/batch={r.batch}")


def history(alert_rows: DataFrame, limit: int = 100) -> DataFrame:
    return alert_rows.orderBy(F.desc("fired_at"), "id").limit(max(1, min(limit, MOST_ALERTS)))


def deliveries(results: DataFrame) -> DataFrame:
    """Per alert: fine only if no channel failed; the failures' texts."""
    return results.groupBy("alert_id").agg((F.count_if(F.col("error").isNotNull()) == 0).alias("ok"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("position", "error")))),
        lambda x: x["error"]), "; ").alias("errors"))
