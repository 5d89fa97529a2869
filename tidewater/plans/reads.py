"""The reads that users know by name, over one set of tables: what the HTTP, command-line and assistant reads give."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidewater.functions.format import container_name
from tidewater.operators import alerts, fold, inventory, live
from tidewater.operators.ingest import on_days

from . import history

MINUTE_NS = 60_000_000_000
# What `grep` looks at by default.
GREP_SINCE_NS, GREP_TAIL = 15 * MINUTE_NS, 1000


@dataclass
class Tables:
    """Whatever of these there is. lines: LOG_LINES, with `day` if stored by day; containers: id, names, image, state, host, labels, created."""
    lines: DataFrame
    containers: DataFrame
    generations: DataFrame | None = None
    samples: DataFrame | None = None
    events: DataFrame | None = None
    images: DataFrame | None = None
    volumes: DataFrame | None = None
    networks: DataFrame | None = None
    hosts: DataFrame | None = None
    host_info: DataFrame | None = None
    alert_rows: DataFrame | None = None


def containers(t: Tables, search: str = "", host: str = "", state: str = "") -> DataFrame:
    """Live containers, and removed ones that lines are stored of."""
    rows = t.containers if t.generations is None else inventory.live_and_removed(t.containers, history_containers(t))
    return rows.filter(inventory.dashboard(search, host, state))


def inspect(t: Tables, wanted: str, host: str = "") -> dict:
    """One container by name or by the start of its id; none or several are an error."""
    return inventory.resolve_one(t.containers, wanted, host)


def _between(lines: DataFrame, since_ns: int | None, until_ns: int | None) -> DataFrame:
    lines = on_days(lines, since_ns, until_ns)
    if since_ns is not None:
        lines = lines.filter(F.col("ts_ns") >= since_ns)
    return lines.filter(F.col("ts_ns") <= until_ns) if until_ns is not None else lines


def _of(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Lines of the containers in rows, with their names."""
    names = rows.select("host", F.col("id").alias("container_id"), container_name(F.col("names"), F.col("id")).alias("container_name"))
    return lines.join(names, ["host", "container_id"])


def logs(t: Tables, wanted: str = "", stack: str = "", host: str = "", tail: int = live.DEFAULT_TAIL, level: str = "", search: str = "",
    since_ns: int | None = None, until_ns: int | None = None) -> DataFrame:
    """The last lines of one container, or of each of a stack's; folded first, then filtered, in the order of time."""
    if stack:
        rows = inventory.stack_members(t.containers, stack)
        rows = rows.filter(F.col("host") == host) if host else rows
    else:
        one = inspect(t, wanted, host)
        rows = t.containers.filter((F.col("id") == one["id"]) & (F.col("host") == one["host"]))
    lines = live.tail(_of(_between(t.lines, since_ns, until_ns), rows), min(tail, live.MOST_TAIL), ["host", "container_id"], ["ts_ns", "rowid"])
    entries = fold.fold(fold.parse(lines), ["host", "container_id", "container_name"])
    return live.keep(entries, live.live_match(level, search)).orderBy("ts_ns", "rowid")


def grep(t: Tables, pattern: str, now_ns: int, since_ns: int | None = None, tail: int = GREP_TAIL, level: str = "", host: str = "") -> DataFrame:
    """Matching lines of all running containers, merged by time."""
    rows = t.containers.filter(F.col("state") == "running")
    rows = rows.filter(F.col("host") == host) if host else rows
    lines = _of(_between(t.lines, now_ns - GREP_SINCE_NS if since_ns is None else since_ns, None), rows)
    lines = fold.parse(live.tail(lines, min(tail, live.MOST_TAIL), ["host", "container_id"], ["ts_ns", "rowid"]))
    return live.keep(lines, live.live_match(level, pattern)).orderBy("ts_ns", "host", "container_id", "rowid")


def search_logs(t: Tables, pattern: str, now_ns: int, limit: int | None = None, **kwargs) -> DataFrame:
    """grep, as an assistant may ask for it: the newest matches up to its limit."""
    return grep(t, pattern, now_ns, **kwargs).orderBy(F.desc("ts_ns"), F.desc("rowid")).limit(live.read_size(limit))


def aggregate(t: Tables, targets: str | list[str], tail: int = live.DEFAULT_TAIL) -> DataFrame:
    """Lines of up to 20 targets, merged by time."""
    lines = live.tail(live.of_targets(t.lines, live.targets(targets)), min(tail, live.MOST_TAIL), ["target_idx"], ["ts_ns", "rowid"])
    return live.merge_targets(fold.parse(lines).withColumnRenamed("rowid", "ord"))


def stats(t: Tables) -> DataFrame:
    return inventory.stats_with_names(inventory.cpu_between_polls(t.samples), t.containers)


def events(t: Tables) -> DataFrame:
    return alerts.map_events(t.events, alerts.LIFECYCLE_ACTIONS)


def images(t: Tables) -> DataFrame:
    return inventory.images(t.images)


def volumes(t: Tables) -> DataFrame:
    return inventory.volumes(t.volumes)


def networks(t: Tables) -> DataFrame:
    return inventory.subnets(t.networks)


def host_stats(t: Tables) -> DataFrame:
    return inventory.host_info(t.hosts, t.host_info)


def stacks(t: Tables) -> DataFrame:
    return inventory.stacks(t.containers)


def history_logs(t: Tables, q: history.HistoryQuery) -> history.Page:
    return history.fetch(t.lines, q)


def history_search(t: Tables, q: history.HistoryQuery) -> history.Page:
    """history_logs within an assistant's limits."""
    q.limit = live.read_size(q.limit)
    return history.fetch(t.lines, q)


def history_containers(t: Tables) -> DataFrame:
    return history.stored_containers(t.lines, t.generations)


def history_status(t: Tables, total_mb: int) -> DataFrame:
    """How many containers are stored, how much of the cap they use, and since when."""
    stored = history_containers(t)
    whole = stored.agg(F.count("*").alias("containers"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("stored_bytes"), F.min("oldest_ns").alias("oldest_ns"))
    return whole.join(inventory.used_percent(stored, total_mb))


def alert_history(t: Tables, limit: int = 100) -> DataFrame:
    return alerts.history(t.alert_rows, limit)
