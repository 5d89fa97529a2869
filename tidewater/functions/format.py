"""Durations, sizes, ages, names and other small formats, as Column expressions."""
from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# Seconds of a duration unit, and the factor of a memory unit.
SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
MEMORY = {"kib": 1 << 10, "kb": 1 << 10, "k": 1 << 10, "mib": 1 << 20, "mb": 1 << 20, "m": 1 << 20, "gib": 1 << 30, "gb": 1 << 30, "g": 1 << 30, "b": 1, "": 1}
PROJECT_LABELS = ["com.docker.compose.project", "io.podman.compose.project"]


def whole(c: Column, by: int) -> Column:
    """Floor of c / by in integers: nanoseconds don't fit a double."""
    return (F.call_function("div", c, F.lit(by).cast("bigint")) - F.when((c < 0) & (F.pmod(c, F.lit(by)) != 0), 1).otherwise(0)).cast("bigint")


def utc_text(ns: Column, layout: str) -> Column:
    """Epoch nanoseconds in UTC, whatever the session's zone."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), F.timestamp_micros(whole(ns, 1000)).cast("timestamp_ntz")), layout)


def duration_seconds(value: Column) -> Column:
    """30s, 15m, 1h30m, 1.5d; null if it is none."""
    days = F.regexp_extract(value, r"^([+-]?\d*\.?\d+)d\z", 1).try_cast("double") * 86400
    parts = F.regexp_extract_all(value, F.lit(r"(\d*\.?\d+)(ns|us|µs|ms|s|m|h)"), F.lit(0))
    factor = F.create_map(*[x for k, v in SECONDS.items() for x in (F.lit(k), F.lit(v))])
    each = lambda p: F.regexp_extract(p, r"^([\d.]+)", 1).try_cast("double") * F.element_at(factor, F.regexp_extract(p, r"([a-zµ]+)\z", 1))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + each(p)) * F.when(value.startswith("-"), -1.0).otherwise(1.0)
    return F.coalesce(days, F.when(value.rlike(r"^[+-]?(?:\d*\.?\d+(?:ns|us|µs|ms|s|m|h))+\z"), total), F.when(value.isin("0", "+0", "-0"), 0.0))


def time_argument(value: str, now: datetime) -> str:
    """RFC3339 as it is; a relative duration as that long before now."""
    if not value:
        return ""
    if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", value):
        return value
    if m := re.fullmatch(r"([+]?\d*\.?\d+)d", value):
        seconds = float(m[1]) * 86400
    elif re.fullmatch(r"(?:\d*\.?\d+(?:ns|us|µs|ms|s|m|h))+", value):
        seconds = sum(float(n) * SECONDS[u] for n, u in re.findall(r"(\d*\.?\d+)(ns|us|µs|ms|s|m|h)", value))
    else:
        raise ValueError(f"invalid time {value!r}")
    return (now - timedelta(seconds=seconds)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def memory_bytes(value: Column) -> Column:
    v = F.lower(F.trim(value))
    unit = F.regexp_extract(v, r"([a-z]*)\z", 1)
    factor = F.element_at(F.create_map(*[x for k, n in MEMORY.items() for x in (F.lit(k), F.lit(n))]), unit)
    return F.when(v.rlike(r"^\d+(?:\.\d+)?\s*[a-z]*\z"), F.round(F.regexp_extract(v, r"^([\d.]+)", 1).try_cast("double") * factor).cast("bigint"))


def exact_bytes(n: Column) -> Column:
    """In the largest unit that divides it."""
    out = n.cast("string")
    for shift, unit in ((10, "k"), (20, "m"), (30, "g")):
        out = F.when((n > 0) & (F.pmod(n, F.lit(1 << shift)) == 0), F.concat((n / (1 << shift)).cast("bigint").cast("string"), F.lit(unit))).otherwise(out)
    return out


def human_bytes(n: Column) -> Column:
    out = F.format_string("%.1fPiB", F.bround(n / float(1 << 50), 1))
    for k, unit in reversed(list(enumerate(("KiB", "MiB", "GiB", "TiB"), 1))):
        out = F.when(n < 1 << (10 * (k + 1)), F.format_string(f"%.1f{unit}", F.bround(n / float(1 << (10 * k)), 1))).otherwise(out)
    return F.when(n < 1024, F.format_string("%dB", n.cast("bigint"))).otherwise(out)


def human_age(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    whole = lambda k: F.floor(s / k).cast("string")
    age = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(whole(60), F.lit("m"))).when(s < 86400,
        F.concat(whole(3600), F.lit("h"))).otherwise(F.concat(whole(86400), F.lit("d")))
    return F.when(seconds.isNull(), "-").otherwise(F.concat(age, F.lit(" ago")))


def short_id(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, "^sha256:", ""), 1, 12)


def container_name(names: Column, id_: Column | None = None) -> Column:
    first = F.regexp_replace(F.try_element_at(names, F.lit(1)), "^/", "")
    return F.coalesce(first, short_id(id_) if id_ is not None else F.lit(""))


def health(status: Column) -> Column:
    return F.when(status.endswith("(healthy)"), "healthy").when(status.endswith("(unhealthy)"), "unhealthy").when(status.endswith("(health: starting)"), "starting").otherwise("")


def compose_project(labels: Column) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(labels, F.lit(k)), F.lit("")) for k in PROJECT_LABELS])


def in_project(labels: Column, project: Column) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(PROJECT_LABELS[0])) == project,
        F.lit(False)) | F.coalesce(F.try_element_at(labels, F.lit(PROJECT_LABELS[1])) == project, F.lit(False))


def cpu_percent(total: Column, pre_total: Column, system: Column, pre_system: Column, online: Column, per_cpu: Column) -> Column:
    n = F.coalesce(F.nullif(online, F.lit(0)), F.nullif(per_cpu, F.lit(0)), F.lit(1)).cast("double")
    used, all_ = total - pre_total, system - pre_system
    return F.when((used > 0) & (all_ > 0), used / all_ * n * 100.0).otherwise(0.0)


def memory_used(usage: Column, stats: Column) -> Column:
    out = usage
    for key in ("inactive_file", "total_inactive_file"):
        v = F.try_element_at(stats, F.lit(key))
        out = F.when(v < usage, usage - v).otherwise(out)
    return out


def memory_percent(used: Column, limit: Column) -> Column:
    return F.when(limit > 0, used / limit * 100.0).otherwise(0.0)


def nano_cpus(nano: Column, quota: Column, period: Column) -> Column:
    return F.when(nano > 0, nano).when((quota > 0) & (period > 0), (quota.cast("bigint") * 1_000_000_000 / period).cast("bigint")).otherwise(0)


def quota_of(nano: Column) -> Column:
    """Quota for a period of 100,000 microseconds."""
    return (nano.cast("bigint") * 100_000 / 1_000_000_000).cast("bigint")


def nano_of_cpus(cpus: Column) -> Column:
    return F.round(cpus * 1_000_000_000).cast("bigint")


def log_line(ts: Column, level: Column, message: Column, name: Column | None = None) -> Column:
    at = F.coalesce(F.date_format(F.convert_timezone(None, F.lit("UTC"), ts.cast("timestamp").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("-"))
    if name is None:
        return F.format_string("%s %-7s %s", at, level, message)
    return F.when(F.coalesce(name, F.lit("")) != "", F.format_string("%s %-7s [%s] %s", at, level, name, message)).otherwise(F.format_string("%s %-7s %s", at, level, message))


def pretty_json(c: Column) -> Column:
    """Normalized JSON of objects and arrays; anything else as it is."""
    return F.when(trim_start(c).rlike(r"^[\[{]"), F.coalesce(F.to_json(F.try_parse_json(c)), c)).otherwise(c)


def trim_start(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def file_name(c: Column) -> Column:
    """A container's name as part of a file name: a leading slash goes, what file systems refuse becomes a dash."""
    # fixed values: the characters that do
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(c, F.lit("")), F.lit("container")), r"^/", ""), r'[/\\:*?"<>|]', "-")


def escaped_pattern(text: str) -> str:
    """A pattern that matches just this text."""
    return re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", text)


def redact(c: Column, secret: str) -> Column:
    return F.replace(c, F.lit(secret), F.lit("***")) if secret else c


def is_http_url(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")).isin("http", "https") & (F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")) != ""), F.lit(False))


def stable_id(*cols: Column) -> Column:
    """Eight hex digits of a hash: repeatable, unlike a random id."""
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 8)


def hosts(spec: str) -> list[tuple[str, str]]:
    """`name=addr,…`; an address may contain `=`."""
    return [(n.strip(), a.strip()) for n, _, a in (x.partition("=") for x in spec.split(",") if x.strip())]


def host_triples(spec: str) -> list[tuple[str, str, str]]:
    out = [tuple(y.strip() for y in x.split("|", 2)) for x in spec.split(",") if x.strip()]
    if any(len(x) != 3 for x in out) or len({x[0] for x in out}) < len(out):
        raise ValueError("each host needs name|url|token, once")
    return out
