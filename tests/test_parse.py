import pytest
from pyspark.sql import functions as F

from tidewater.functions.patterns import re2_to_java
from tidewater.functions import format as fmt, parse as p

LEVELS = [
    ('{"level":"warn","msg":"x"}', "WARN"), ('{"level":30}', "INFO"), ('{"severity_text":"ERROR"}', "ERROR"), ('{"severityText":"debug"}', "DEBUG"), ('{"severityNumber":17}', "ERROR"),
    ("level=error msg=x", "ERROR"), ("severity_number=21 x", "FATAL"), ("levelname: WARNING x", "WARN"), ("[WARN] x", "WARN"), ("INFO: x", "INFO"), ("I0102 03:04:05 x", "INFO"),
    ("request failed", "ERROR"), ("a notice to all", "INFO"), ("nothing here", "UNKNOWN"), ('{"level":["error"]} fine', "ERROR"), ("", "UNKNOWN"), ("éerror x", "ERROR"), ("terror", "UNKNOWN"),
]


def test_levels(spark):
    d = spark.createDataFrame(LEVELS, "m string, want string")
    bad = d.withColumn("got", p.detect_level(F.col("m"))).filter("got <> want").collect()
    assert not bad


def test_timestamps(spark):
    rows = [
        ("2024-01-02T03:04:05.123456789Z hello", 1704164645123456789, "hello"), ("[2024-01-02 03:04:05,5] x", 1704164645500000000, "x"), ("2024/01/02 03:04:05 x", 1704164645000000000, "x"),
        ("02/Jan/2024:03:04:05 +0100 x", 1704161045000000000, "x"), ("Tue Jan  2 03:04:05 2024 x", 1704164645000000000, "x"), ("2024-01-02T03:04:05+0000 x", 1704164645000000000, "x"),
        ("no time", None, "no time"), ("", None, ""), ("2024-13-02T03:04:05Z x", None, "2024-13-02T03:04:05Z x"), ("2024-01-02T03:04:05Z [WARN] x", 1704164645000000000, "[WARN] x"),
    ]
    d = p.with_timestamp(spark.createDataFrame(rows, "raw string, ns bigint, want string"))
    for r in d.collect():
        assert (r.parsed_ns, r.rest) == (r.ns, r.want), r.raw


def test_scalars(spark):
    r = spark.range(1).select(
        fmt.memory_bytes(F.lit("1.5g")).alias("m"), fmt.memory_bytes(F.lit("x")).alias("bad"), fmt.human_bytes(F.lit(1536)).alias("h"), fmt.duration_seconds(F.lit("1h30m")).alias("d"), fmt.duration_seconds(F.lit("1.5d")).alias("days"),
        fmt.health(F.lit("Up 3 hours (healthy)")).alias("health"), fmt.short_id(F.lit("sha256:0123456789abcdef")).alias("id"), fmt.is_http_url(F.lit("https://a.b/c")).alias("url"), fmt.is_http_url(F.lit("ftp://a")).alias("nourl"),
        fmt.memory_used(F.lit(100), F.create_map(F.lit("inactive_file"), F.lit(30))).alias("used"), fmt.nano_cpus(F.lit(0), F.lit(50000), F.lit(100000)).alias("nano"),
        fmt.log_line(F.lit(None).cast("timestamp"), F.lit("INFO"), F.lit("m"), F.lit("c")).alias("line"),
    ).first()
    assert (r.m, r.bad, r.h, r.d, r.days, r.health, r.id, r.url, r.nourl, r.used, r.nano, r.line) == (1610612736, None, "1.5KiB", 5400.0, 129600.0, "healthy", "0123456789ab", True, False, 70, 500000000, "- INFO    [c] m")


def test_dialect():
    assert re2_to_java(r"(?P<a>x)$") == r"(x)\z"
    with pytest.raises(ValueError):
        re2_to_java(r"(?=x)")


# 2026-07-01 09:05:06 UTC is 1782896706 s after the epoch
NINE = 1782896706
STAMPS = [
    ("2026-07-01T09:05:06.123456789Z m", NINE, 123456789, "m"),  # RFC 3339 with nanoseconds
    ("2026-07-01T11:05:06+02:00 m", NINE, 0, "m"),  # RFC 3339
    ("2026-07-01T11:05:06.5+0200 m", NINE, 500000000, "m"),  # an offset without a colon
    ("2026-07-01T09:05:06.25 m", NINE, 250000000, "m"),  # no zone
    ("2026-07-01T09:05:06 m", NINE, 0, "m"),
    ("2026-07-01 09:05:06.123456 m", NINE, 123456000, "m"),  # a blank for the T
    ("2026-07-01 09:05:06,123 m", NINE, 123000000, "m"),  # a comma for the point
    ("2026-07-01 09:05:06 m", NINE, 0, "m"),
    ("2026/07/01 09:05:06 m", NINE, 0, "m"),  # slashes
    ("01/Jul/2026:11:05:06 +0200 m", NINE, 0, "m"),  # web servers
    ("Wed Jul  1 09:05:06 2026 m", NINE, 0, "m"),  # ANSI C
    ("Wed Jul 1 09:05:06 2026 m", NINE, 0, "m"),
    ("Wed Jul  1 09:05:06 UTC 2026 m", NINE, 0, "m"),  # Unix date
    ("Wed Jul 01 11:05:06 +0200 2026 m", NINE, 0, "m"),  # Ruby date
    ("2026-07-01T09:05:06.123456789012Z m", NINE, 123456789, "m"),  # more digits than nanoseconds
    ("2026-07-01 9:05:06 m", NINE, 0, "m"),  # hours of one digit
    ("2026-07-01T9:05:06Z m", NINE, 0, "m"),
    ("01/Jul/2026:9:05:06 +0000 m", NINE, 0, "m"),
    ("[2026-07-01T09:05:06Z] m", NINE, 0, "m"),
    ("<2026-07-01T09:05:06Z> )] m", NINE, 0, "m"),
    ("2026-07-01 09:05:06+02:00 m", NINE, 0, "+02:00 m"),  # no such layout: the zone is text
]


def test_every_layout(spark):
    d = p.with_timestamp(spark.createDataFrame(STAMPS, "raw string, s bigint, ns bigint, want string"))
    for r in d.collect():
        assert (r.parsed_ns, r.rest) == (r.s * 1_000_000_000 + r.ns, r.want), r.raw


def test_what_is_no_timestamp(spark):
    rows = [("2026-07-01 m",), ("09:05:06 m",), ("2026-07-01T25:05:06Z m",), ("2026-02-30 09:05:06 m",), ("x 2026-07-01T09:05:06Z",), ("1/Jul/2026:09:05:06 +0000 m",)]
    for r in p.with_timestamp(spark.createDataFrame(rows, "raw string")).collect():
        assert r.parsed_ns is None and r.rest == r.raw


def test_whole_lines(spark):
    rows = [
        ("2026-07-01T09:05:06Z \x1b[31mERROR\x1b[0m boom ", "ERROR", "ERROR boom"), ('2026-07-01T09:05:06Z {"level":"[error]","msg":"x"}', "ERROR", '{"level":"[error]","msg":"x"}'),
        ('{"level":["error"]} fine', "ERROR", '{"level":["error"]} fine'), ('{"level":["warn"],"severity_text":"(DEBUG)"}', "DEBUG", '{"level":["warn"],"severity_text":"(DEBUG)"}'), ('{"level":{"error":1},"severity_number":9}', "INFO", '{"level":{"error":1},"severity_number":9}'),
        ("\x1b[1;32mI0301 10:00:00 x.go:5] up\x1b[0m", "INFO", "I0301 10:00:00 x.go:5] up"), ("level=60 x", "FATAL", "level=60 x"), ("<crit> disk", "FATAL", "<crit> disk"), ("severity_number=25 x", "UNKNOWN", "severity_number=25 x"),
    ]
    for r in p.with_parsed(spark.createDataFrame(rows, "raw string, want string, text string")).collect():
        assert (r.level, r.message) == (r.want, r.text), r.raw


def test_texts(spark):
    r = spark.range(1).select(
        fmt.file_name(F.lit("/a/b:c*d?")).alias("file"), fmt.file_name(F.lit("")).alias("none"), fmt.redact(F.lit("key abc"), "abc").alias("red"), fmt.nano_of_cpus(F.lit(1.5)).alias("nano"), fmt.quota_of(F.lit(1_500_000_000)).alias("quota"),
        fmt.human_age(F.lit(7200)).alias("age"), fmt.container_name(F.array(F.lit("/web"))).alias("name"), fmt.memory_percent(F.lit(5), F.lit(0)).alias("pct"),
    ).first()
    assert (r.file, r.none, r.red, r.nano, r.quota, r.age, r.name, r.pct) == ("a-b-c-d-", "container", "key ***", 1_500_000_000, 150_000, "2h ago", "web", 0.0)
    assert fmt.escaped_pattern("a.b(c)") == r"a\.b\(c\)"


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_log_lines_show_utc(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        r = spark.range(1).select(fmt.log_line(F.timestamp_seconds(F.lit(NINE)), F.lit("WARN"), F.lit("m")).alias("x")).first()
        assert r.x == "2026-07-01T09:05:06Z WARN    m"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
