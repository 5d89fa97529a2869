"""Log-shaped tables derived from the test tables, so that every operator runs on them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.functions.format import whole

# Message bodies by event_id % 16, with the level each must get.
BODIES = [
    ("ERROR request failed", "ERROR"), ('{"level":"warn","msg":"slow"}', "WARN"), ("level=info order placed", "INFO"), ("[WARN] new user", "WARN"),
    ("user: alice", "UNKNOWN"), ("at app.view(main.py:10)", "UNKNOWN"), ("severity_number=17 boom", "ERROR"), ("I0301 10:00:00 server.go:5] started", "INFO"),
    ("plain text nothing", "UNKNOWN"), ("Caused by: broken pipe", "UNKNOWN"), ('{"severity":"CRITICAL"} tail', "FATAL"), ("panic: runtime stop", "PANIC"),
    ("/app/main.go:42 +0x1d", "UNKNOWN"), ("levelname=40 late", "WARN"), ("DEBUG - cache miss", "DEBUG"), ("request went through", "UNKNOWN"),
]


def epoch_us():
    """Of `ts`, which has no zone and is taken as UTC whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_TASK = 200_000


def spread(df: DataFrame, column: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Parsing takes far longer than reading: a table is dealt out to all cores, and to as many tasks as keep them at `rows` rows, so that
    none grows with the table."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, column) if df.rdd.getNumPartitions() < tasks else df


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "event_id")
    body = F.element_at(F.array(*[F.lit(b) for b, _ in BODIES]), (F.col("event_id") % 16 + 1).cast("int"))
    name = F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))
    return e.select(
        F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"),
        F.concat(name, F.when(F.dayofmonth("ts") > 15, "-g1").otherwise("-g0")).alias("container_id"), name.alias("name"),
        F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")).alias("compose_project"), F.col("event_id").alias("rowid"),
        (epoch_us() * 1000).alias("ts_ns"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("tinyint").alias("stream"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z "), body).alias("raw"),
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = log_lines(spark, sf_dir).groupBy("host", "container_id", "name")
    return g.agg(
        F.max("compose_project").alias("compose_project"),
        whole(F.min("ts_ns"), 1_000_000).alias("first_seen_ms"), whole(F.max("ts_ns"), 1_000_000).alias("last_seen_ms"), F.sum(F.octet_length("raw")).alias("stored_bytes"),
        F.coalesce(F.max(F.when(F.col("stream") == 0, F.col("ts_ns"))), F.lit(0)).alias("stdout_wm_ns"),
            F.coalesce(F.max(F.when(F.col("stream") == 1, F.col("ts_ns"))), F.lit(0)).alias("stderr_wm_ns"),
    ).withColumns({"removed_ms": F.when(F.col("container_id").endswith("-g0"), F.col("last_seen_ms")), "image": F.concat(F.lit("img/"), "name"),
        "excluded_reason": F.lit(None).cast("string")})


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory row per customer."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        F.sha2(key.cast("string"), 256).alias("id"), F.array(F.concat(F.lit("/c"), key.cast("string"))).alias("names"),
            F.concat(F.lit("img/"), (key % 7).cast("string")).alias("image"), key.alias("created"),
        F.element_at(F.array(*[F.lit(x) for x in ("running", "exited", "paused", "restarting", "dead", "removed", "created")]), (key % 7 + 1).cast("int")).alias("state"),
        F.concat(F.lit("h"), (key % 3).cast("string")).alias("host"),
        F.when(key % 4 == 0, F.create_map(F.lit("com.docker.compose.project"), F.concat(F.lit("p"), (key % 5).cast("string"))))
        .when(key % 4 == 1, F.create_map(F.lit("io.podman.compose.project"),
            F.concat(F.lit("p"), (key % 5).cast("string")))).otherwise(F.create_map().cast("map<string,string>")).alias("labels"),
    )


def cpu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that grow by user, from events."""
    e = table(spark, sf_dir, "events")
    at = F.floor(epoch_us() / 1_000_000)
    return e.select(
        F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"), F.col("user_id").cast("string").alias("id"), (at * 100_000 + F.col("event_id")).alias("at_s"),
        (F.col("event_id") * 7 % 1000 + at).alias("total_usage"), (at * 4 + F.col("event_id") % 3).alias("system_usage"),
            F.lit(0).cast("bigint").alias("pre_total"), F.lit(0).cast("bigint").alias("pre_system"),
        F.lit(2).alias("online_cpus"), F.lit(0).alias("per_cpu"), F.col("event_id"),
    )


def engine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Die, oom, health and other actions by event_id; a die may lack its exit code, a health event its state."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    action = F.element_at(F.array(F.lit("die"), F.lit("oom"),
        F.when(k == 2, "health_status").when(k == 3, "health_status: healthy").otherwise("health_status: unhealthy"), F.lit("exec_start")),
        (F.col("event_id") % 4 + 1).cast("int"))
    code = F.when(k == 1, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("exitCode"), k.cast("string")))
    return e.select(
        F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"), F.col("event_id").cast("string").alias("id"),
            F.lit("container").alias("type"), action.alias("action"),
        code.alias("attributes"), F.lit(0).alias("time_s"), (epoch_us() * 1000).alias("time_ns"),
    )


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a look-up finds: the state of containers whose health event is bare."""
    e = table(spark, sf_dir, "events").filter("event_id % 4 = 2 AND event_id % 5 = 2")
    return e.select(F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"), F.col("event_id").cast("string").alias("container_id"),
        F.lit(None).cast("string").alias("exit_code"), F.lit(False).alias("oom_killed"), F.lit("unhealthy").alias("health"))


RULES = [
    ("r1", "errors", True, "log", [], [], [], [], "ERROR", "", 3, 3600, 7200), ("r2", "slow on h0", True, "log", ["h0"], [], [], [], "", "slow|late", 1, 60, 300),
    ("r3", "off", False, "log", [], [], [], [], "", "", 1, 60, 0), ("r4", "svc-1 warnings", True, "log", [], ["svc-1"], [], [], "WARN", "", 2, 86400, 3600),
    ("r5", "deaths", True, "event", [], [], [], ["die", "oom"], "", "", 1, 60, 300),
]


PATTERN_RULES = [(i, f"pattern {i}", True, "log", [], [], [], [], "", pattern, 1, 60, 0) for i, pattern in (
    ("p1", "(?P<x>boom)"), ("p2", "("), ("p3", "[[:digit:]]+$"), ("p4", r"\pLache\b"), ("p5", "(?i)CRITICAL|^panic"), ("p6", r"[^[:alnum:][:space:]]$"))]


def pattern_rules(spark: SparkSession) -> DataFrame:
    """With RE2's syntax, one of them no pattern."""
    from tidewater.schemas import RULES as SCHEMA

    return spark.createDataFrame(PATTERN_RULES, SCHEMA)


def rules(spark: SparkSession) -> DataFrame:
    from tidewater.schemas import RULES as SCHEMA

    return spark.createDataFrame(RULES, SCHEMA)


#: The same log lines in DuckDB's SQL.
LINES_SQL = f"""(SELECT 'h' || (user_id % 3) AS host, 'svc-' || (user_id % 5) || CASE WHEN day(ts) > 15 THEN '-g1' ELSE '-g0' END AS container_id, 'svc-' || (user_id % 5) AS name,
 'p' || (user_id % 2) AS compose_project, event_id AS rowid, epoch_us(ts) * 1000 AS ts_ns, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS stream,
 [{', '.join("'" + b + "'" for b, _ in BODIES)}][event_id % 16 + 1] AS body, [{', '.join("'" + x + "'" for _, x in BODIES)}][event_id % 16 + 1] AS level,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z ' || body AS raw, event_id % 16 AS kind FROM events)"""
