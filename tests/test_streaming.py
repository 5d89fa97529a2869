import random
import time

from tidewater.operators.fold import parse
from tidewater.operators import alerts
from tidewater.schemas import LOG_LINES, RULES
from tidewater.sources.readers import env_changes, env_pairs, follow, stored_lines
from tidewater.streaming import jobs


def _lines(spark, rows):
    return spark.createDataFrame([("h", "c", "n", "", i, ts, 0, raw) for i, ts, raw in rows], LOG_LINES)


def arrived(spark, query, name, n):
    """Rows of a memory sink, once there are n. State that expires by the clock keeps a query running, even with availableNow."""
    try:
        for _ in range(300):
            rows = spark.table(name).collect()
            if len(rows) >= n or query.exception():
                break
            time.sleep(0.4)
        return rows
    finally:
        query.stop()


def test_ingest_twice_adds_nothing(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    _lines(spark, [(0, 1000, "a"), (1, 2000, "b")]).write.parquet(src)
    for k in range(2):  # the second run starts without the first one's checkpoint
        jobs.ingest(follow(spark, src), store, str(tmp_path / f"cp{k}"), {"availableNow": True}).awaitTermination(120)
    assert stored_lines(spark, store).count() == 2


def test_alert_stream(spark, tmp_path):
    src = str(tmp_path / "m")
    schema = "key string, at_s bigint, match_id bigint, threshold int, window_s int, cooldown_s int"
    spark.createDataFrame([("k", t, i, 1, 60, 300) for i, t in enumerate([1000, 1010, 1020, 1301, 1310, 1602])], schema).coalesce(1).write.parquet(src)
    q = jobs.fire(spark.readStream.schema(schema).parquet(src), "0 seconds").writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert sorted((r.at_s, r.suppressed) for r in arrived(spark, q, "fired", 3)) == [(1000, 0), (1301, 2), (1602, 1)]


def _streamed(spark, tmp_path, name, batches, schema, of):
    """Rows of a stream whose micro-batches are given, with one row far ahead that moves the watermark past all."""
    src = str(tmp_path / name)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / f"{name}-out")
    of(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start().awaitTermination(300)
    return spark.read.parquet(out)


def test_streams_equal_batch_for_every_order_of_arrival(spark, tmp_path):
    """Within the watermark's delay."""
    rng = random.Random(5)
    schema = "host string, container_id string, what string, at_s bigint"
    events = [("h", rng.choice("ab"), rng.choice(["oom", "die", "die"]), 1000 + rng.randrange(120)) for _ in range(60)] + [("h", "c", "oom", 1010), ("h", "c", "oom", 1030), ("h", "c", "die", 1015)]
    mixed = sorted(events, key=lambda r: r[3] + rng.randrange(40))
    assert mixed != sorted(events, key=lambda r: r[3])
    batches = [mixed[:20], mixed[20:41], mixed[41:], [("h", "far", "die", 9999)], [("h", "far", "die", 19999)]]
    d = _streamed(spark, tmp_path, "ooms", batches, schema, lambda s: jobs.with_last_oom(s, "200 seconds")).filter("container_id <> 'far'")
    want = alerts.with_last_oom(spark.createDataFrame(events, schema))
    row = lambda r: (r.container_id, r.what, r.at_s, r.last_oom or 0)
    assert sorted(map(row, d.collect())) == sorted(map(row, want.collect()))

    schema = "key string, at_s bigint, match_id bigint, threshold int, window_s int, cooldown_s int"
    times = sorted(1000 + rng.randrange(300) for _ in range(60))
    matches = [(k, t, 100 * "ab".index(k) + i, 2, 20, 30) for k in "ab" for i, t in enumerate(times)]
    mixed = sorted(matches, key=lambda r: r[1] + rng.randrange(60))
    batches = [mixed[:40], mixed[40:80], mixed[80:], [("far", 9999, 999, 9, 20, 30)], [("far", 19999, 999, 9, 20, 30)]]
    got = _streamed(spark, tmp_path, "fire", batches, schema, lambda s: jobs.fire(s, "400 seconds"))
    want = alerts.fire(spark.createDataFrame(matches, schema))
    row = lambda r: (r.key, r.at_s, r.match_id, r.suppressed)
    assert sorted(map(row, got.collect())) == sorted(map(row, want.collect())) and want.count() > 5


def test_rules_are_reloaded_while_streams_run(spark, tmp_path):
    """Unchanged rules keep their state, changed ones begin anew, and alerts of rules that are gone are dropped."""
    rule = lambda i, **more: tuple((dict(id=i, name=i, enabled=True, type="log", hosts=[], containers=[], projects=[], events=[], min_level="", pattern="boom", threshold=2,
        window_s=3600, cooldown_s=1) | more).values())
    rules, src, found, history = (str(tmp_path / x) for x in ("rules", "lines", "matches", "history"))
    edit = lambda *rows: spark.createDataFrame(rows, RULES).coalesce(1).write.mode("overwrite").json(rules)
    now = lambda: spark.read.schema(RULES).json(rules)
    schema = "host string, container_id string, container_name string, labels map<string,string>, level string, message string, raw string, match_id bigint, at_s bigint"
    line = lambda i, at, text="boom": ("h", "c", "n", {}, "INFO", text, text, i, at)

    def run(k, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b={k}")
        jobs.match_stream(spark.readStream.schema(schema).parquet(src), now, found, str(tmp_path / "cp1"), {"availableNow": True}).awaitTermination(200)
        kind = spark.read.parquet(found).drop("batch").schema
        jobs.alert_stream(spark, found, kind, now, history, str(tmp_path / "cp2"), {"availableNow": True}, "0 seconds").awaitTermination(200)

    edit(rule("kept"), rule("changed"), rule("gone", threshold=1), rule("bad", pattern="("))
    run(0, line(1, 1000))
    edit(rule("kept"), rule("changed", window_s=60), rule("new", pattern="(?P<x>late)", threshold=1))
    run(1, line(2, 1005), line(3, 1006, "late"))
    got = spark.read.parquet(history)
    assert sorted((r.rule_id, r.fired_at) for r in got.collect()) == [("gone", 1000), ("kept", 1005), ("new", 1006)]


def test_env_files(spark):
    d = env_pairs(spark.createDataFrame([("A=1",), ("# x",), ("",), ("B='q=r'",), ("=no",)], "value string"))
    assert sorted(map(tuple, d.collect())) == [("A", "1"), ("B", "q=r")]
    new = spark.createDataFrame([("A", "2"), ("C", "3")], "key string, value string")
    assert sorted((r.key, r.change) for r in env_changes(d, new).collect()) == [("A", "set"), ("B", "delete"), ("C", "set")]


def test_followed_lines_are_not_folded(spark):
    d = jobs.follow_parsed(_lines(spark, [(0, 1, "ERROR a"), (1, 2, "at x.y")]), level="unknown")
    assert [r.raw for r in d.collect()] == ["at x.y"]
    assert parse(_lines(spark, [(0, 1, "ERROR a")])).first().severity == 5
