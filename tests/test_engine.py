"""Engines as a data source: batch and stream, with hosts that fail."""
import json

import pytest

from tidewater.operators import backfill
from tidewater.sources import engine
from tidewater.sources.readers import stored_lines
from tidewater.streaming import jobs

CLIENT = "tests.fake_engine:Client"


def put(home, now, logs=(), containers=()):
    home.mkdir(exist_ok=True)
    (home / "now").write_text(str(now))
    (home / "logs.json").write_text(json.dumps([{"container_id": "c", "name": "web", "compose_project": "", "rowid": i, "ts_ns": t, "stream": 0, "raw": x} for i, (t, x) in enumerate(logs)]))
    (home / "containers.json").write_text(json.dumps([{"id": x, "names": [f"/{x}"], "image": "i", "state": "running", "status": "Up", "labels": {"a": "b"}, "created": 1} for x in containers]))


def test_batch_and_failing_hosts(spark, tmp_path):
    put(tmp_path / "x", 100, [(1, "one"), (5, "five"), (9, "nine")], ["p", "q"])
    put(tmp_path / "y", 100, [(2, "two"), (3, "!")], ["r"])
    hosts = [(h, str(tmp_path / h)) for h in "xyz"]
    d = engine.engines(spark, hosts, CLIENT, "containers")
    assert d.rdd.getNumPartitions() == 3
    rows, errors = engine.rows_and_errors(d)
    assert sorted((r.host, r.id, r.names[0], r.labels["a"]) for r in rows.collect()) == [("x", "p", "/p", "b"), ("x", "q", "/q", "b"), ("y", "r", "/r", "b")]
    assert [(r.host, r.error) for r in errors.collect()] == [("z", "no engine at z")]
    rows, errors = engine.rows_and_errors(engine.engines(spark, hosts, CLIENT, "logs", since_ns=2, until_ns=9))
    assert sorted((r.host, r.raw) for r in rows.collect()) == [("x", "five"), ("y", "two")]  # what came before a fault stays
    failed = engine.outcomes(errors.selectExpr("host", "'c' AS container_id", "error"))
    assert sorted((r.host, r.permanent) for r in failed.collect()) == [("y", True), ("z", False)]
    state = spark.createDataFrame([(h, "c", 0, False, True, 0, None) for h in "xyz"], backfill.STATE)
    after, _ = backfill.finished(state, failed.unionByName(spark.createDataFrame([("x", "c", None, False)], "host string, container_id string, error string, permanent boolean")))
    assert sorted((r.host, r.done, r.attempts, "support" in (r.excluded_reason or "")) for r in after.collect()) == [("x", True, 0, False), ("y", False, 1, True), ("z", False, 1, False)]
    assert engine.engines(spark, [], CLIENT, "stats").count() == 0
    with pytest.raises(Exception, match="option table"):
        engine.engines(spark, hosts, CLIENT, "nothing").count()


def test_stream_into_the_store(spark, tmp_path):
    """Each line once, whatever the order in which hosts come and go; a restart goes on where it was."""
    hosts, path, cp = [(h, str(tmp_path / h)) for h in "xy"], str(tmp_path / "s"), str(tmp_path / "cp")

    def go():
        rows, _ = engine.rows_and_errors(engine.engines(spark, hosts, CLIENT, "logs", stream=True))
        q = jobs.ingest(rows, path, cp, {"processingTime": "100 milliseconds"})
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.host, r.raw) for r in stored_lines(spark, path).collect())

    put(tmp_path / "x", 4, [(1, "one"), (4, "four")])
    assert go() == [("x", "one")]  # y is down; four isn't over yet
    put(tmp_path / "x", 9, [(1, "one"), (4, "four"), (7, "seven")])
    put(tmp_path / "y", 9, [(2, "two")])
    want = [("x", "four"), ("x", "one"), ("x", "seven"), ("y", "two")]
    assert go() == want
    (tmp_path / "x").rename(tmp_path / "away")
    put(tmp_path / "y", 12, [(2, "two"), (10, "ten")])
    assert go() == sorted([*want, ("y", "ten")])
    (tmp_path / "away").rename(tmp_path / "x")
    put(tmp_path / "x", 30, [(1, "one"), (4, "four"), (7, "seven"), (20, "twenty")])
    assert go() == sorted([*want, ("y", "ten"), ("x", "twenty")])
