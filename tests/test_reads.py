"""The reads by name over a handful of rows."""
import pytest

from tidewater.plans import history, reads
from tidewater.schemas import ALERTS, LOG_LINES


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("h", "a1", "web", 10, "ERROR boom"), ("h", "a1", "web", 11, "at x.y"), ("h", "a1", "web", 12, "INFO fine"), ("h", "b2", "db", 5, "INFO boom"), ("h", "c3", "old", 1, "INFO boom"), ("g", "d4", "web", 20, "WARN late")]
    lines = spark.createDataFrame([(h, c, n, "", i, ts, 0, raw) for i, (h, c, n, ts, raw) in enumerate(rows)], LOG_LINES)
    label = {"com.docker.compose.project": "shop"}
    containers = spark.createDataFrame(
        [("a1", ["/web"], "img", "running", "h", label, 1), ("b2", ["/db"], "img", "running", "h", label, 2), ("c3", ["/old"], "img", "exited", "h", {}, 3), ("d4", ["/web"], "img", "running", "g", {}, 4)],
        "id string, names array<string>, image string, state string, host string, labels map<string,string>, created int")
    generations = spark.createDataFrame(
        [("h", "a1", "web", "shop", "img", 1, 2, None, 20, 0, 0, None), ("h", "x9", "gone", "", "img", 1, 2, 2, 7, 0, 0, None)],
        "host string, container_id string, name string, compose_project string, image string, first_seen_ms bigint, last_seen_ms bigint, removed_ms bigint, stored_bytes bigint, stdout_wm_ns bigint, stderr_wm_ns bigint, excluded_reason string")
    return reads.Tables(
        lines, containers, generations,
        images=spark.createDataFrame([("h", "sha256:0123456789abcdef", None), ("h", "b", ["x:1"])], "host string, id string, tags array<string>"),
        volumes=spark.createDataFrame([("h", "v2"), ("h", None), ("h", "v1")], "host string, name string"),
        networks=spark.createDataFrame([("h", "n", ["", "10.0.0.0/8"])], "host string, id string, subnets array<string>"),
        alert_rows=spark.createDataFrame([(f"a{i}", "r", "n", "log", "h", "c", "w", "x", "y", 1, 0, i) for i in range(5)], ALERTS))


def test_log_reads(tables):
    assert [r.message for r in reads.logs(tables, "db").collect()] == ["INFO boom"]
    assert [(r.message, r.continuation_count) for r in reads.logs(tables, "web", host="h", level="error").collect()] == [("ERROR boom\nat x.y", 1)]
    assert [r.message for r in reads.logs(tables, stack="shop", tail=1).collect()] == ["INFO boom", "INFO fine"]
    with pytest.raises(LookupError):
        reads.logs(tables, "web")
    assert [(r.container_id, r.rowid) for r in reads.grep(tables, "boom", 20).collect()] == [("b2", 3), ("a1", 0)]
    assert [r.rowid for r in reads.grep(tables, "boom", 20, since_ns=6).collect()] == [0] and reads.grep(tables, "late", 20, host="h").count() == 0
    assert [r.rowid for r in reads.search_logs(tables, "o", 20, limit=1).collect()] == [0]
    assert [(r.target_idx, r.ord) for r in reads.aggregate(tables, "g~d4~w,h~a1~v", 2).collect()] == [(1, 1), (1, 2), (0, 5)]


def test_inventory_and_history_reads(tables):
    assert sorted(r.id for r in reads.containers(tables).collect()) == ["a1", "b2", "c3", "d4"] and [r.id for r in reads.containers(tables, state="removed").collect()] == ["removed:gone"]
    assert reads.inspect(tables, "old")["state"] == "exited"
    assert sorted((r.id, r.tags) for r in reads.images(tables).collect()) == [("0123456789ab", None), ("b", ["x:1"])]
    assert sorted(r["name"] for r in reads.volumes(tables).collect()) == ["v1", "v2"] and reads.networks(tables).first().subnets == ["10.0.0.0/8"]
    assert [(r.project, r.containers) for r in reads.stacks(tables).collect()] == [("shop", 2)]
    s = reads.history_status(tables, 1).first()
    assert (s.containers, s.stored_bytes, s.oldest_ns) == (2, 27, 10)
    assert [r.message for r in reads.history_search(tables, history.HistoryQuery("web", host="h", limit=10**6)).rows.collect()] == ["ERROR boom\nat x.y", "INFO fine"]
    assert [r.id for r in reads.alert_history(tables, 2).collect()] == ["a4", "a3"]
