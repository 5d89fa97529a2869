import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import alerts, fold, ingest, inventory, live, retention
from tidewater.plans import history, queries
from tidewater.schemas import LOG_LINES
from tidewater.sources import adapters


def lines(spark, rows):
    """rows: name, container_id, ts_ns, raw."""
    return spark.createDataFrame([("h", c, n, "", i, ts, 0, raw) for i, (n, c, ts, raw) in enumerate(rows)], LOG_LINES)


def naive_fold(rows):
    """Line by line, by the rule."""
    out = []
    for level, message, cid in rows:
        prev = out[-1] if out else None
        field = message.startswith("key: ")
        stack = message.startswith("at ")
        ok = prev and prev[2] == cid and level == "UNKNOWN" and message.strip() and prev[1][-1].strip() and (field or stack and prev[0] in ("WARN", "ERROR", "FATAL", "PANIC"))
        if ok:
            prev[1].append(message)
        else:
            out.append((level, [message], cid))
    return [(lv, "\n".join(m), len(m) - 1) for lv, m, _ in out]


def test_fold_equals_the_rule_across_slices(spark):
    rng = random.Random(3)
    kinds = [("ERROR", "ERROR boom"), ("INFO", "INFO fine"), ("UNKNOWN", "key: value"), ("UNKNOWN", "at x.y"), ("UNKNOWN", "plain"), ("UNKNOWN", "")]
    rows, want = [], {}
    for k in range(12):
        seq = [(*rng.choice(kinds), rng.choice(["a", "a", "a", "b"])) for _ in range(40)]
        rows += [(f"n{k}", cid, 1000 * i + 1, m) for i, (_, m, cid) in enumerate(seq)]
        want[f"n{k}"] = naive_fold(seq)
    d = fold.fold(fold.parse(lines(spark, rows)), slice_ns=5000)
    got = {}
    for r in d.orderBy("name", "ts_ns", "rowid").collect():
        got.setdefault(r["name"], []).append((r.level, r.message, r.continuation_count))
    assert got == want


def test_fields_last_wins(spark):
    d = fold.fold(fold.parse(lines(spark, [("n", "c", 1, "INFO head"), ("n", "c", 2, "a: 1"), ("n", "c", 3, "a: 2"), ("n", "c", 4, "b = x")])))
    assert d.first().fields == {"a": "2", "b": "x"}


def test_filter_is_after_the_fold_and_pages_walk(spark):
    rows = [("n", "c", i * 10, f"INFO line {i}") for i in range(25)] + [("n", "c", 1000, "ERROR boom"), ("n", "c", 1001, "at a.b"), ("n", "c", 1002, "at c.d")]
    d = lines(spark, rows)
    e = history.page(d, history.HistoryQuery("n", levels=["ERROR"])).collect()
    assert [(r.continuation_count, r.message.count("\n")) for r in e] == [(2, 2)]
    seen, cursor = [], ""
    for _ in range(5):
        p = history.fetch(d, history.HistoryQuery("n", search="LINE", limit=10, cursor=cursor))
        seen = [r.message for r in p.rows.collect()] + seen
        cursor = p.next_cursor
        if not cursor:
            break
    assert seen == [f"INFO line {i}" for i in range(25)]
    with pytest.raises(ValueError):
        history.decode_cursor("!!")


def test_pushdown(spark, tmp_path):
    lines(spark, [("n", "c", 1, "INFO x")]).write.parquet(str(tmp_path / "l"))
    plan = history.entries(spark.read.parquet(str(tmp_path / "l")), history.HistoryQuery("n", since_ns=5, levels=["ERROR"]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_ns,5)" in plan and "EqualTo(name,n)" in plan


def test_retention(spark):
    rng = random.Random(1)
    rows = [(f"n{i % 3}", "c", i * 7, "x" * rng.randint(1, 60)) for i in range(300)]
    got = {(r["name"], r.rowid) for r in retention.trim_each(lines(spark, rows), 1500, slice_ns=300).collect()}
    want = set()
    for n in ("n0", "n1", "n2"):
        mine = [(i, len(r[3])) for i, r in enumerate(rows) if r[0] == n]
        total = sum(b for _, b in mine)
        for i, b in mine:
            if total > 1500:
                total -= b
            else:
                want.add((n, i))
    assert got == want
    left = retention.trim_total(lines(spark, rows), 4000, chunk_rows=10)
    assert left.agg(F.sum(F.octet_length("raw"))).first()[0] <= 4000
    with pytest.raises(ValueError):
        retention.check_limits(5, 1)
    with pytest.raises(LookupError):
        retention.purge(lines(spark, rows), "h", "none")


CASES = [
    ((3, 60, 300), [0, 1, 2], [(2, 0)]), ((3, 60, 300), [0, 1], []), ((3, 60, 300), [0, 30, 90, 100, 110], [(110, 0)]),
    ((1, 60, 300), [0, 10, 20, 301, 310, 602], [(0, 0), (301, 2), (602, 1)]), ((2, 60, 1), [0, 1, 3, 4], [(1, 0), (4, 0)]),
]


def test_alert_state(spark):
    rows = [(f"k{k}", t, 100 * k + i, *par) for k, (par, times, _) in enumerate(CASES) for i, t in enumerate(times)]
    d = spark.createDataFrame(rows, "key string, at_s bigint, match_id bigint, threshold int, window_s int, cooldown_s int")
    got = {}
    for r in alerts.fire(d).orderBy("key", "at_s").collect():
        got.setdefault(r.key, []).append((r.at_s, r.suppressed))
    assert got == {f"k{k}": w for k, (_, _, w) in enumerate(CASES) if w}


def test_events(spark):
    ev = spark.createDataFrame([
        ("h", "c1", "/a", "die", "die", "137", "", {}, 100), ("h", "c1", "/a", "oom", "oom", "", "", {}, 95), ("h", "c2", "/b", "die", "die", "0", "", {}, 100),
        ("h", "c3", "/c", "die", "die", "", "", {}, 100), ("h", "c4", "/d", "health_status: unhealthy", "health_status", "", "unhealthy", {}, 100), ("h", "c5", "/e", "health_status", "health_status", "", "", {}, 1),
    ], "host string, container_id string, container_name string, action string, base string, exit_code string, health_status string, labels map<string,string>, at_s bigint")
    none = spark.createDataFrame([], "host string, container_id string, exit_code string, oom_killed boolean, health string")
    ok = alerts.alertable(ev, none)
    assert sorted((r.container_id, r.what, r.exit_code) for r in ok.collect()) == [("c1", "die", "137"), ("c1", "oom", ""), ("c3", "die", "unknown"), ("c4", "unhealthy", "")]
    from tidewater.sources.adapters import rules

    m = alerts.event_matches(rules(spark), ok)
    assert sorted((r.container_id, r.what) for r in m.collect()) == [("c1", "oom"), ("c3", "die")]


def test_ingest_and_merge(spark):
    stored = lines(spark, [("n", "c", 1, "a"), ("n", "c", 2, "b")])
    batch = lines(spark, [("n", "c", 2, "b"), ("n", "c", 3, "c"), ("n", "c", 3, "c")])
    assert [r.raw for r in ingest.new_lines(batch, stored).collect()] == ["c"]
    d = spark.createDataFrame([(1, 0, 5, "x"), (0, 1, 5, "y"), (0, 0, None, "z"), (0, 2, 5, "w")], "target_idx int, ord int, ts_ns bigint, m string")
    assert [r.m for r in live.merge_targets(d).collect()] == ["z", "y", "w", "x"]
    assert live.tail_size("x") == 10_000 and live.tail_size("") == 100 and live.tail_size("-5") == 10_000
    with pytest.raises(ValueError):
        live.targets("")


def test_resolution(spark):
    c = spark.createDataFrame([("abc1", ["/web"], "h"), ("abc2", ["/db"], "h"), ("web9", ["/x"], "h")], "id string, names array<string>, host string")
    assert inventory.resolve_one(c, "web")["id"] == "abc1"
    with pytest.raises(LookupError):
        inventory.resolve_one(c, "abc")


def test_filters_on_parsed_columns_parse_once(spark):
    d = fold.parse(lines(spark, [("n", "c", 1, "ERROR boom"), ("n", "c", 2, "INFO boom"), ("n", "c", 3, ""), ("n", "c", 4, "error: late")]))
    cond = live.live_match("error", "boom")
    got = live.keep(d.filter(live.streams()), cond)
    assert got.columns == d.columns and sorted(r.ts_ns for r in got.collect()) == sorted(r.ts_ns for r in d.filter(cond).collect()) == [1]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")  # the filter stays above the parsing


def test_lines_are_parsed_once_for_entries(spark):
    """What reads entries or lines several times reads what was written, and doesn't parse again."""
    d = lines(spark, [("n", "c", 1, "ERROR boom"), ("n", "c", 2, "at x"), ("n", "c", 3, "INFO fine")])
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    e = fold.folded(d)
    assert "get_json_object" in plan(fold.parse(d)) and "get_json_object" not in plan(e)
    assert sorted((r.rowid, r.continuation_count) for r in e.collect()) == [(0, 1), (2, 0)]
    r = live.raw_ranges(e, ["host", "name"], ["ts_ns", "rowid"])
    assert "collect_list" in plan(e) and "collect_list" not in plan(r)
    assert sorted((x.rowid, x.raw_first, x.raw_last) for x in r.collect()) == [(0, 0, 1), (2, 2, 2)]


def test_alerts_read_matches_that_were_parsed_once(spark):
    plan = queries.QUERIES["alert_fired"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan


def test_tasks_of_parsing_hold_a_bounded_number_of_rows(spark):
    d = spark.range(1000, numPartitions=5)
    assert adapters.spread(d, "id", rows=100).rdd.getNumPartitions() == 10
    assert adapters.spread(d, "id").rdd.getNumPartitions() == 5
    assert adapters.spread(spark.range(10, numPartitions=1), "id").rdd.getNumPartitions() == 4
