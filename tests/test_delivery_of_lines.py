"""Subscriptions, frames, backfill, rate limits, slices and chains."""
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.operators import alerts, backfill, limits, running, subscriptions
from tidewater.sources import frames

LABELS = ("com.docker.compose.project", "io.podman.compose.project")


def test_subscriptions_equal_the_predicate(spark):
    rng = random.Random(1)
    some = lambda xs, n: [rng.choice(xs) for _ in range(rng.choice([0, 0, 1, n]))]
    specs = [(i, some("ABC", 2), some(["x", "y", "z"], 3), some(["p", "q"], 2)) for i in range(400)] + [(400, None, None, None)]
    lines = [(rng.choice(["A", "B", "D", None]), rng.choice(["x", "y", "w", ""]), {k: rng.choice("pqr") for k in LABELS if rng.random() < 0.5}, i) for i in range(120)]
    lines.append((None, None, None, 120))
    want = sorted((n, i) for i, hosts, names, projects in specs for h, name, labels, n in lines
                  if (not hosts or h in hosts) and (not names and not projects or name in (names or []) or any(p in (projects or []) for p in (labels or {}).values())))
    s = spark.createDataFrame(specs, "spec_id int, hosts array<string>, containers array<string>, projects array<string>")
    d = spark.createDataFrame(lines, "host string, container_name string, labels map<string,string>, n int")
    for most in (10**6, 0):  # by broadcast, by shuffle
        got = subscriptions.subscribed(d, s, most)
        assert sorted((r.n, r.spec_id) for r in got.collect()) == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert subscriptions.subscribed(d, s.limit(0)).count() == 0


def test_tallies_of_subscriptions_meet_no_lines(spark):
    """Counts equal those of the rows; groups of lines and of specs are joined, which a count of the joined rows shows."""
    rng = random.Random(4)
    some = lambda xs, n: [rng.choice(xs) for _ in range(rng.choice([0, 0, 1, n]))]
    specs = [(i, some("AB", 2), some(["x", "y"], 3), some(["p", "q"], 2)) for i in range(300)] + [(300, None, None, None), (301, ["none"], [], [])]
    lines = [(rng.choice(["A", "B", None]), rng.choice(["x", "y", ""]), {k: rng.choice("pq") for k in LABELS if rng.random() < 0.5}, i) for i in range(900)] + [(None, None, None, 900)]
    s = spark.createDataFrame(specs, "spec_id int, hosts array<string>, containers array<string>, projects array<string>")
    d = spark.createDataFrame(lines, "host string, container_name string, labels map<string,string>, n int")
    want = subscriptions.subscribed(d, s).groupBy("spec_id").agg(F.count("*"), F.min("n"))
    for most in (10**6, 0):
        got = subscriptions.tallies(d, s, "n", most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        joined = _largest_join(got)
        assert 0 < joined < 50_000  # some 130,000 rows of lines and specs otherwise
    assert subscriptions.tallies(d, s.limit(0), "n").count() == subscriptions.tallies(d.limit(0), s, "n").count() == 0


def _largest_join(df):
    """Most rows that a join of the plan gave, once it has run."""
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    df._jdf.queryExecution().toRdd().count()
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage") or p.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            todo.append(p.plan())
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def frame(stream, data):
    return bytes([stream, 0, 0, 0]) + len(data).to_bytes(4, "big") + data


def test_frames_equal_a_plain_loop(spark, tmp_path):
    rng = random.Random(2)
    lines = [(rng.randint(1, 2), rng.choice(["", "a", "é🙂" * 5, "x" * rng.randint(1, 40)]) + rng.choice(["", "\r"])) for _ in range(300)]
    cut = {1: [], 2: []}
    for s, t in lines:
        cut[s].append(t.encode() + b"\n")
    queues, out = {s: b"".join(x) for s, x in cut.items()}, b""
    while any(queues.values()):
        s = rng.choice([s for s in queues if queues[s]])
        n = rng.randint(0, 25)
        out, queues[s] = out + frame(s, queues[s][:n]), queues[s][n:]
    got = [(s, t) for s, t, _ in frames.decode(out + frame(2, b"rest\r"))]
    for s in (1, 2):  # lines of a stream keep their order
        assert [t for k, t in got if k == s - 1] == [t.removesuffix("\r") for k, t in lines if k == s and t] + (["rest"] if s == 2 else [])
    assert list(frames.decode(frame(1, b"ok\n") + b"\x07\0\0\0")) == [(0, "ok", None), (None, None, "broken frame at byte 11")]
    assert [(s, t) for s, t, _ in frames.decode(frame(1, b"a") + frame(1, b"b" * 9) + frame(1, b"c\n"), most=8)] == [(0, "a" + "b" * 9), (0, "c")]
    assert list(frames.decode(b"")) == []
    (tmp_path / "one").write_bytes(out)
    (tmp_path / "two").write_bytes(frame(1, b"x\n") + frame(9, b""))
    rows = frames.framed_files(spark, str(tmp_path)).collect()
    assert sum(r.raw is not None for r in rows) == len(got) - 1 + 1 and [r.error for r in rows if r.error] == ["broken frame at byte 10"]


def test_lines_of_many_files_share_batches(monkeypatch):
    files = [(f"f{i}", frame(1, b"a\r\nb%d\n" % i) + (b"x" if i == 7 else b"")) for i in range(1000)] + [("none", None), ("empty", b"")]
    given = pa.record_batch([pa.array([f for f, _ in files]), pa.array([b for _, b in files], pa.binary())], names=["path", "content"])
    want = [(f, k, *x) for f, b in files for k, x in enumerate(frames.decode(b or b""))]
    got = list(frames._lines([given, given]))
    assert len(got) == 1 and got[0].num_rows == 2 * len(want)
    for rows, size in ((64, 10**9), (10**9, 100)):
        monkeypatch.setattr(frames, "MOST_ROWS", rows)
        monkeypatch.setattr(frames, "MOST_BYTES", size)
        got = list(frames._lines([given]))
        assert len(got) > 10 and [(r["path"], r["line_no"], r["stream"], r["raw"], r["error"]) for b in got for r in b.to_pylist()] == want
    assert list(frames._lines([])) == []


def test_backfill_transitions(spark):
    """One read for each generation, three attempts, permanent exclusion, and gaps that renew the budget."""
    state = spark.createDataFrame([], backfill.STATE)
    listed = spark.createDataFrame([("h", c) for c in "abcd"], "host string, container_id string")
    outcome = "host string, container_id string, error string, permanent boolean"
    none = spark.createDataFrame([], "host string, container_id string, gap_ns bigint")

    def step(gaps, **results):
        nonlocal state
        now = backfill.schedule(state, listed, gaps)
        due = "".join(sorted(r.container_id for r in now.filter("due").collect()))
        again = backfill.schedule(now.drop("due"), listed, gaps)
        assert again.filter("due").count() == 0  # what is in flight isn't due
        done, healed = backfill.finished(now, spark.createDataFrame([("h", c, e, p) for c, (e, p) in results.items()], outcome))
        state = spark.createDataFrame(done.collect(), backfill.STATE)
        return due, sorted((r.container_id, r.gap_ns) for r in healed.collect())

    ok, fail, never = (None, None), ("timeout", False), ("no logs kept", True)
    assert step(none, a=ok, b=fail, c=never, d=fail) == ("abcd", [])
    assert step(none, b=ok, d=fail) == ("bd", [])
    assert step(none, d=fail) == ("d", [])
    assert step(none) == ("", [])  # a, b were read, c is excluded, d's budget is spent
    gaps = spark.createDataFrame([("h", "a", 77), ("h", "c", 78), ("h", "d", 79), ("h", "z", 80)], "host string, container_id string, gap_ns bigint")
    assert step(gaps, a=fail, d=ok) == ("ad", [("d", 79)])
    assert step(gaps.filter("container_id = 'a'"), a=ok) == ("a", [("a", 77)])
    assert step(none) == ("", [])
    assert {r.container_id: r.excluded_reason for r in state.collect()}["c"] == "no logs kept"


@pytest.mark.parametrize("chunk", [10**6, 9, 1])
def test_alerts_by_pointers_equal_the_state_machine(spark, chunk):
    rng = random.Random(3)
    rows, want = [], []
    for k in range(25):
        threshold, window, cooldown, t = rng.randint(1, 4), rng.choice([0, 5, 20, 100]), rng.choice([0, 1, 10, 60]), 0
        state = alerts.RuleWindow(threshold, window, cooldown)
        for i in range(rng.randint(1, 50)):
            t += rng.choice([0, 0, 1, 1, 2, 5, 30])
            rows.append((f"k{k}", t, 1000 * k + i, threshold, window, cooldown))
            if (swallowed := state.match(t)) is not None:
                want.append((f"k{k}", t, swallowed, 1000 * k + i))
    d = spark.createDataFrame(rows, "key string, at_s bigint, match_id bigint, threshold int, window_s int, cooldown_s int")
    assert sorted(map(tuple, alerts.fire(d, chunk=chunk).collect())) == sorted(want)


@pytest.mark.parametrize("chunk", [10**6, 7])
def test_windows_begin_with_a_hit(spark, chunk):
    rng = random.Random(4)
    rows, want = [], []
    for k in range(12):
        t, start, n = 0, None, 0
        for i in range(rng.randint(1, 40)):
            t += rng.choice([0, 1, 3, 9, 40])
            if start is None or t - start >= 20:
                start, n = t, 0
            n += 1
            rows.append((f"k{k}", t, 100 * k + i))
            want.append((f"k{k}", t, 100 * k + i, start, n, n <= 3))
    d = spark.createDataFrame(rows, "key string, at bigint, hit_id bigint")
    assert sorted(map(tuple, limits.fixed_windows(d, 3, 20, chunk).collect())) == sorted(want)


def test_pins(spark):
    from tidewater.operators import live

    d = spark.createDataFrame([("h", i, "ERROR" if i % 3 == 0 else "INFO") for i in range(10)], "host string, ts_ns bigint, level string")
    maps = live.index_maps(d, F.col("level") == "ERROR", ["ts_ns"], ["host"]).orderBy("ts_ns")
    assert [(r.original_index, r.filtered_index) for r in maps.collect()] == [(i, i // 3 if i % 3 == 0 else -1) for i in range(10)]
    pins = spark.createDataFrame([(6,), (1,), (9,)], "index bigint")
    step = lambda at, by: tuple(live.navigate_pins(pins, maps, at, by).first())
    assert [step(0, 1), step(1, 1), step(2, 1), step(0, -1)] == [(1, 2), (2, 3), (0, -1), (2, 3)]
    assert live.navigate_pins(pins.limit(0), maps, 0, 1).count() == 0


def test_history_stays_small(spark, tmp_path):
    path, schema = str(tmp_path / "history"), "id string, fired_at bigint"
    for k in (0, 1, 2, 2, 3):
        alerts.append_history(spark.createDataFrame([(f"{k}{i}", 100 * k + i) for i in range(4)], schema), path, k, most=6)
    kept = spark.read.parquet(path)
    assert sorted(r.batch for r in kept.select("batch").distinct().collect()) == [2, 3] and kept.count() == 8
    assert [r.fired_at for r in alerts.history(kept, 3).collect()] == [303, 302, 301]


def test_slices_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """A key with all its rows in one hour, a quiet one, rows of one time, and rows without a time."""
    monkeypatch.setattr(running, "SLICE_ROWS", 1000)
    hour = 3_600_000_000_000
    busy = spark.range(40_000).selectExpr("'busy' k", f"1782864000000000000 + cast(pow(id / 40000, 3) * {hour} as bigint) ts", "id")
    quiet = spark.range(50).selectExpr("'quiet' k", f"1782864000000000000 + id * {hour} ts", "id")
    same = spark.range(3000).selectExpr("'same' k", "5L ts", "id")
    d = busy.unionByName(quiet).unionByName(same).unionByName(spark.range(9).selectExpr("'none' k", "cast(null as bigint) ts", "id"))
    s = running.with_slices(d, ["k"], "ts")
    per = s.groupBy("k", "slice_").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("k", "slice_").collect()
    assert s.count() == d.count() and max(r.n for r in per if r.k == "busy") <= 1000 and {r.n for r in per if r.k == "same"} == {3000}
    own = [r for r in per if r.k == "busy"]
    assert all(a.hi < b.lo for a, b in zip(own, own[1:])) and len(own) < 400
    assert len([r for r in per if r.k == "quiet"]) == 3  # days
    total = running.running_sum(d, ["k"], None, ["ts", "id"], F.lit(1), "before").filter("k = 'busy'").selectExpr("max(before - id)", "min(before - id)", "count(*)").first()
    assert tuple(total) == (0, 0, 40_000)
