"""Statistics and alert windows, against plain definitions, with a key that holds most rows and values that repeat."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import alerts, delivery, inventory, running
from tidewater.schemas import RULES
from tidewater.sources import readers


def test_percentiles_are_exact(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([5.0, 5.0, rng.random() * 100])) for _ in range(3000)] + [("few", 1.0), ("few", 2.0), ("one", 7.0), (None, 3.0), ("none", None)]
    rows += [("wide", math.exp(rng.gauss(0, 9))) for _ in range(2000)] + [("same", 4.0)] * 500
    d = spark.createDataFrame(rows, "k string, v double")
    for accuracy in (10_000, 20):
        got = {r.k: (r.p0, r.p50, r.p95, r.p99, r.p100, r.max, r.n) for r in inventory.nearest_rank(d, "v", ["k"], [0.0, 0.5, 0.95, 0.99, 1.0], accuracy).collect()}
        want = {}
        for k in {k for k, v in rows if v is not None}:
            v = sorted(x for j, x in rows if j == k and x is not None)
            want[k] = (*[v[max(math.ceil(p * len(v)), 1) - 1] for p in (0.0, 0.5, 0.95, 0.99, 1.0)], v[-1], len(v))
        assert got == want


def test_rows_before_and_rates(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), t, rng.randint(0, 50)) for t in rng.sample(range(100_000), 400)]
    d = spark.createDataFrame(rows, "k string, at bigint, v bigint")
    want, last = {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        want[at] = None if k not in last else (v - last[k][1]) / (at - last[k][0])
        last[k] = (at, v)
    for width in (500, 86_400, 10**9):
        assert {r["at"]: r.rate for r in inventory.rates(d, "v", "at", ["k"], width).collect()} == pytest.approx(want)
    e = {r.k: (r.peak, r.first, r.last) for r in inventory.extent(d, "v", "at", ["k"]).collect()}
    mine = sorted((at, v) for k, at, v in rows if k == "a")
    assert e["a"] == (max(v for _, v in mine), mine[0][1], mine[-1][1])


def test_no_window_is_over_a_raw_key(spark):
    d = spark.createDataFrame([("h", "c", 1, 2.0)], "host string, id string, at bigint, value double")
    for out in (inventory.sparkline(d, "value"), inventory.rates(d, "value", "at", ["host"]), inventory.nearest_rank(d, "value", ["host"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in (x for x in plan.split("\n") if "Window [" in x):
            assert "slice_" in line, line  # partitions are slices, or the windows go over one row a slice


def test_thresholds_by_number(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["noisy", "noisy", "quiet"]), rng.randint(0, 5000), i, rng.choice([1, 2, 5]), 40) for i in range(500)]
    rows = [(k, at, i, {"noisy": 5, "quiet": 2}[k], w) for k, at, i, _, w in rows] + [("single", 9, 999, 1, 40)]
    d = spark.createDataFrame(rows, "key string, at_s bigint, match_id bigint, threshold int, window_s int")
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((at, i, n, w) for key, at, i, n, w in rows if key == k)
        for j, (at, i, n, w) in enumerate(mine):
            want[i] = j >= n - 1 and at - mine[j - n + 1][0] <= w
    for width in (50, 86_400):
        assert {r.match_id: r.trips for r in alerts.count_in_window(d, slice_s=width).collect()} == want


def test_ooms_before_deaths(spark):
    rng = random.Random(4)
    rows = [("h", rng.choice("ab"), rng.choice(["oom", "die"]), rng.randint(-30, 300)) for _ in range(200)]
    got = sorted((r.container_id, r.what, r.at_s, r.last_oom) for r in alerts.with_last_oom(spark.createDataFrame(rows, "host string, container_id string, what string, at_s bigint")).filter("last_oom IS NOT NULL").collect())
    want = sorted((c, w, t, m) for _, c, w, t in rows if (m := max((u for _, d, x, u in rows if x == "oom" and d == c and 0 <= t - u <= 10), default=None)) is not None)
    assert got == want


def test_limits_are_errors(spark):
    rule = lambda i: (f"r{i}", "n", True, "log", [], [], [], [], "", "", 1, 60, 300)
    assert alerts.compiled(spark.createDataFrame([rule(i) for i in range(50)], RULES), "log").count() == 50
    with pytest.raises(ValueError, match="over 50 rules"):
        alerts.compiled(spark.createDataFrame([rule(i) for i in range(51)], RULES), "log")
    a = spark.createDataFrame([("a", "r", "n", "log", "h", "c", "w", "x", "y", 1, 0, 5)], "id string, rule_id string, rule_name string, type string, host string, container_id string, container_name string, reason string, sample string, count int, suppressed int, fired_at bigint")
    with pytest.raises(ValueError, match="over 20 channels"):
        delivery.requests(a, spark.createDataFrame([(f"c{i}", "webhook", "w", True, "http://x", "", "") for i in range(21)], delivery.CHANNELS))


def test_a_changed_rule_has_another_version(spark):
    base = ["r", "n", True, "log", ["h"], [], [], [], "ERROR", "x", 1, 60, 300]
    version = lambda r: alerts.compiled(spark.createDataFrame([tuple(r)], RULES), "log").first().rule_version
    same, seen = version([*base[:1], "renamed", *base[2:]]), {version(base)}
    assert same in seen
    for at, value in ((4, ["g"]), (5, ["c"]), (6, ["p"]), (8, "WARN"), (9, "y"), (10, 2), (11, 61), (12, 1)):
        seen.add(version([*base[:at], value, *base[at + 1 :]]))
    assert len(seen) == 9


def test_settings_keep_the_first(spark, tmp_path):
    (tmp_path / "s.json").write_text("[" + ",".join(f'{{"a": {i}}}' for i in range(9)) + "]")
    assert [r.a for r in readers.settings(spark, str(tmp_path / "s.json"), "a: int", 4).collect()] == [0, 1, 2, 3]
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.settings(spark, str(tmp_path / "bad.json"), "a: int", 4).count() == 0


def test_running_sums_without_keys(spark):
    d = spark.createDataFrame([(i, i % 4) for i in range(50)], "i int, v int")
    got = {r.i: r.before for r in running.running_sum(d, [], F.floor(F.col("i") / 7), ["i"], F.col("v"), "before").collect()}
    assert got == {i: sum(j % 4 for j in range(i)) for i in range(50)}


def test_deliveries_are_tried_twice(spark):
    calls = []

    def send(r):
        calls.append(sorted(x.channel_id for x in r.collect()))
        status = {"ok": 200, "down": 503, "bad": 400}
        rows = [(x.alert_id, x.channel_id, status[x.channel_id] if len(calls) < 2 else 200, None) for x in r.collect()]
        return spark.createDataFrame(rows, "alert_id string, channel_id string, http_status int, error string")

    reqs = spark.createDataFrame([("a", c, "") for c in ("ok", "down", "bad")], "alert_id string, channel_id string, secret string")
    out = {r.channel_id: (r.status, r.attempts) for r in delivery.delivered(reqs, send).collect()}
    assert out == {"ok": ("ok", 1), "down": ("ok", 2), "bad": ("failed", 1)} and calls == [["bad", "down", "ok"], ["down"]]
