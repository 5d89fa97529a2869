"""The line store: what is rewritten, appended and read, and in which days."""
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import retention
from tidewater.plans import history
from tidewater.schemas import LOG_LINES
from tidewater.sources import store
from tidewater.sources.readers import follow, stored_lines
from tidewater.sources.sinks import append_lines
from tidewater.streaming import jobs

from .test_streaming import arrived

DAY = 86_400_000_000_000
T0 = 1782864000000000000  # 2026-07-01


def lines(spark, rows):
    return spark.createDataFrame([(h, f"{n}-g0", n, "", i, ts, 0, raw) for i, (h, n, ts, raw) in enumerate(rows)], LOG_LINES)


@pytest.fixture
def rows():
    rng = random.Random(7)
    return [(rng.choice("xy"), rng.choice(["web", "web", "db"]), T0 + i * DAY // 40 + i, f"INFO line {i} " + "z" * rng.randint(0, 40)) for i in range(400)]


def days_of(path):
    return {p.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.glob("*.parquet")) for p in path.glob("day=*")}


def ids(df):
    return sorted(r.rowid for r in df.collect())


def test_trim_rewrites_only_what_it_cuts(spark, tmp_path, rows):
    path, d = tmp_path / "s", lines(spark, rows)
    append_lines(d, str(path))
    before = days_of(path)
    store.trim(spark, str(path), 1_000, 10**9)
    want = ids(retention.trim_total(retention.trim_each(d, 1_000), 10**9))
    after = days_of(path)
    assert ids(stored_lines(spark, str(path))) == want and 0 < len(want) < 400
    newest = max(before)
    assert after[newest] == before[newest] and len(after) < len(before)  # days that lose nothing stay; empty ones go
    assert store.trim(spark, str(path), 1_000, 10**9) == 0 and days_of(path) == after


def test_purge(spark, tmp_path, rows):
    path = str(tmp_path / "s")
    append_lines(lines(spark, rows), path)
    n = sum(h == "x" and c == "db" for h, c, _, _ in rows)
    assert store.purge(spark, path, "x", "db") == n and stored_lines(spark, path).count() == 400 - n
    with pytest.raises(LookupError):
        store.purge(spark, path, "x", "db")


def test_backfill_appends_what_is_missing(spark, tmp_path, rows):
    path, d = str(tmp_path / "s"), lines(spark, rows)
    append_lines(d.filter("rowid < 250 AND rowid NOT BETWEEN 100 AND 120"), path)
    wm = rows[249][2]
    known = spark.createDataFrame([(h, f"{n}-g0", wm, 0, 0) for h in "xy" for n in ("web", "db")], "host string, container_id string, stdout_wm_ns bigint, stderr_wm_ns bigint, created_s bigint")
    gaps = spark.createDataFrame([(h, f"{n}-g0", rows[100][2]) for h in "xy" for n in ("web", "db")], "host string, container_id string, gap_ns bigint")
    assert store.backfill(spark, path, d, known, gaps) == 150 + 21
    assert ids(stored_lines(spark, path)) == list(range(400)) and store.backfill(spark, path, d, known, gaps) == 0
    few = spark.createDataFrame([("x", "web-g0")], "host string, container_id string")
    assert {(r.host, r["name"]) for r in store.resolvable(d, few).select("host", "name").distinct().collect()} == {("x", "web")}


def test_compaction_keeps_the_rows(spark, tmp_path, rows):
    path = tmp_path / "s"
    for k in range(5):
        append_lines(lines(spark, rows).filter(F.col("rowid") % 5 == k), str(path))
    many = sum(map(len, days_of(path).values()))
    store.compact(spark, str(path))
    assert sum(map(len, days_of(path).values())) < many and ids(stored_lines(spark, str(path))) == list(range(400))


def test_pages_read_the_newest_days(spark, tmp_path):
    """Over a hundred days, a page of the newest lines reads few of them; an entry over the edge of a day stays whole."""
    rows = [("x", "web", T0 + d * DAY + k, f"{'ERROR' if k % 3 == 0 else 'INFO'} line {d} {k}") for d in range(100) for k in range(1, 8)]
    rows += [("x", "web", T0 + 99 * DAY - 2, "ERROR head"), ("x", "web", T0 + 99 * DAY - 1, "at a.b"), ("x", "web", T0 + 99 * DAY, "at c.d")]
    path, d = str(tmp_path / "s"), lines(spark, rows)
    append_lines(d, path)
    kept = stored_lines(spark, path)
    q = history.HistoryQuery("web", levels=["ERROR"], limit=4)
    want = [(r.rowid, r.message) for r in history.page(d, q).collect()]
    assert [(r.rowid, r.message) for r in history.page(kept, q).collect()] == want and want[1][1] == "ERROR head\nat a.b\nat c.d"
    a, b = history.fetch(d, q), history.fetch(kept, q)
    assert a.next_cursor == b.next_cursor and [r.rowid for r in b.rows.collect()] == [i for i, _ in want]
    plan = history.newest_days(kept, q, 3)._jdf.queryExecution().optimizedPlan().toString()
    bound = history.scan(kept, history.HistoryQuery("web", since_ns=T0 + 97 * DAY))._jdf.queryExecution().executedPlan().toString()
    assert "2026-10" in plan and "PartitionFilters: [isnotnull(day" in bound


def test_history_hands_over_to_live(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [("x", "web", T0 + i, f"l{i}") for i in range(10)]
    append_lines(lines(spark, rows), path)
    seen, live = jobs.hand_over(spark, path, [("x", "web-g0", "w"), ("x", "new-g0", "n")], 3)
    assert ids(seen) == [7, 8, 9]
    q = live.writeStream.format("memory").queryName("handed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        append_lines(spark.createDataFrame([("x", "web-g0", "web", "", 10, T0 + 10, 0, "l10"), ("x", "new-g0", "new", "", 11, T0, 0, "n"), ("x", "other-g0", "other", "", 12, T0 + 50, 0, "o")], LOG_LINES), path)
        q.processAllAvailable()
        assert ids(spark.table("handed")) == [10, 11]
    finally:
        q.stop()


def test_retention_runs_within_the_stream(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "s")
    d = lines(spark, [("x", "web", T0 + i * DAY, "y" * 400_000) for i in range(4)])
    for i in range(4):
        d.filter(F.col("rowid") == i).coalesce(1).write.mode("append").parquet(src)
    jobs.ingest(follow(spark, src, files_per_trigger=1), path, str(tmp_path / "cp"), {"availableNow": True}, caps_mb=(1, 1), retain_every=2).awaitTermination(300)
    left = stored_lines(spark, path).agg(F.sum(F.octet_length("raw"))).first()[0]
    assert left <= 1 << 20


def test_streamed_ooms_and_lifecycle(spark, tmp_path):
    schema = "host string, container_id string, what string, at_s bigint"
    src = str(tmp_path / "e")
    spark.createDataFrame([("h", "a", "oom", 100), ("h", "a", "die", 105), ("h", "a", "die", 111), ("h", "b", "die", 105), ("h", "a", "die", 99)], schema).coalesce(1).write.parquet(src)
    q = jobs.with_last_oom(spark.readStream.schema(schema).parquet(src), "0 seconds").writeStream.format("memory").queryName("ooms").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert sorted((r.container_id, r.what, r.at_s, r.last_oom or 0) for r in arrived(spark, q, "ooms", 5)) == [("a", "die", 99, 0), ("a", "die", 105, 100), ("a", "die", 111, 0), ("a", "oom", 100, 100), ("b", "die", 105, 0)]
    raw = spark.createDataFrame([("h", str(i), "container", a, {}, 5, 0) for i, a in enumerate(("create", "exec_start", "rename", "oom", "pause"))], "host string, id string, type string, action string, attributes map<string,string>, time_s bigint, time_ns bigint")
    assert sorted(r.action for r in jobs.lifecycle(raw).collect()) == ["create", "pause", "rename"]
    got = jobs.collected(spark.readStream.schema(schema).parquet(src), str(tmp_path / "box"), 10)
    assert got.count() == 5
