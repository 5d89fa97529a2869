"""The store's registry: equal to a count of all lines, whatever fails and is run again; retention by it."""
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import ingest, retention
from tidewater.schemas import LOG_LINES
from tidewater.sources import registry, sinks, store
from tidewater.sources.readers import follow, stored_lines
from tidewater.streaming import jobs

DAY = 86_400_000_000_000
T0 = 1782864000000000000  # 2026-07-01


def lines(spark, rows):
    return spark.createDataFrame([(h, f"{n}-g0", n, "p", i, ts, i % 2, raw) for i, (h, n, ts, raw) in enumerate(rows)], LOG_LINES)


@pytest.fixture
def rows():
    rng = random.Random(9)
    return [(rng.choice("xy"), rng.choice(["web", "web", "db"]), T0 + i * DAY // 30 + i, f"INFO line {i} " + "z" * rng.randint(0, 40)) for i in range(300)]


def facts(df):
    return sorted(map(tuple, df.select("host", "container_id", "stored_bytes", "n_lines", "stdout_wm_ns", "stderr_wm_ns").collect()))


def same(spark, path):
    return facts(registry.line_facts(spark, path)) == facts(ingest.line_facts(stored_lines(spark, path)))


def test_batches_replays_and_failures(spark, tmp_path, rows, monkeypatch):
    path, d = str(tmp_path / "s"), lines(spark, rows)
    part = lambda lo, hi: d.filter(F.col("rowid").between(lo, hi - 1))
    registry.append_batch(spark, path, part(0, 100), "q", 0)
    registry.append_batch(spark, path, part(60, 160), "q", 1)  # overlaps what is stored
    assert same(spark, path) and stored_lines(spark, path).count() == 160
    for k in (0, 1):
        registry.append_batch(spark, path, part(60 * k, 100 + 60 * k), "q", k)  # replays
    assert same(spark, path) and stored_lines(spark, path).count() == 160
    real = {x: getattr(registry, x) for x in ("append_lines", "daily_facts", "delete")}

    def broken(*_):
        raise RuntimeError("lost")

    def half(lines_, store_):
        real["append_lines"](lines_.filter("rowid % 2 = 0"), store_)
        raise RuntimeError("lost")

    for n, (name, fault) in enumerate([("daily_facts", broken), ("append_lines", broken), ("append_lines", half), ("delete", broken)]):
        lo = 160 + 30 * n
        monkeypatch.setattr(registry, name, fault)
        with pytest.raises(RuntimeError):
            registry.append_batch(spark, path, part(lo, lo + 30), "q", 2 + n)
        monkeypatch.setattr(registry, name, real[name])
        registry.append_batch(spark, path, part(lo, lo + 30), "q", 2 + n)
        assert same(spark, path) and stored_lines(spark, path).count() == lo + 30
    registry.rebase(spark, path, registry.registry(spark, path))  # deltas go into a base, which knows what it took in
    registry.append_batch(spark, path, part(250, 280), "q", 5)
    assert same(spark, path) and stored_lines(spark, path).count() == 280
    registry.append_batch(spark, path, part(270, 300), "other", 0)
    assert same(spark, path) and stored_lines(spark, path).count() == 300


def test_a_store_without_a_registry_is_counted_once(spark, tmp_path, rows):
    path, d = str(tmp_path / "s"), lines(spark, rows)
    sinks.append_lines(d.filter("rowid < 200"), path)
    registry.append_batch(spark, path, d.filter("rowid >= 150"), "q", 0)
    assert same(spark, path) and stored_lines(spark, path).count() == 300


@pytest.mark.parametrize("each, total, chunk", [(10**9, 4_000, 7), (2_000, 10**9, 7), (2_500, 6_000, 10), (1, 1, 5), (3_000, 5_500, 5000)])
def test_retention_opens_only_what_it_cuts(spark, tmp_path, rows, each, total, chunk, monkeypatch):
    path, d = str(tmp_path / "s"), lines(spark, rows)
    registry.append_batch(spark, path, d, "q", 0)
    read = []
    real = store.stored_lines
    monkeypatch.setattr(store, "_trim_days", lambda s, p, days, kept, real_=store._trim_days: read.append(set(days)) or real_(s, p, days, kept))
    cut = store.trim(spark, path, each, total, chunk)
    want = sorted(r.rowid for r in retention.trim_total(retention.trim_each(d, each), total, chunk).collect())
    assert sorted(r.rowid for r in real(spark, path).collect()) == want
    got, now = registry.registry(spark, path), real(spark, path)
    assert got.agg(F.sum("bytes")).first()[0] == (now.agg(F.sum(F.octet_length("raw"))).first()[0] or 0)
    marks = {(r.host, r.container_id): r.stdout_wm_ns for r in registry.line_facts(spark, path).collect()}
    assert marks == {(r.host, r.container_id): r.stdout_wm_ns for r in ingest.line_facts(d).collect()}  # marks outlive their lines
    if (each, total) in ((10**9, 4_000), (2_500, 6_000)) or cut == 0:
        assert cut <= sum(map(len, read))
    assert store.trim(spark, path, each, total, chunk) == 0 or chunk == 5000


def test_a_hot_host_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        d = spark.range(60_000).selectExpr("'h' host", "'c' container_id", "'n' name", "'' compose_project", "id rowid", f"{T0} + id ts_ns", "0Y stream", "sha2(cast(id as string), 256) raw")
        sinks.append_lines(d.repartition(4), str(tmp_path / "s"))
        files = [r.n for r in stored_lines(spark, str(tmp_path / "s")).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert len(files) >= 4 and max(files) < 30_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_days_come_from_folders(spark, tmp_path, rows):
    path = tmp_path / "s"
    registry.append_batch(spark, str(path), lines(spark, rows), "q", 0)
    broken = next(path.glob("day=2026-07-01/*.parquet"))
    broken.write_bytes(b"no parquet")
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    from tidewater.plans import history

    page = history.page(stored_lines(spark, str(path)), history.HistoryQuery("web", limit=5))
    assert page.count() == 5  # the newest days are enough
    assert len(store.stored_days(spark, str(path))) == 10


def test_a_late_line_opens_its_own_day(spark, tmp_path, rows):
    path, d = str(tmp_path / "s"), lines(spark, rows)
    sinks.append_lines(d, path)
    batch = d.filter("rowid IN (3, 290)").unionByName(lines(spark, [("x", "web", T0 + 1, "late")]))
    new = ingest.new_lines(batch, stored_lines(spark, path))
    assert [r.raw for r in new.collect()] == ["late"]
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (2026-07-01,2026-07-10)" in plan.replace(", ", ","), plan


def test_ingest_keeps_the_registry(spark, tmp_path, rows):
    src, path, d = str(tmp_path / "in"), str(tmp_path / "s"), lines(spark, rows)
    for i in range(3):
        d.filter(F.col("rowid").between(80 * i, 80 * i + 120)).coalesce(1).write.mode("append").parquet(src)
    jobs.ingest(follow(spark, src, files_per_trigger=1), path, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(200)
    assert same(spark, path) and stored_lines(spark, path).count() == 281
