"""Searches that leave days closed: what they find, and which days they open."""
import random
import re
from datetime import date

import pytest

from tidewater.functions.patterns import re2_to_java
from tidewater.plans import history
from tidewater.sources import skips, store
from tidewater.sources.readers import stored_lines
from tidewater.sources.sinks import append_lines

from .test_store import DAY, T0, days_of, lines


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """60 days; entries with the word lie within a day, over the edge of a day, and over days without a head of their own."""
    rng = random.Random(3)
    rows = [("x", "web", T0 + d * DAY + k * 1000, rng.choice(["INFO ping", "ERROR went wrong", "at a.b", "plain words"])) for d in range(60) for k in range(1, 5) if d not in (31, 32)]
    rows += [("x", "web", T0 + 10 * DAY + 9000, "ERROR Zebra 7"), ("x", "web", T0 + 20 * DAY - 2, "ERROR head"), ("x", "web", T0 + 20 * DAY - 1, "at zebra.b"), ("x", "web", T0 + 20 * DAY, "at quagga.d"),
             ("x", "web", T0 + 30 * DAY + 9000, "ERROR long"), *[("x", "web", T0 + d * DAY + k, f"at long.{d}") for d in (31, 32) for k in range(3)], ("x", "web", T0 + 32 * DAY + 50, "at zebra.last"), ("x", "web", T0 + 33 * DAY, "at long.after"),
             ("x", "web", T0 + 50 * DAY + 77, "WARN Kiwi aſ İbis"), ("x", "db", T0 + 5 * DAY + 77, "INFO zebra of another"), ("x", "web", T0 + 59 * DAY + 9000, "ERROR zebra"), ("x", "web", T0, "at zebra")]
    path = tmp_path_factory.mktemp("skips") / "s"
    d = lines(spark, rows).persist()
    append_lines(d.repartition(1), str(path))
    skips.write(spark, str(path))
    return d, path


def same(d, kept, q):
    want = [(r.rowid, r.message) for r in history.page(d, q).collect()]
    assert [(r.rowid, r.message) for r in history.page(kept, q).collect()] == want
    return want


def test_the_same_rows_from_few_days(spark, stored, monkeypatch):
    d, path = stored
    kept, read = stored_lines(spark, str(path)), set()
    of_runs = history._of_runs

    def noted(lines, q, runs, days, slice_ns):
        read.update(days[i] for r in runs for i in range(r.lo, r.hi + 1))
        return of_runs(lines, q, runs, days, slice_ns)

    monkeypatch.setattr(history, "_of_runs", noted)
    Q = history.HistoryQuery
    assert {(x - date(2026, 7, 1)).days for x in skips.days_to_open(kept, "web", ["zebra"])} == {0, 10, 19, 32, 59}
    assert len(same(d, kept, Q("web", search="zebra", limit=50))) == 5 and 0 < len(read) < 25
    read.clear()
    q = Q("web", search="ZEBRA", limit=2)
    a, b = history.fetch(d, q), history.fetch(kept, q)
    assert a.next_cursor == b.next_cursor != "" and sorted(r.rowid for r in a.rows.collect()) == sorted(r.rowid for r in b.rows.collect())
    assert min(read) > date(2026, 7, 5)  # the oldest candidate, the first day, is not needed
    same(d, kept, Q("web", host="x", search="quagga", until_ns=T0 + 30 * DAY, limit=3))
    same(d, kept, Q("web", search="zebra", since_ns=T0 + 20 * DAY, until_ns=T0 + 32 * DAY + 60))
    assert same(d, kept, Q("web", search=r"zebra\.\w+", regex=True, levels=["error"]))
    assert len(same(d, kept, Q("web", search="kiwi as ibis$", regex=True))) == 1
    read.clear()
    assert not same(d, kept, Q("web", search="nowhere at all")) and not read


def test_appended_days_are_opened_until_their_set_is_written(spark, stored, tmp_path):
    _, path = stored
    other = str(tmp_path / "s")
    append_lines(stored_lines(spark, str(path)).filter("day < '2026-07-15'").drop("day"), other)
    assert skips.days_to_open(stored_lines(spark, other), "web", ["zebra"]) is None
    store.compact(spark, other)
    assert skips.days_to_open(stored_lines(spark, other), "web", ["zebra"]) == {date(2026, 7, 1), date(2026, 7, 11)}
    append_lines(lines(spark, [("x", "web", T0 + 3 * DAY, "INFO late zebra")]).withColumnRenamed("rowid", "r").selectExpr("host", "container_id", "name", "compose_project", "r + 100000 AS rowid", "ts_ns", "stream", "raw"), other)
    kept = stored_lines(spark, other)
    assert skips.days_to_open(kept, "web", ["nowhere"]) == {date(2026, 7, 4)} and skips.days_to_open(kept, "web", ["no", "é!x"]) is None
    assert "INFO late zebra" in [r.message for r in history.page(kept, history.HistoryQuery("web", search="zebra")).collect()]
    store.compact(spark, other, [date(2026, 7, 4)])
    kept = stored_lines(spark, other)
    assert skips.days_to_open(kept, "web", ["zebra"]) == {date(2026, 7, 1), date(2026, 7, 4), date(2026, 7, 11)} and skips.days_to_open(kept, "web", ["nowhere"]) == set()
    assert len(days_of(tmp_path / "s")) == 14


def test_what_a_pattern_demands():
    f = skips.literals
    assert f("broken pipe") == ["broken pipe"] and f(r"user=\d+ Logged") == ["user=", " logged"] and f("colou?rs") == ["colo"] and f("abc+def") == ["abc", "def"]
    assert f("abc|def") == [] and f("(abc|def)ghi") == ["ghi"] and f("[xyz|]abc[[:digit:]]def[]a]") == ["abc", "def"] and f("abcd{2}efgh{0,3}") == ["abc", "efg"]
    assert f(r"abc\x{41}def") == [] and f(r"\Qabc\E") == [] and f(r"a\.b\.cd(?:x(y)z)efg") == ["a.b.cd", "efg"] and f("(?i)ABC") == ["abc"]
    rng = random.Random(5)
    for _ in range(3000):  # whatever matches holds them
        p = "".join(rng.choice(["abc", "b", "c", ".", "*", "+", "?", "(", ")", "[ab]", "|", r"\.", "{2}", "{0,1}", r"\d"]) for _ in range(rng.randint(1, 7)))
        try:
            re.compile(p)
            re2_to_java(p)
        except (re.error, ValueError):
            continue
        except Exception:
            continue
        for _ in range(20):
            t = "".join(rng.choice("abc.d1") for _ in range(rng.randint(0, 9)))
            if re.search(p, t):
                assert all(x in t for x in f(p)), (p, t)
