"""History queries: the query object, its cursor, and the plan from stored lines to one page."""
from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.parse import LEVELS
from tidewater.functions.patterns import ignoring_case
from tidewater.operators.fold import DAY_NS, folded
from tidewater.operators.ingest import day_of, on_days
from tidewater.sources import skips

DEFAULT_LIMIT, MOST_LIMIT = 500, 1000


@dataclass
class HistoryQuery:
    name: str
    host: str = ""
    since_ns: int | None = None
    until_ns: int | None = None
    levels: list[str] = field(default_factory=list)
    search: str = ""
    regex: bool = False
    limit: int = 0
    cursor: str = ""


@dataclass
class Page:
    rows: DataFrame
    next_cursor: str


def encode_cursor(ts_ns: int, rowid: int) -> str:
    return base64.urlsafe_b64encode(f"{ts_ns}:{rowid}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[int, int]:
    try:
        text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
    except ValueError as e:
        raise ValueError(f"invalid cursor {cursor!r}") from e
    if not (m := re.fullmatch(r"(-?\d+):(-?\d+)", text)):
        raise ValueError(f"invalid cursor {cursor!r}")
    return int(m[1]), int(m[2])


def check_levels(levels: list[str]) -> list[str]:
    out = [x.upper() for x in levels]
    if bad := [x for x in out if x not in LEVELS]:
        raise ValueError(f"unknown level {bad[0]!r}")
    return out


def page_limit(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MOST_LIMIT)


def before_cursor(cursor: str, ts: str = "ts_ns", rowid: str = "rowid") -> Column:
    t, r = decode_cursor(cursor)
    return (F.col(ts) < t) | ((F.col(ts) == t) & (F.col(rowid) < r))


def from_place(at) -> Column:
    return (F.col("ts_ns") > at.ts_ns) | ((F.col("ts_ns") == at.ts_ns) & (F.col("rowid") >= at.rowid))


def _until(q: HistoryQuery) -> int | None:
    """The newest time that the page can hold."""
    return min((x for x in (q.until_ns, decode_cursor(q.cursor)[0] if q.cursor else None) if x is not None), default=None)


def scan(lines: DataFrame, q: HistoryQuery) -> DataFrame:
    """Name, host, time and cursor reach the scan (and its days); level and search must not, for they hold on folded entries."""
    d = on_days(lines, q.since_ns, _until(q)).filter(F.col("name") == q.name)
    if q.host:
        d = d.filter(F.col("host") == q.host)
    if q.since_ns is not None:
        d = d.filter(F.col("ts_ns") >= q.since_ns)
    if q.until_ns is not None:
        d = d.filter(F.col("ts_ns") <= q.until_ns)
    return d.filter(before_cursor(q.cursor)) if q.cursor else d


def matches(q: HistoryQuery) -> Column:
    cond = F.lit(True)
    if q.levels:
        wanted = sorted({LEVELS.index(x.upper()) if x.upper() in LEVELS else 0 for x in q.levels})
        cond = F.col("severity").isin(wanted)
    if q.search and q.regex:
        cond = cond & F.col("message").rlike(ignoring_case(q.search))
    elif q.search:
        cond = cond & F.contains(F.lower("message"), F.lit(q.search.lower()))
    return cond


def entries(lines: DataFrame, q: HistoryQuery, slice_ns: int = DAY_NS) -> DataFrame:
    return folded(scan(lines, q), ["host", "name"] if q.host else ["name"], slice_ns).filter(matches(q))


def _days(lines: DataFrame, q: HistoryQuery) -> list[date]:
    """Days of the store within the query's times, newest first, by the names of its folders: no file is opened."""
    named = {m[1] for f in lines.inputFiles() if (m := re.search(r"/day=(\d{4}-\d\d-\d\d)/", f))}
    lo, hi = (day_of(x) if x is not None else None for x in (q.since_ns, _until(q)))
    days = sorted((date.fromisoformat(x) for x in named), reverse=True)
    return [x for x in days if (lo is None or x >= lo) and (hi is None or x <= hi)]


def newest_days(lines: DataFrame, q: HistoryQuery, want: int, slice_ns: int = DAY_NS) -> DataFrame:
    """Of lines stored by day: entries that hold the newest `want` matches, from as few of the newest days as it takes.

    Days are added, as many as the matches so far suggest, until enough lie after the first head that is a head by itself: entries
    from there on are the same whatever lies before.
    """
    days = _days(lines, q)
    k = 1
    while True:
        part = lines if k >= len(days) else lines.filter(F.col("day") >= F.lit(days[k - 1]))
        all_ = folded(scan(part, q), ["host", "name"] if q.host else ["name"], slice_ns)
        if k >= len(days):
            return all_.filter(matches(q))
        all_ = all_.persist()
        n = 0
        sure = all_.filter("plain_head").agg(F.min(F.struct("ts_ns", "rowid")).alias("s")).first().s
        if sure is not None:
            found = all_.filter(from_place(sure)).filter(matches(q))
            n = found.limit(want).count()
        all_.unpersist()
        if n == want:
            return found
        k *= min(8, max(2, -(-5 * want // (4 * max(n, 1)))))


@dataclass
class _Run:
    """Consecutive stored days, by number from the oldest: which are read, and the first and last of them that may hold the text."""
    lo: int
    hi: int
    first: int
    last: int


def _merged(runs: list[_Run]) -> list[_Run]:
    out: list[_Run] = []
    for r in sorted(runs, key=lambda r: r.lo):
        if out and r.lo <= out[-1].hi + 1:
            o = out[-1]
            out[-1] = _Run(o.lo, max(o.hi, r.hi), min(o.first, r.first), max(o.last, r.last))
        else:
            out.append(r)
    return out


def _of_runs(lines: DataFrame, q: HistoryQuery, runs: list[_Run], days: list[date], slice_ns: int) -> DataFrame:
    """Entries of the runs' days; nothing folds from one run into another."""
    of = lines.sparkSession.createDataFrame([(days[i], k) for k, r in enumerate(runs) for i in range(r.lo, r.hi + 1)], "day date, run_ int")
    part = scan(lines.filter(F.col("day").isin([days[i] for r in runs for i in range(r.lo, r.hi + 1)])), q).join(F.broadcast(of), "day")  # a row a day
    return folded(part, ["host", "name", "run_"] if q.host else ["name", "run_"], slice_ns)


def newest_of(lines: DataFrame, q: HistoryQuery, want: int, may_hold: set[date], slice_ns: int = DAY_NS) -> DataFrame:
    """newest_days where only some days may hold the text that is searched for.

    Those days are read, newest first, with as many of the days around them as it takes for every entry that reaches into them to be
    whole: there has to be a head by itself before and another one after. Days in between stay closed.
    """
    days = _days(lines, q)[::-1]
    wanted = [i for i in reversed(range(len(days))) if days[i] in may_hold]
    if not wanted:
        return entries(lines.filter(F.lit(False)), q, slice_ns)
    last, k = len(days) - 1, 1
    while True:
        runs, step = _merged([_Run(max(i - 1, 0), min(i + 1, last), i, i) for i in wanted[:k]]), 1
        while True:
            all_ = _of_runs(lines, q, runs, days, slice_ns).persist()
            at = F.struct("ts_ns", "rowid")
            heads = {r.run_: r for r in all_.filter("plain_head").groupBy("run_").agg(F.min(at).alias("s"), F.max(at).alias("e")).collect()}  # a row for each run
            more = False
            for j, r in enumerate(runs):
                h = heads.get(j)
                if r.lo > 0 and (h is None or day_of(h.s.ts_ns) >= days[r.first]):
                    r.lo, more = max(r.lo - step, 0), True
                if r.hi < last and (h is None or day_of(h.e.ts_ns) <= days[r.last]):
                    r.hi, more = min(r.hi + step, last), True
            if not more:
                break
            all_.unpersist()
            runs, step = _merged(runs), 2 * step
        place = lambda x: (x.ts_ns, x.rowid)
        bounds = [(j, *(place(heads[j].s) if r.lo > 0 else (None, None)), *(place(heads[j].e) if r.hi < last else (None, None))) for j, r in enumerate(runs)]
        b = lines.sparkSession.createDataFrame(bounds, "run_ int, s_ns bigint, s_row bigint, e_ns bigint, e_row bigint")
        whole = (F.col("s_ns").isNull() | (at >= F.struct("s_ns", "s_row"))) & (F.col("e_ns").isNull() | (at < F.struct("e_ns", "e_row")))
        found = all_.join(F.broadcast(b), "run_").filter(whole).drop("run_", "s_ns", "s_row", "e_ns", "e_row").filter(matches(q))  # a row for each run
        n = found.limit(want).count()
        all_.unpersist()
        if n == want or k >= len(wanted):
            return found
        k *= min(8, max(2, -(-5 * want // (4 * max(n, 1)))))


def _demanded(q: HistoryQuery) -> list[str]:
    """Texts, within a line each, that a match must hold."""
    return skips.literals(q.search) if q.regex else q.search.lower().split("\n")


def _enough(lines: DataFrame, q: HistoryQuery, want: int) -> DataFrame:
    if "day" not in lines.columns:
        return entries(lines, q)
    may_hold = skips.days_to_open(lines, q.name, _demanded(q)) if q.search else None
    return newest_days(lines, q, want) if may_hold is None else newest_of(lines, q, want, may_hold)


def page(lines: DataFrame, q: HistoryQuery) -> DataFrame:
    """The newest `limit` entries that match, in ascending order: a top-k, not a full sort."""
    n = page_limit(q.limit)
    return _enough(lines, q, n).orderBy(F.desc("ts_ns"), F.desc("rowid")).limit(n).orderBy("ts_ns", "rowid")


def fetch(lines: DataFrame, q: HistoryQuery) -> Page:
    """A page with its cursor; one entry more is asked for to tell whether an older one matches."""
    n = page_limit(q.limit)
    found = _enough(lines, q, n + 1)
    top = found.orderBy(F.desc("ts_ns"), F.desc("rowid")).limit(n + 1).select("ts_ns", "rowid").collect()  # n + 1 positions
    if len(top) <= n:
        return Page(found.orderBy("ts_ns", "rowid"), "")
    last = top[n - 1]
    return Page(found.filter(from_place(last)).orderBy("ts_ns", "rowid"), encode_cursor(*last))


def stored_containers(lines: DataFrame, generations: DataFrame) -> DataFrame:
    """Logical containers: bytes and spans over all generations, the rest from the newest (latest first_seen, then larger id)."""
    spans = lines.groupBy("host", "container_id").agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi"))
    g = generations.join(spans, ["host", "container_id"], "left")
    newest = lambda c: F.max_by(c, F.struct("first_seen_ms", "container_id"))
    return g.groupBy("host", "name").agg(
        F.sum("stored_bytes").alias("stored_bytes"), F.min("lo").alias("oldest_ns"), F.max("hi").alias("newest_ns"),
        newest(F.col("removed_ms").isNotNull()).alias("removed"), newest("image").alias("image"),
        newest("compose_project").alias("compose_project"), newest("excluded_reason").alias("excluded_reason"), F.count("*").alias("n_generations"),
    )
