"""Live log reads: splitting, tails, stream and level filters, search, merging over targets. Lines are filtered one by one when
they are followed, and after the fold when they are fetched."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.functions.parse import sample
from tidewater.functions.patterns import ignoring_case, re2_to_java

from tidewater.sources.scratch import written

from .running import running_sum

DEFAULT_TAIL, MOST_TAIL, MOST_TARGETS, MOST_LINE = 100, 10_000, 20, 1 << 20
# What an assistant may ask for at once.
DEFAULT_READ, MOST_READ = 100, 500


def split_lines(df: DataFrame, column: str = "value", most: int = MOST_LINE) -> DataFrame:
    """Non-empty lines of each value, one trailing CR stripped; line_no counts from 0. A line over `most` characters is several."""
    parts = F.filter(F.split(F.col(column), "\n"), lambda x: x != "")
    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda k: F.substring(x, k * most + 1, F.lit(most)))
    parts = F.when(F.exists(parts, lambda x: F.length(x) > most), F.flatten(F.transform(parts, pieces))).otherwise(parts)
    return df.select(*[c for c in df.columns if c != column], F.posexplode(F.transform(parts, lambda x: F.regexp_replace(x, r"\r\z", ""))).alias("line_no", "raw"))


def tail_size(value: str | None) -> int:
    if value is None or value == "":
        return DEFAULT_TAIL
    return min(int(value), MOST_TAIL) if value.isdigit() else MOST_TAIL


def read_size(value: int | None) -> int:
    """How many rows an assistant's read gives."""
    return DEFAULT_READ if value is None or value <= 0 else min(value, MOST_READ)


def tail(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The last n rows of each key; Spark limits groups before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= n).drop("rn_")


def streams(stdout: bool = True, stderr: bool = True) -> Column:
    return F.col("stream").isin([s for s, on in ((0, stdout), (1, stderr)) if on])


def live_match(level: str = "", search: str = "") -> Column:
    """One level, any case; a case-sensitive pattern on message or raw."""
    cond = F.lit(True)
    if level:
        cond = F.upper("level") == level.upper()
    if search:
        p = re2_to_java(search)
        cond = cond & (F.col("message").rlike(p) | F.col("raw").rlike(p))
    return cond


def keep(parsed: DataFrame, condition: Column) -> DataFrame:
    """Rows that a condition on message or level keeps; conditions on stored columns go to filter(), which reaches the scan.

    The condition is the output of a generator of one row. A plain filter would be pushed below the parsing with a copy of all of it
    for each mention of a parsed column: parsing twice, in code too large to compile.
    """
    return parsed.select("*", F.explode(F.array(condition)).alias("keep_")).filter("keep_").drop("keep_")


def exclude(pattern: str) -> Column:
    """Rows that the pattern does not match; an invalid pattern excludes nothing."""
    try:
        p = ignoring_case(pattern)
    except ValueError:
        return F.lit(True)
    return ~F.coalesce(sample(F.col("message"), F.col("raw")), F.lit("")).rlike(p)


def match_positions(df: DataFrame, pattern: str, order: list[str], keys: list[str]) -> DataFrame:
    """Positions (from 0, within the key) of rows whose message matches, and their matches' texts. order begins with ts_ns."""
    p = ignoring_case(pattern)
    d = running_sum(df, keys, None, order, F.lit(1), "position")
    return d.filter(F.col("message").rlike(p)).withColumn("spans", F.filter(F.regexp_extract_all("message", F.lit(p), F.lit(0)), lambda s: s != ""))


def merge_targets(df: DataFrame) -> DataFrame:
    """Rows with target_idx and ord, by time; unparsed times first, ties by target and line."""
    return df.orderBy(F.col("ts_ns").asc_nulls_first(), "target_idx", "ord")


def targets(spec: str | list[str]) -> list[tuple[str, str, str]]:
    """`host~id~name`, comma-separated or repeated."""
    parts = [x for s in ([spec] if isinstance(spec, str) else spec) for x in s.split(",") if x]
    out = [tuple(x.split("~", 2)) for x in parts]
    if not 1 <= len(out) <= MOST_TARGETS or any(len(x) != 3 or not x[0] or not x[1] for x in out):
        raise ValueError(f"1 to {MOST_TARGETS} targets host~id~name are needed")
    return out


def of_targets(lines: DataFrame, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """Lines of at most MOST_TARGETS targets, with their place in the list."""
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"over {MOST_TARGETS} targets")
    t = lines.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(wanted)], "target_idx int, host string, container_id string, target_name string")
    return lines.join(F.broadcast(t), ["host", "container_id"])


def newest_with_dropped(df: DataFrame, keys: list[str], order: list[str], n: int = MOST_TAIL) -> DataFrame:
    """The newest n rows of each key and how many were dropped before them."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    total = df.groupBy(*keys).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("dropped"))
    return df.withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= n).drop("rn_").join(total, keys)


def raw_ranges(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First and last physical line (from 0) of each entry, an entry having 1 + continuation_count of them. Entries are written once, as
    the sums read them several times."""
    entries, _ = written(entries, "entries")
    d = running_sum(entries, keys, None, order, 1 + F.col("continuation_count"), "raw_first")
    return d.withColumn("raw_last", F.col("raw_first") + F.col("continuation_count"))


def shifted_pins(pins: DataFrame, dropped: int) -> DataFrame:
    """Pinned row indices after the oldest `dropped` rows went; pins of those rows go with them."""
    return pins.withColumn("index", F.col("index") - dropped).filter("index >= 0")


def next_pin(pins: DataFrame, at: int) -> DataFrame:
    """The pin after row `at`; after the last one, the first."""
    return pins.orderBy(F.col("index") <= at, "index").limit(1)


def index_maps(rows: DataFrame, shown: Column, order: list[str], keys: list[str]) -> DataFrame:
    """Adds original_index, a row's place within its key, and filtered_index, its place among the rows that are shown (-1 if it is hidden)."""
    d = running_sum(rows.withColumn("shown_", F.coalesce(shown, F.lit(False))), keys, None, order, F.lit(1), "original_index")
    d = running_sum(d, keys, None, order, F.col("shown_").cast("int"), "filtered_index")
    return d.withColumn("filtered_index", F.when(F.col("shown_"), F.col("filtered_index")).otherwise(-1)).drop("shown_")


def navigate_pins(pins: DataFrame, maps: DataFrame, at: int, step: int) -> DataFrame:
    """pinned_index and filtered_index of the pin `step` places on from the at-th, wrapping around; no row without pins. pins: index, of one
    key; maps: that key's rows of index_maps."""
    n = pins.count()
    to = (at + step + n) % n if n else 0
    pin = pins.orderBy("index").offset(to).limit(1)
    d = pin.join(maps.select(F.col("original_index"), "filtered_index"), F.col("index") == F.col("original_index"), "left")
    return d.select(F.lit(to).alias("pinned_index"), F.coalesce("filtered_index", F.lit(-1)).alias("filtered_index"))


def time_range(preset: str, now_ns: int, custom: tuple[int | None, int | None] = (None, None)) -> tuple[int | None, int | None]:
    if preset == "custom":
        return custom
    # fixed values: seconds of the presets
    seconds = {"15m": 900, "1h": 3600, "6h": 21600, "24h": 86400}
    return (now_ns - seconds[preset] * 1_000_000_000, None) if preset in seconds else (None, None)
