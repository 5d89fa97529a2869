"""Continuation fold: multi-line events become one entry.

A line folds into the entry before it if its level is unknown, neither line is blank, and it is a `key: value` field, or a stack
line after a problem. The rule needs no recursion: an entry keeps its head's level, so a line's anchor is the last sure head.

A container's timeline is not sorted in one task. It is cut into slices of a bounded number of rows; each is a window partition of its own,
and what passes a slice's edge (the last line, the last sure head, the last head) comes from one summary row per slice.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.functions.parse import PROBLEM, is_stack_line, structured_field, trim, with_parsed

from tidewater.sources.scratch import written

from .running import DAY_NS, with_slices

KEY = ["host", "name"]


def parse(lines: DataFrame) -> DataFrame:
    """Lines with level, severity and message. A stored ts_ns stays; it wins over the one in the text."""
    p = with_parsed(lines)
    ts = F.coalesce("ts_ns", "parsed_ns") if "ts_ns" in lines.columns else F.col("parsed_ns")
    return p.withColumn("ts_ns", ts).drop("parsed_ns")


def _edges(d: DataFrame, keys: list[str]) -> DataFrame:
    """Per slice, what reaches it from the slices before: the line before its first (tail_), the level of the last sure head
    (carry_level_) and the place of the last head (carry_head_).

    One summary row per slice says what the slice alone can tell; windows over these rows settle the rest. Lines before a slice's
    first sure head are its prefix: whether stack lines among them are heads depends on the level that is carried in.
    """
    order = F.struct("ts_ns", "rowid")
    stack = F.col("stack_") & ~F.col("field_")
    per = d.groupBy(*keys, "slice_").agg(
        F.max_by(F.struct("container_id", "blank_"), order).alias("last_"),
            F.min_by(F.struct("container_id", "local_", "level"), order).alias("first_"), F.min(order).alias("first_at_"),
        F.max_by("level", F.when(F.col("local_"), order)).alias("level_"),
        F.max(F.when(F.col("local_") | (stack & F.col("anchor_").isNotNull() & ~F.col("anchor_").isin(PROBLEM)), order)).alias("head_"),
        F.max(F.when(stack & F.col("anchor_").isNull(), order)).alias("prefix_"),
    )
    w = W.partitionBy(*keys).orderBy("slice_")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("tail_", F.lag("last_").over(w))
    per = per.withColumn("sure_", F.col("first_.local_") | _breaks(F.col("tail_"), F.col("first_.container_id")))
    per = per.withColumn("carry_level_", F.last(F.coalesce("level_", F.when(F.col("sure_"), F.col("first_.level"))), ignorenulls=True).over(before))
    into = F.when(F.col("sure_"), F.col("first_.level")).otherwise(F.col("carry_level_"))
    head = F.coalesce("head_", F.when(~into.isin(PROBLEM), F.col("prefix_")), F.when(F.col("sure_"), F.col("first_at_")))
    per = per.withColumn("own_head_", head).withColumn("carry_head_", F.last("own_head_", ignorenulls=True).over(before))
    return per.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("slice_").alias("slice__"), "tail_", "carry_level_", "carry_head_")


def _breaks(prev: Column, container_id: Column) -> Column:
    """Nothing folds over a missing line, another container's or a blank one."""
    return prev.isNull() | ~prev["container_id"].eqNullSafe(container_id) | prev["blank_"]


def mark_heads(parsed: DataFrame, keys: list[str] = KEY, slice_ns: int = DAY_NS, lines: DataFrame | None = None) -> DataFrame:
    """Lines as `parse` gives them; lines: what was parsed, where it has keys and ts_ns, so that counting them needs no parsing. Adds anchor: struct(ts_ns, rowid) of the head of each line's entry, is_head, and plain_head: a head whatever lies before it."""
    field, _ = structured_field(F.col("message"))
    d = with_slices(parsed, keys, "ts_ns", slice_ns, counted=lines)
    d = d.withColumns({"blank_": trim(F.col("message")) == "", "field_": field.isNotNull(), "stack_": is_stack_line(F.col("message"))})
    w = W.partitionBy(*keys, "slice_").orderBy("ts_ns", "rowid")
    plain = (F.col("level") != "UNKNOWN") | F.col("blank_") | ~(F.col("field_") | F.col("stack_"))
    d = d.withColumns({"plain_": plain, "prev_": F.lag(F.struct("container_id", "blank_")).over(w)})
    local = F.col("plain_") | (F.col("prev_").isNotNull() & _breaks(F.col("prev_"), F.col("container_id")))
    d = d.withColumn("local_", local)
    d = d.withColumn("anchor_", F.last(F.when(F.col("local_"), F.col("level")), ignorenulls=True).over(w))
    on = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys] + [F.col("slice_") == F.col("slice__")]
    d = d.join(_edges(d, keys), on, "left").drop(*[f"{k}__" for k in keys], "slice__")
    d = d.withColumn("sure_", F.col("local_") | (F.col("prev_").isNull() & _breaks(F.col("tail_"), F.col("container_id"))))
    level = F.coalesce(F.last(F.when(F.col("sure_"), F.col("level")), ignorenulls=True).over(w), F.col("carry_level_"))
    d = d.withColumn("is_head", F.col("sure_") | (F.col("stack_") & ~F.col("field_") & ~level.isin(PROBLEM)))
    head = F.when(F.col("is_head"), F.struct("ts_ns", "rowid"))
    d = d.withColumn("anchor", F.coalesce(F.last(head, ignorenulls=True).over(w), F.col("carry_head_")))
    return d.drop("slice_", "blank_", "field_", "stack_", "prev_", "local_", "anchor_", "tail_", "carry_level_", "sure_", "carry_head_").withColumnRenamed("plain_", "plain_head")


def folded(lines: DataFrame, keys: list[str] = KEY, slice_ns: int = DAY_NS) -> DataFrame:
    """Entries of stored lines. Parsed lines are written once: marking heads reads them twice, and parsing takes far longer than reading."""
    parsed, _ = written(parse(lines), "parsed")
    return fold(parsed, keys, slice_ns, parsed)


def fold(parsed: DataFrame, keys: list[str] = KEY, slice_ns: int = DAY_NS, lines: DataFrame | None = None) -> DataFrame:
    """One row per entry: messages and raws joined by newlines, fields of the continuation lines (the last of a key wins)."""
    d = mark_heads(parsed, keys, slice_ns, lines)
    key, value = structured_field(F.col("message"))
    part = F.struct("ts_ns", "rowid", F.when(F.col("is_head"), F.col("message")).otherwise(trim(F.col("message"))).alias("m"), "raw",
        F.when(~F.col("is_head"), key).alias("k"), value.alias("v"))
    first = lambda c: F.min_by(c, F.struct("ts_ns", "rowid")).alias(c)
    extra = [c for c in ("host", "name", "container_id", "stream") if c in parsed.columns and c not in keys]
    g = d.groupBy(*keys, "anchor").agg(F.array_sort(F.collect_list(part)).alias("parts"), *[first(c) for c in ("level", "severity", "plain_head", *extra)])
    pairs = F.filter("parts", lambda x: x["k"].isNotNull())
    fields = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return g.select(
        *keys, F.col("anchor.ts_ns").alias("ts_ns"), F.col("anchor.rowid").alias("rowid"), "level", "severity", "plain_head", *extra,
        F.array_join(F.filter(F.transform("parts", lambda x: x["m"]), lambda m: m != ""), "\n").alias("message"),
        F.array_join(F.transform("parts", lambda x: x["raw"]), "\n").alias("raw"), fields.alias("fields"), (F.size("parts") - 1).alias("continuation_count"),
    )
