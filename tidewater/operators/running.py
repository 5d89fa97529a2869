"""Running sums and ranks within a key, without bringing a key's rows to one task.

Rows are cut into slices of their order; each (key, slice) is a window partition of its own, and sums of whole slices, one row
each, are carried over. Slices are bounded by rows (`with_slices`), so a key that holds a third of all rows is no larger a task than any
other, however its rows crowd in time.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.functions.format import whole
from tidewater.sources.scratch import delete, written

DAY_NS = 86_400_000_000_000
SLICE_ROWS = 100_000


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]


def with_slices(df: DataFrame, keys: list[str], at: str, unit: int = DAY_NS, rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Adds slice_, the start of a run of `at` (an integer) that holds at most `rows` rows (SLICE_ROWS) of the key.

    Runs are `unit` long at first. Rows are counted by (key, run); a run that holds more is cut into as many as twice its surplus asks for,
    and what still holds more is cut again, until nothing does or a run is a single value of `at`. Mostly the first count finds nothing to
    cut. counted: a table whose counts stand for those of df, if they are cheaper there; slices stay runs of df's `at` in any case.
    """
    rows = rows or SLICE_ROWS
    first = F.coalesce(whole(F.col(at), unit) * unit, F.lit(-(1 << 62)))
    narrow = (df if counted is None else counted).select(*keys, at).withColumns({"slice_": first, "width_": F.lit(unit).cast("bigint")})
    df = df.withColumns({"slice_": first, "width_": F.lit(unit).cast("bigint")})
    while True:
        full = narrow.groupBy(*keys, "slice_", "width_").agg(F.count("*").alias("n_")).filter((F.col("n_") > rows) & (F.col("width_") > 1) & (F.col("slice_") > -(1 << 62)))
        finer = F.greatest(whole(F.col("width_"), 2 * F.ceil(F.col("n_") / rows)), F.lit(1)).alias("finer_")
        full, path = written(full.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("slice_").alias("slice__"), finer), "slices")
        if full.isEmpty():
            delete(full.sparkSession, path)
            return df.drop("width_")
        cut = F.col("slice_") + whole(F.col(at) - F.col("slice_"), F.col("finer_")) * F.col("finer_")
        into = lambda d: d.join(full, [*_same(keys), F.col("slice_") == F.col("slice__")], "left").withColumns(
            {"slice_": F.coalesce(cut, "slice_"), "width_": F.coalesce("finer_", "width_")}).drop(*[f"{k}__" for k in keys], "slice__", "finer_")
        narrow, df = into(narrow), into(df)


def running_sum(df: DataFrame, keys: list[str], slice_: Column | None, order: list, value: Column, name: str, totals: str = "", unit: int = DAY_NS) -> DataFrame:
    """Adds `name`: the sum of value over the key's rows before this one; `totals`: over all of the key's rows.

    slice_ must not fall along the order; without it, slices are those of the order's first column. Without keys, all rows are one sequence,
    cut by slice alone.
    """
    d = (with_slices(df, keys, order[0], unit) if slice_ is None else df.withColumn("slice_", slice_)).withColumn("value_", value)
    per = d.groupBy(*keys, "slice_").agg(F.sum("value_").alias("sum_"))
    before = W.partitionBy(*keys).orderBy("slice_").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("slice_").alias("slice__"),
        F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("before_"), F.sum("sum_").over(W.partitionBy(*keys)).alias("total_"))
    d = d.join(per, [*_same(keys), F.col("slice_").eqNullSafe(F.col("slice__"))])
    within = W.partitionBy(*keys, "slice_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn(name, F.col("before_") + F.coalesce(F.sum("value_").over(within), F.lit(0)))
    d = d.withColumn(totals, F.col("total_")) if totals else d
    return d.drop(*[f"{k}__" for k in keys], "slice__", "slice_", "value_", "before_", "total_")


def previous(df: DataFrame, keys: list[str], unit: int, order: list[str], columns: list[str]) -> DataFrame:
    """Adds prev_: struct of the columns in the key's row before this one, null for its first.

    A slice's first row takes what the slice before it ends with, from one row per slice.
    """
    d = with_slices(df, keys, order[0], unit).withColumn("now_", F.struct(*columns))
    per = d.groupBy(*keys, "slice_").agg(F.max_by("now_", F.struct(*order)).alias("last_"))
    per = per.withColumn("carry_", F.lag("last_").over(W.partitionBy(*keys).orderBy("slice_")))
    per = per.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("slice_").alias("slice__"), "carry_")
    d = d.withColumn("prev_", F.lag("now_").over(W.partitionBy(*keys, "slice_").orderBy(*order)))
    d = d.join(per, [*_same(keys), F.col("slice_").eqNullSafe(F.col("slice__"))])
    return d.withColumn("prev_", F.coalesce("prev_", "carry_")).drop(*[f"{k}__" for k in keys], "slice__", "slice_", "now_", "carry_")


def value_slices(df: DataFrame, keys: list[str], value: str, n: int = 100) -> DataFrame:
    """Adds slice_no: in which of n roughly equal runs of its key's values a value lies. Equal values share one."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10 * n).alias("cuts_"))
    cuts = cuts.select(*[F.col(k).alias(f"{k}__") for k in keys], F.array_distinct("cuts_").alias("cuts_"))
    d = df.join(cuts, _same(keys))
    return d.withColumn("slice_no", F.size(F.filter("cuts_", lambda c: c < F.col(value)))).drop(*[f"{k}__" for k in keys], "cuts_")
