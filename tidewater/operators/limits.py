"""Rate limits by windows that begin with a key's first hit after the last window's end."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewater.sources.scratch import written

from .chains import CHUNK, chain
from .running import SLICE_ROWS, running_sum

# Hits that a window allows, and its length in seconds.
LIMIT, WINDOW_S = 10, 60


def _count(width: int):
    """Hits sorted by key and time, streamed."""
    def run(batches):
        key, start, n = None, None, 0
        for b in batches:
            starts, numbers = [], []
            for k, at in zip(b["key"], b["at"]):
                if k != key or at - start >= width:
                    key, start, n = k, at, 0
                n += 1
                starts.append(start)
                numbers.append(n)
            yield b.assign(window_start=pd.array(starts, dtype="int64"), hit_no=pd.array(numbers, dtype="int64"))

    return run


def fixed_windows(hits: DataFrame, limit: int = LIMIT, width: int = WINDOW_S, chunk: int = CHUNK) -> DataFrame:
    """hits: key, at (an integer), hit_id. Adds window_start, hit_no (from 1 within the window) and allowed: the first `limit` of a window.

    A key of up to `chunk` hits is gone through one by one, a larger one by pointers from hit to hit (`chains.chain`).
    """
    h, _ = written(hits.select("key", "at", "hit_id"), "hits")
    noisy, _ = written(h.groupBy("key").count().filter(F.col("count") > chunk).select("key"), "noisy")
    step = lambda d: d.repartition("key").sortWithinPartitions("key", "at", "hit_id").mapInPandas(_count(width), spec)
    spec = ", ".join(f"{c} {t}" for c, t in h.dtypes) + ", window_start bigint, hit_no bigint"
    out = step(h) if noisy.isEmpty() else step(h.join(noisy, "key", "left_anti")).unionByName(by_pointers(h.join(noisy, "key", "left_semi"), width, chunk))
    return out.withColumn("allowed", F.col("hit_no") <= limit)


def by_pointers(h: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """A window that begins with a hit is followed by one that begins with the first hit `width` or more later."""
    ranked, _ = written(running_sum(h, ["key"], None, ["at", "hit_id"], F.lit(1), "rank", unit=width), "ranked")
    row = lambda kind, pos, n: ranked.select("key", "rank", F.lit(kind).alias("kind_"), pos.cast("bigint").alias("pos_"), F.lit(n).alias("n_"))
    places = row("hit", F.col("at"), 1).unionByName(row("end", F.col("at") + width, 0))
    ends = running_sum(places, ["key"], None, ["pos_", "n_", "rank"], F.col("n_"), "next_", "all_", width).filter("kind_ = 'end'")
    # the last start's rank is carried to the next start, so that a running sum of differences gives every hit its window's start
    links = ends.select("key", "rank", F.when(F.col("next_") < F.col("all_"), F.col("next_")).alias("next"), F.col("rank").alias("between"))
    starts = chain(links, chunk).select(F.col("key").alias("key_"), F.col("rank").alias("rank_"), (F.col("rank") - F.coalesce("carried", F.lit(0))).alias("step_"))
    d = ranked.join(starts, (F.col("key") == F.col("key_")) & (F.col("rank") == F.col("rank_")), "left").withColumn("step_", F.coalesce("step_", F.lit(0)))
    began = F.when(F.col("rank_").isNotNull(), F.col("at"))
    d = d.select("key", "at", "hit_id", "rank", "step_", began.alias("began_"))
    d = running_sum(d, ["key"], F.col("rank") - F.pmod(F.col("rank"), F.lit(SLICE_ROWS)), ["rank"], F.col("step_"), "earlier_")
    first = F.col("earlier_") + F.col("step_")
    at = d.filter("began_ IS NOT NULL").select(F.col("key").alias("key_"), F.col("rank").alias("rank_"), F.col("began_").alias("window_start"))
    d = d.select("key", "at", "hit_id", "rank", first.alias("first_")).join(at, (F.col("key") == F.col("key_")) & (F.col("first_") == F.col("rank_")))
    return d.select("key", "at", "hit_id", "window_start", (F.col("rank") - F.col("first_") + 1).alias("hit_no"))
