"""Chains of pointers within a key, such as alerts after alerts or windows after windows, without going through a key in one task.

Every row of a key has a rank (0, 1, 2, ...) and points to the rank that would follow it, or to none; pointers lead forward. The chain is
what is reached from rank 0. Ranks are cut into chunks. Within a chunk, a map finds for each row where the chain would leave the chunk if it
went through that row. Only the places where some chunk is left to, few as paths meet, are linked over chunks, by pointer doubling: the
number of joins is the logarithm of the number of chunks. A second map walks each chunk from the place where the chain enters it.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewater.sources.scratch import delete, written

CHUNK = 100_000


def _groups(batches):
    """Rows of one (key, chunk) after the other; batches are sorted by them."""
    held = []
    for b in batches:
        if not len(b):
            continue
        edge = np.flatnonzero(((b["key"] != b["key"].shift()) | (b["chunk"] != b["chunk"].shift())).to_numpy())
        for lo, hi in zip(edge, [*edge[1:], len(b)]):
            part = b.iloc[lo:hi]
            if held and (held[-1]["key"].iloc[0], held[-1]["chunk"].iloc[0]) != (part["key"].iloc[0], part["chunk"].iloc[0]):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _exits(batches):
    for g in _groups(batches):
        lo, n = int(g["rank"].iloc[0]), len(g)
        to = g["next"].fillna(-1).astype("int64").to_numpy()
        while (inside := (to >= 0) & (to < lo + n)).any():
            to = np.where(inside, to[np.where(inside, to - lo, 0)], to)
        yield pd.DataFrame({"key": g["key"], "rank": g["rank"], "leaves": pd.Series(to, dtype="Int64").mask(to < 0)})


def _walk(batches):
    for g in _groups(batches):
        entry = np.flatnonzero(g["entry"].to_numpy())
        if not len(entry):
            continue
        lo, n, to = int(g["rank"].iloc[0]), len(g), g["next"].fillna(-1).astype("int64").to_numpy().tolist()
        at, on = int(entry[0]), []
        while 0 <= at < n:
            on.append(at)
            at = to[at] - lo if to[at] >= 0 else -1
        yield g.iloc[on][["key", "rank", "next"]]


def _entries(rows: DataFrame, chunk: int) -> DataFrame:
    """key and rank of the first row of the chain in each chunk it visits but the first."""
    spec = f"key {dict(rows.dtypes)['key']}, rank bigint, leaves bigint"
    chunked = rows.withColumn("chunk", F.floor(F.col("rank") / chunk))
    exits, used = written(chunked.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "rank").mapInPandas(_exits, spec), "exits")
    places = exits.select(F.col("key").alias("key_"), F.col("leaves").alias("at_")).filter("at_ IS NOT NULL").distinct()
    start = exits.filter("rank = 0").select("key", F.col("leaves").alias("node")).filter("node IS NOT NULL")
    jump, _ = written(places.join(exits, (F.col("key_") == F.col("key")) & (F.col("at_") == F.col("rank"))).select("key", F.col("at_").alias("node"), F.col("leaves").alias("to")), "jumps")
    reached, _ = written(start, "reached")
    delete(rows.sparkSession, used)
    while True:
        by = jump.select(F.col("key").alias("key_"), F.col("node").alias("node_"), "to")
        new = reached.join(by, (F.col("key") == F.col("key_")) & (F.col("node") == F.col("node_"))).filter("to IS NOT NULL").select("key", F.col("to").alias("node"))
        new, _ = written(new, "reached")
        if new.isEmpty():
            return reached
        reached, _ = written(reached.unionByName(new), "reached")
        jump, _ = written(jump.join(by.withColumnRenamed("to", "to_"), (F.col("key") == F.col("key_")) & (F.col("to") == F.col("node_"))).select("key", "node", F.col("to_").alias("to")), "jumps")


def chain(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rows: key, rank (dense from 0), next and others. Those on the chain from each key's rank 0, and `carried`: `between` of the row
    before in the chain, if rows have it."""
    rows, _ = written(rows, "chain")
    chunked = rows.select("key", "rank", F.col("next").cast("bigint").alias("next"), F.floor(F.col("rank") / chunk).alias("chunk"))
    entry = F.col("rank") == 0
    if rows.filter(F.col("rank") >= chunk).isEmpty():
        chunked = chunked.withColumn("entry", entry)
    else:
        into = _entries(rows.select("key", "rank", "next"), chunk).select(F.col("key").alias("key_"), F.col("node").alias("node_"))
        chunked = chunked.join(into, (F.col("key") == F.col("key_")) & (F.col("rank") == F.col("node_")), "left").withColumn("entry", entry | F.col("node_").isNotNull()).drop("key_", "node_")
    spec = f"key {dict(rows.dtypes)['key']}, rank bigint, next bigint"
    on = chunked.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "rank").mapInPandas(_walk, spec)
    on, _ = written(on, "walked")
    marks = on.select(F.col("key").alias("key_"), F.col("rank").alias("rank_"))
    out = rows.join(marks, (F.col("key") == F.col("key_")) & (F.col("rank") == F.col("rank_"))).drop("key_", "rank_")
    if "between" not in rows.columns:
        return out
    before = out.select(F.col("key").alias("key_"), F.col("next").alias("next_"), F.col("between").alias("carried")).filter("next_ IS NOT NULL")
    return out.join(before, (F.col("key") == F.col("key_")) & (F.col("rank") == F.col("next_")), "left").drop("key_", "next_")
