"""Proportional stratified interleaving into shards whose row counts differ by one at most.

Rows of each source are put in a seeded random order; a row's fractional rank is (rank + a seeded offset of the source, between 0
and 1) / (rows of the source); all rows sorted by it are cut into runs of equal length, so every shard has the mixture of the whole.
The offsets spread sources of one row, or of a few, over all shards.

No source is ever sorted in one task: ranks are counted per (source, slice of the hash) and per slice of the fractional rank,
and only the counts of the slices are summed up, in two levels. Slices hold about SLICE rows on average, whatever the size of a
source. Texts are read once, for their size and checksum; all else goes on over a written table without them.

Defined cases: a null source is a source of its own; a null text has size 16 and the crc32 of the empty text; equal rows get
different slots, in no defined order among themselves; empty input gives no rows. Columns of docs other than those made here
pass through, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import crc32_sql, materialize, sheltered

SLICE, BLOCK = 4_000, 1_000
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _offsets(counts: DataFrame, by: list[str], at: str) -> DataFrame:
    """counts: by, at, n. Adds before: rows in the slices before, by sums over blocks of BLOCK slices and then within each."""
    c = counts.withColumn("block", F.floor(F.col(at) / BLOCK))
    over = lambda keys, order: W.partitionBy(*keys, F.lit(1)).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    blocks = c.groupBy(*by, "block").agg(F.sum("n").alias("m"))
    blocks = blocks.select(*[F.col(k).alias(f"{k}_") for k in by], F.col("block").alias("block_"), F.coalesce(F.sum("m").over(over(by, "block")), F.lit(0)).alias("base"))
    c = c.join(blocks, [F.col(k) == F.col(f"{k}_") for k in [*by, "block"]])
    return c.select(*by, at, (F.col("base") + F.coalesce(F.sum("n").over(over([*by, "block"], at)), F.lit(0))).alias("before"))


def _hash(*cols) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13), 16, 10).cast("long")


def shard_rows(docs: DataFrame, shards: int = 40, seed: str = "shard") -> DataFrame:
    d, own = sheltered(docs)
    text = F.coalesce(F.col(own["text"]), F.lit(""))
    keep = [(u, c) for u, c in zip(d.columns, docs.columns) if c not in MADE and c != "text"]
    d = d.select(
        *[u for u, _ in keep], (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        _hash(F.lit(seed), F.coalesce(F.col(own["doc_id"]).cast("string"), F.lit("null"))).alias("h"),
        F.coalesce(F.concat(F.lit("s"), F.col(own["source"])), F.lit("n")).alias("s"),
    )
    d, _ = materialize(d, "rows")
    n = d.count()
    slices = max(1, -(-n // SLICE))
    d = d.withColumn("slice", F.floor(F.col("h") / -(-(1 << 52) // slices)))
    counts = d.groupBy("s", "slice").agg(F.count("*").alias("n"))
    whole = counts.groupBy(F.col("s").alias("s3")).agg(F.sum("n").alias("all"))
    per = _offsets(counts, ["s"], "slice").withColumnsRenamed({"s": "s2", "slice": "slice2"})
    per = per.join(whole, F.col("s2") == F.col("s3")).drop("s3")
    d = d.join(per, (F.col("s") == F.col("s2")) & (F.col("slice") == F.col("slice2"))).drop("s2", "slice2")
    rank = F.col("before") + F.row_number().over(W.partitionBy("s", "slice").orderBy("h", own["doc_id"], "crc")) - 1
    offset = _hash(F.lit(seed), F.lit("source"), F.col("s")) / F.lit(float(1 << 52))
    d = d.withColumn("f", (rank + offset) / F.col("all")).drop("before", "all", "slice")
    d, _ = materialize(d.withColumn("cut", F.floor(F.col("f") * slices)), "ranked")
    cuts = _offsets(d.groupBy("cut").agg(F.count("*").alias("n")), [], "cut").withColumnRenamed("cut", "cut2")
    d = d.join(cuts, F.col("cut") == F.col("cut2")).drop("cut2")
    d = d.withColumn("g", F.col("before") + F.row_number().over(W.partitionBy("cut").orderBy("f", "s", "h", own["doc_id"])) - 1)
    shard = F.expr(f"CAST((g * {shards}) DIV {max(n, 1)} AS INT)")
    first = F.expr(f"CAST((shard * CAST({max(n, 1)} AS BIGINT) + {shards - 1}) DIV {shards} AS BIGINT)")
    d = d.withColumn("shard", shard).withColumn("slot", F.col("g") - first)
    return d.select(*[F.col(u).alias(c) for u, c in keep], "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: The whole table in one order; row g of n goes to shard g * 40 // n.
SQL = f"""
WITH d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
  CAST('0x' || substr(md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS h, coalesce('s' || source, 'n') AS s FROM documents),
f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32) - 1 + CAST('0x' || substr(md5('shard:source:' || s), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE) / count(*) OVER (PARTITION BY s) AS f FROM d),
g AS (SELECT *, row_number() OVER (ORDER BY f, s, h, doc_id) - 1 AS g, count(*) OVER () AS n FROM f)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(g * 40 // n AS INT) AS shard, g - (g * 40 // n * n + 39) // 40 AS slot, CAST(NULL AS INT) AS grown_shard, source FROM g
"""
