"""Poisson replication: each document is repeated a hash-seeded Poisson number of times.

A source with weight w (of all weights' sum), n documents and a target of `total` rows has the mean repetition rate
w * total / n. The document's count is the inverse of the Poisson distribution at a uniform number made from the hash of
seed and doc_id; documents are then exploded by their counts and dealt out globally by another hash.

Defined cases: a null source is a source of its own; equal rows get equal counts; a source without a given weight has
weight 0 (that of None is the null source's); empty input gives no rows; a row with a null doc_id is hashed as the text 'null'. The
columns replica, n_replicas and shuffle_key are added (existing ones of these names are replaced); all others pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialize, sheltered

#: The rates table has one row per source and some 60 probabilities or more in each; up to so many of them (8 MB) it is broadcast,
#: beyond that it is joined by a salted shuffle.
BROADCAST_ENTRIES = 1_000_000
SALTS = 64
#: Target weights of query op6: the square root of a source's share (temperature 2), which flattens the mixture.
TEMPERATURE = 2.0


def uniform(seed: str, *cols: Column) -> Column:
    """In [0, 1), from the first 13 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None, total: int | None) -> DataFrame:
    """source, rate, low, cdf: cumulative Poisson probabilities of the counts from `low` on, up to where they are 1.

    Terms go by recurrence outward from the mode, where they start at 1, and are divided by their sum: exp(-rate) would be 0
    beyond a rate of 745. What lies over 12 standard deviations from the mean is below double precision.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(1.0 / TEMPERATURE))
    else:
        pairs = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        named = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
        w = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(named)
    n = n.withColumn("w", w)
    sums = n.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    size = F.lit(float(total)) if total is not None else F.col("all_n")
    r = n.crossJoin(F.broadcast(sums)).select("source", F.when(F.col("all_w") > 0, F.col("w") * size / F.col("all_w") / F.col("n")).otherwise(0.0).alias("rate"))
    rate, reach, mode = F.col("rate"), 12 * F.sqrt("rate") + 30, F.floor("rate")
    low, high = F.greatest(F.lit(0).cast("long"), F.floor(rate - reach)), F.ceil(rate + reach)
    one, none = F.lit(1.0), F.array().cast("array<double>")
    term = lambda a, factor: F.struct((a.p * factor).alias("p"), F.concat(a.all, F.array(a.p * factor)).alias("all"))
    walk = lambda ks, factor: F.aggregate(ks, F.struct(one.alias("p"), none.alias("all")), lambda a, k: term(a, factor(k)))["all"]
    below = F.when(F.col("mode") > F.col("low"), F.sequence("mode", F.col("low") + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    r = r.withColumns({"low": low, "high": high, "mode": mode})
    terms = F.concat(F.reverse(walk(below, lambda k: k / rate)), F.array(one), walk(F.sequence(F.col("mode") + 1, F.col("high")), lambda k: rate / k))
    step = lambda a, p: F.struct((a.c + p).alias("c"), F.concat(a.cdf, F.array(a.c + p)).alias("cdf"))
    sums = F.aggregate("terms", F.struct(F.lit(0.0).alias("c"), none.alias("cdf")), step)
    r = r.withColumn("terms", terms).withColumn("sums", sums)
    return r.select("source", "rate", "low", F.transform("sums.cdf", lambda c: c / F.col("sums.c")).alias("cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: str = "mix") -> DataFrame:
    rows, own = sheltered(docs)
    keep = [(u, c) for u, c in zip(rows.columns, docs.columns) if c not in ("replica", "n_replicas", "shuffle_key")]
    rows, doc, source = rows.select(*[u for u, _ in keep]), F.col(own["doc_id"]), F.col(own["source"])
    r, _ = materialize(rates(rows.select(source.alias("source")), weights, total).select(F.col("source").alias("key"), "low", "cdf"), "rates")
    if (r.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= BROADCAST_ENTRIES:
        joined = rows.join(F.broadcast(r), source.eqNullSafe(F.col("key")))
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(doc), F.lit(SALTS)))
        r = r.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(r, source.eqNullSafe(F.col("key")) & (F.col("salt") == F.col("salt2")))
    id_ = F.coalesce(doc.cast("string"), F.lit("null"))
    u = uniform(seed, id_)
    counted = joined.withColumn("n_replicas", F.col("low") + F.size(F.filter("cdf", lambda c: c <= u))).filter("n_replicas > 0")
    out = counted.select(*[u for u, _ in keep], F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_replicas") - 1)).alias("replica"), "n_replicas")
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), id_, F.col("replica").cast("string"))))
    out = out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return out.select(*[F.col(u).alias(c) for u, c in keep], "replica", "n_replicas", "shuffle_key")


SQL = f"""
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, w * (SELECT sum(n) FROM n) / (SELECT sum(w) FROM n) / n AS rate FROM n),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (SELECT *, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
u AS (SELECT *, ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
d AS (SELECT u.doc_id, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.c <= u.u) AS n_replicas FROM u)
SELECT d.doc_id, t.text, t.lang, t.source, t.n_chars, unnest(range(0, d.n_replicas)) AS replica, d.n_replicas,
 md5('mix:order:' || d.doc_id || ':' || replica) AS shuffle_key FROM d JOIN documents t USING (doc_id)
"""
