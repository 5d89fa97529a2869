"""Alert delivery as data: one request row per alert and channel, and what becomes of the attempts.

Sending is left to a transport given by the caller, which runs in `foreachBatch`; channels are MOST_CHANNELS at most, more are an error.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .alerts import MOST_CHANNELS, at_most

CHANNELS = "id string, type string, name string, enabled boolean, url string, token string, target string"
# What each kind of channel expects (titles, priorities, headers, paths).
TITLE, PRIORITY = "Log alert", 8


def text(rule_name: Column, reason: Column, host: Column, container_name: Column) -> Column:
    target = F.concat(F.coalesce(host, F.lit("")), F.coalesce(F.concat(F.lit("/"), F.nullif(container_name, F.lit(""))), F.lit("")))
    return F.concat(F.lit("Alert: "), rule_name, F.lit(": "), reason, F.when(target != "", F.concat(F.lit(" ("), target, F.lit(")"))).otherwise(""))


def requests(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """alert_id, channel_id, url, headers, body, secret for every enabled channel of a known type."""
    at_most(channels, MOST_CHANNELS, "channels")
    c = channels.filter(F.col("enabled") & F.col("type").isin("webhook", "ntfy", "gotify", "telegram")).withColumnsRenamed({"id": "channel_id", "type": "kind", "name": "channel"})
    d = alerts.withColumn("text_", text(F.col("rule_name"), F.col("reason"), F.col("host"), F.col("container_name"))).crossJoin(F.broadcast(c))
    k, t = F.col("kind"), F.col("text_")
    body = (
        F.when(k == "webhook", F.to_json(F.struct(F.lit(1).alias("version"), t.alias("text"), t.alias("content"), F.struct(*alerts.columns).alias("alert"))))
        .when(k == "gotify", F.to_json(F.struct(F.lit(TITLE).alias("title"), t.alias("message"), F.lit(PRIORITY).alias("priority"))))
        .when(k == "telegram", F.to_json(F.struct(F.col("target").alias("chat_id"), t.alias("text")))).otherwise(t)
    )
    json = F.create_map(F.lit("Content-Type"), F.lit("application/json"))
    headers = F.when(k == "ntfy", F.create_map(*[F.lit(x) for x in ("Title", TITLE, "Priority", "high", "Tags", "warning")])).when(k == "gotify",
        F.map_concat(json, F.create_map(F.lit("X-Gotify-Key"), F.col("token")))).otherwise(json)
    url = F.when(k == "gotify", F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/message"))).when(k == "telegram",
        F.concat(F.lit("https://api.telegram.org/bot"), F.col("token"), F.lit("/sendMessage"))).otherwise(F.col("url"))
    return d.select(F.col("id").alias("alert_id"), "channel_id", "channel", url.alias("url"), headers.alias("headers"), body.alias("body"),
        F.when(k == "telegram", F.col("token")).otherwise("").alias("secret"))


def outcomes(attempts: DataFrame) -> DataFrame:
    """attempts: alert_id, channel_id, attempt, http_status (null: network error), error, secret. The last attempt counts; secrets
    never stay in an error."""
    last = attempts.groupBy("alert_id", "channel_id").agg(*[F.max_by(c, "attempt").alias(c) for c in ("http_status", "error", "secret")], F.max("attempt").alias("attempts"))
    ok = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    clean = F.when(F.col("secret") != "", F.replace("error", "secret", F.lit("***"))).otherwise(F.col("error"))
    return last.select("alert_id", "channel_id", "attempts", F.when(ok, "ok").otherwise("failed").alias("status"), "http_status",
        F.when(~ok, F.coalesce(clean, F.concat(F.lit("channel returned "), F.col("http_status").cast("string")))).alias("error"))


def retryable(attempts: DataFrame) -> DataFrame:
    """First attempts that failed by the network or with 5xx: each is tried once more."""
    once = attempts.groupBy("alert_id", "channel_id").agg(F.max("attempt").alias("n"), F.max_by("http_status", "attempt").alias("http_status"))
    return once.filter((F.col("n") == 1) & (F.col("http_status").isNull() | (F.col("http_status") >= 500))).select("alert_id", "channel_id")


def delivered(requests_: DataFrame, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Outcomes of requests. send gives a row for each: alert_id, channel_id, http_status, error; what failed by the network or with
    5xx is sent once more."""
    first = send(requests_).withColumn("attempt", F.lit(1)).persist()  # a request isn't sent twice because it is looked at twice
    again = send(requests_.join(retryable(first), ["alert_id", "channel_id"], "left_semi")).withColumn("attempt", F.lit(2)).persist()
    return outcomes(first.unionByName(again).join(requests_.select("alert_id", "channel_id", "secret"), ["alert_id", "channel_id"]))


def deliver(alerts: DataFrame, channels: DataFrame, checkpoint: str, send: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame, int], None]):
    """Streams alerts' requests to a transport, and what became of them to `done`, with the batch's number."""
    return alerts.writeStream.foreachBatch(lambda batch, k: done(delivered(requests(batch, channels), send), k)).option("checkpointLocation", checkpoint).start()
