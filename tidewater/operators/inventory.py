"""Containers, stacks, images, networks and resource statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.functions.format import compose_project, container_name, cpu_percent, in_project, short_id

from .running import previous, running_sum, value_slices

# States that are counted by name.
STATES = ["running", "exited", "paused", "restarting", "dead", "removed"]


def all_hosts(listings: list[tuple[str, DataFrame | None, str]]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Rows of the hosts that answered, each with its host, and (host, error) of the others."""
    rows, errors = None, []
    for host, df, error in listings:
        if df is None:
            errors.append((host, error))
            continue
        df = df.withColumn("host", F.lit(host))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    return rows, errors


def host_info(hosts: DataFrame, info: DataFrame) -> DataFrame:
    """A row per configured host, in order; without info it has an error."""
    return hosts.join(info, "host", "left").withColumn("error", F.when(F.col("engine").isNull(), "unavailable")).orderBy("position")


def stacks(containers: DataFrame) -> DataFrame:
    c = containers.withColumn("project", compose_project(F.col("labels"))).filter("project IS NOT NULL")
    return c.groupBy("project").agg(F.count("*").alias("containers"), F.count_if(F.col("state") == "running").alias("running"),
        F.array_sort(F.collect_set("host")).alias("hosts")).orderBy("project")


def stack_members(containers: DataFrame, project: str) -> DataFrame:
    return containers.filter(in_project(F.col("labels"), F.lit(project)))


def state_counts(containers: DataFrame) -> DataFrame:
    return containers.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.count_if(~F.col("state").isin(STATES)).alias("other"), F.count("*").alias("total"))


def by_project(containers: DataFrame) -> DataFrame:
    return containers.groupBy(F.coalesce(compose_project(F.col("labels")), F.lit("Standalone")).alias("project")).agg(F.count("*").alias("n"))


def dashboard(search: str = "", host: str = "", state: str = "", created_from: int | None = None, created_to: int | None = None) -> Column:
    """Id prefix, image or any name contains the text; host, state and creation time; removed rows only where asked for."""
    s = search.lower()
    cond = F.lit(True)
    if s:
        cond = F.lower("id").startswith(s) | F.contains(F.lower("image"), F.lit(s)) | F.exists("names", lambda n: F.contains(F.lower(n), F.lit(s)))
    if host:
        cond = cond & (F.col("host") == host)
    cond = cond & (F.col("state") == state if state else F.col("state") != "removed")
    if created_from is not None:
        cond = cond & (F.col("created") >= created_from)
    return cond & (F.col("created") <= created_to) if created_to is not None else cond


def offset_page(df: DataFrame, page: int, size: int) -> tuple[DataFrame, int, int, int]:
    """Rows of a page (clamped to the last), its first and last row from 1, and the total."""
    total = df.count()
    page = max(1, min(page, -(-total // size) or 1))
    lo = (page - 1) * size
    return df.offset(lo).limit(size), lo + 1 if total else 0, min(lo + size, total), total


def resolve(containers: DataFrame, wanted: str, host: str = "") -> DataFrame:
    """Containers of exactly this name, else those whose id starts with it."""
    c = containers.filter(F.col("host") == host) if host else containers
    tier = F.when(container_name(F.col("names")) == wanted, 0).when(F.col("id").startswith(wanted), 1)
    c = c.withColumn("tier_", tier).filter("tier_ IS NOT NULL")
    best = c.agg(F.min("tier_").alias("best_"))
    return c.join(F.broadcast(best), F.col("tier_") == F.col("best_")).drop("tier_", "best_")


def resolve_one(containers: DataFrame, wanted: str, host: str = "") -> dict:
    rows = resolve(containers, wanted, host).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"no container {wanted!r}" if not rows else f"{wanted!r} is ambiguous")
    return rows[0].asDict(recursive=True)


def removed_rows(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored, removed containers that no live one has replaced, shaped as inventory rows."""
    gone = stored.filter(F.col("removed") & F.col("excluded_reason").isNull()).join(live.select("host", container_name(F.col("names")).alias("name")),
        ["host", "name"], "left_anti")
    return gone.select(F.concat(F.lit("removed:"), "name").alias("id"), F.array("name").alias("names"), "image", F.lit("removed").alias("state"),
        "host", "stored_bytes").orderBy(F.desc("stored_bytes"), "names")


def stats_with_names(stats: DataFrame, containers: DataFrame) -> DataFrame:
    names = containers.select("host", "id", container_name(F.col("names"), F.col("id")).alias("name"))
    return stats.join(names, ["host", "id"], "left").withColumn("name", F.coalesce("name", short_id(F.col("id"))))


def cpu_between_polls(samples: DataFrame, most_age_s: int = 120, slice_width: int = 86_400) -> DataFrame:
    """cpu_percent of each sample: the engine's own window if it has one, else against the sample before, else since start."""
    d = previous(samples, ["host", "id"], slice_width, ["at_s"], ["total_usage", "system_usage", "at_s"])
    own = cpu_percent(F.col("total_usage"), F.col("pre_total"), F.col("system_usage"), F.col("pre_system"), F.col("online_cpus"), F.col("per_cpu"))
    n = F.coalesce(F.nullif("online_cpus", F.lit(0)), F.nullif("per_cpu", F.lit(0)), F.lit(1))
    usable = (F.col("at_s") - F.col("prev_.at_s") < most_age_s) & (F.col("total_usage") >= F.col("prev_.total_usage")) & (F.col("system_usage") > F.col("prev_.system_usage"))
    delta = (F.col("total_usage") - F.col("prev_.total_usage")) / (F.col("system_usage") - F.col("prev_.system_usage")) * n * 100.0
    return d.withColumn("cpu_percent", F.when(F.col("pre_system") > 0, own).when(usable, delta).otherwise(own)).drop("prev_")


def recent_samples(samples: DataFrame, n: int = 60) -> DataFrame:
    """The newest n samples of each container that the latest poll has."""
    latest = samples.agg(F.max("at_s").alias("latest_"))
    here = samples.join(F.broadcast(latest), F.col("at_s") == F.col("latest_")).select("host", "id").distinct()
    w = W.partitionBy("host", "id").orderBy(F.desc("at_s"))
    return samples.join(here, ["host", "id"], "left_semi").withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= n).drop("rn_")


def sparkline(samples: DataFrame, value: str) -> DataFrame:
    """Between 0 and 1 within each container; a range under 2 counts as 2."""
    ends = samples.groupBy(F.col("host").alias("host_"), F.col("id").alias("id_")).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    d = samples.join(ends, F.col("host").eqNullSafe(F.col("host_")) & F.col("id").eqNullSafe(F.col("id_")))
    return d.withColumn("level", (F.col(value) - F.col("lo_")) / F.greatest(F.col("hi_") - F.col("lo_"), F.lit(2.0))).drop("host_", "id_", "lo_", "hi_")


def images(rows: DataFrame) -> DataFrame:
    """A row an image and host, by short id; tags as the engine gives them."""
    return rows.withColumn("id", short_id(F.col("id")))


def volumes(rows: DataFrame) -> DataFrame:
    """A row a volume and host; entries that an engine leaves empty go."""
    return rows.filter(F.col("name").isNotNull())


def live_and_removed(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Inventory rows of the engines, and those of removed containers that are stored."""
    return live.unionByName(removed_rows(stored, live), allowMissingColumns=True)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """What a filter can offer: the column's values in order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def subnets(networks: DataFrame) -> DataFrame:
    return networks.withColumn("subnets", F.filter("subnets", lambda x: x != "")).withColumn("id", short_id(F.col("id")))


def text_filter(df: DataFrame, text: str) -> DataFrame:
    row = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]))
    return df.filter(F.contains(row, F.lit(text.lower()))) if text else df


def host_outcome(results: DataFrame) -> DataFrame:
    """Per project: hosts that succeeded and failed, and the failures' texts."""
    return results.groupBy("project").agg(F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors"))


def nearest_rank(df: DataFrame, value: str, keys: list[str], at: list[float] = [0.5, 0.95, 0.99], accuracy: int = 10_000) -> DataFrame:
    """Nearest-rank percentiles, the maximum and the number of values, exact; nulls don't count.

    A sketch gives values that a rank surely lies between: its ranks are off by one in `accuracy` at most. What is below is counted;
    only the distinct values between, a small share of all, are ranked, by slices.
    """
    same = lambda names: [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v_"))
    off, renamed = 2 / accuracy, [f"{k}__" for k in keys]
    ends = F.percentile_approx("v_", [x for p in at for x in (max(0.0, p - off), min(1.0, p + off))], accuracy)
    facts = d.groupBy(*keys).agg(F.count("*").alias("n_"), F.max("v_").alias("max_"), ends.alias("ends_"))
    near = d.join(facts.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed)], "ends_"), same(renamed)).drop(*renamed)
    lo, hi = (lambda i: F.col("ends_")[2 * i]), (lambda i: F.col("ends_")[2 * i + 1])
    below = near.groupBy(*keys).agg(*[F.count_if(F.col("v_") < lo(i)).alias(f"below{i}_") for i in range(len(at))])
    which = F.explode(F.array_compact(F.array(*[F.when(F.col("v_").between(lo(i), hi(i)), F.lit(i)) for i in range(len(at))])))
    between = near.select(*keys, "v_", which.alias("i_")).groupBy(*keys, "i_", "v_").agg(F.count("*").alias("same_"))
    between = running_sum(value_slices(between, [*keys, "i_"], "v_"), [*keys, "i_"], F.col("slice_no"), ["v_"], F.col("same_"), "rank_")
    facts = facts.join(below.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed)], *[f"below{i}_" for i in range(len(at))]), same(renamed)).drop(*renamed)
    joined = facts.join(between.withColumnsRenamed(dict(zip(keys, renamed))), same(renamed))
    picks = []
    for i, p in enumerate(at):
        rank = F.greatest(F.ceil(F.col("n_") * p), F.lit(1)) - F.col(f"below{i}_") - F.col("rank_")
        picks.append(F.max(F.when((F.col("i_") == i) & (rank >= 1) & (rank <= F.col("same_")), F.col("v_"))).alias(f"p{round(100 * p)}"))
    return joined.groupBy(*keys).agg(*picks, F.max("max_").alias("max"), F.max("n_").alias("n"))


def rates(df: DataFrame, value: str, at: str, keys: list[str], slice_width: int = 86_400) -> DataFrame:
    """Change per unit of `at` (an integer) against the row before; a counter's first row has none."""
    d = previous(df, keys, slice_width, [at], [value, at])
    return d.withColumn("rate", (F.col(value) - F.col("prev_")[value]) / F.nullif(F.col(at) - F.col("prev_")[at], F.lit(0))).drop("prev_")


def extent(df: DataFrame, value: str, at: str, keys: list[str]) -> DataFrame:
    """Per key the peak, the first and the last value."""
    return df.groupBy(*keys).agg(F.max(value).alias("peak"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))


def used_percent(stored: DataFrame, total_mb: int) -> DataFrame:
    return stored.agg((F.coalesce(F.sum("stored_bytes"), F.lit(0)) / float(total_mb << 20) * 100.0).alias("used_percent"))


def dig(inspect: Column, *path: str) -> Column:
    """A scalar inside an inspect document, else the empty string."""
    v = F.get_json_object(inspect, "$" + "".join(f"['{p}']" for p in path))
    return F.coalesce(F.when(~v.rlike(r"^\s*[\[{]"), v), F.lit(""))


def own_env(env: DataFrame, managed: list[str]) -> DataFrame:
    """Environment entries without those that a platform manages."""
    return env.filter(~F.col("key").isin(managed))
