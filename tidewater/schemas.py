"""Schemas of the log tables. Times are epoch nanoseconds in bigint columns: Spark's timestamps hold microseconds only."""

LOG_LINES = "host string, container_id string, name string, compose_project string, rowid bigint, ts_ns bigint, stream tinyint, raw string"
GENERATIONS = ("host string, container_id string, name string, compose_project string, image string, first_seen_ms bigint, last_seen_ms bigint, "
               "removed_ms bigint, stored_bytes bigint, stdout_wm_ns bigint, stderr_wm_ns bigint, excluded_reason string")
RULES = ("id string, name string, enabled boolean, type string, hosts array<string>, containers array<string>, projects array<string>, "
         "events array<string>, min_level string, pattern string, threshold int, window_s int, cooldown_s int")
ALERTS = ("id string, rule_id string, rule_name string, type string, host string, container_id string, container_name string, reason string, "
          "sample string, count int, suppressed int, fired_at bigint")
