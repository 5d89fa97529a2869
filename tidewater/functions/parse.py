"""Log parsing as Column expressions: timestamp, cleaned message, level, structured field. No Python runs on the executors."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Level names by rising severity.
LEVELS = ["UNKNOWN", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "PANIC"]
# Words that name a level, by level.
WORDS = {
    "TRACE": ["trace", "trc"],
    "DEBUG": ["debug", "dbg", "dbug", "verbose"],
    "INFO": ["info", "inf", "information", "notice", "log"],
    "WARN": ["warn", "warning", "wrn"],
    "ERROR": ["error", "err", "fail", "failed", "exception"],
    "FATAL": ["fatal", "critical", "crit", "alert"],
    "PANIC": ["panic", "emergency", "emerg"],
}
# Words found anywhere in a message, most severe level first.
KEYWORDS = [
    ("PANIC", "panic|emergency"), ("FATAL", "fatal|critical|crit"), ("ERROR", "error|err|fail|failed|exception"),
    ("WARN", "warn|warning|wrn"), ("INFO", "info|inf|notice|log"), ("DEBUG", "debug|dbg"), ("TRACE", "trace|trc"),
]
# JSON keys of a level, and of a severity number.
JSON_LEVEL_KEYS = ["level", "lvl", "levelname", "level_name", "severity", "severity_text", "severityText", "log.level"]
JSON_NUMBER_KEYS = ["severity_number", "severityNumber"]
# Patterns of explicit levels and of fields.
SEVERITY_NUMBER = r'(?i)(?:^|[\s,{(\[])severity_?number\s*[:=]\s*"?([0-9]{1,3})"?'
KEYED_LEVEL = r'(?i)(?:^|[\s,{(\[])(?:level|lvl|level_?name|severity|severity_?text|log[._-]?level)\s*[:=]\s*"?([A-Za-z]+|[0-9]{1,3})"?'
PREFIX_LEVEL = r"(?i)^(?:\[|\(|<)?(trace|trc|debug|dbg|dbug|verbose|info|inf|information|notice|warn|warning|wrn|error|err|fatal|critical|crit|panic|emergency|emerg)(?:\]|\)|>|:|\s+-|\s+--|\s+)"
GLOG = r"^([IWEF])\d{4}\s"
FIELD = r"(?d)^([A-Za-z_][A-Za-z0-9_.-]*)\s*[:=]\s*(.+)\z"
STACK = r"^(?:at |File |Traceback |Caused by:|\.\.\. |goroutine )|^/[\s\S]*:"
PROBLEM = ["WARN", "ERROR", "FATAL", "PANIC"]
SGR = r"\x1b\[[0-9;]*m"

_SPACES = "\t\n\x0b\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Unicode white space from both ends."""
    return F.btrim(c, F.lit(_SPACES))


def clean_message(c: Column) -> Column:
    return trim(F.when(F.contains(c, F.lit("\x1b[")), F.regexp_replace(c, SGR, "")).otherwise(c))


def _has(low: Column, *words: str) -> Column:
    """Whether a text in lower case holds one of the words: cheap, and true of every text that a pattern with these words, ignoring the
    case of ASCII letters, finds something in. Most lines need no pattern then."""
    return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])


def severity(level: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for i, n in enumerate(LEVELS) for x in (F.lit(n), F.lit(i))]), F.coalesce(level, F.lit(""))), F.lit(0)).cast("tinyint")


_NAMES = [(w, level) for level, words in WORDS.items() for w in words] + [(str(10 * (i + 1)), n) for i, n in enumerate(LEVELS[1:7])]


def word_level(c: Column) -> Column:
    """Level of a word or of a number 10 to 60; quotes, brackets and blanks around it don't count."""
    w = F.lower(F.regexp_replace(c, r"""^["'\[\](){}<>: ,]+|["'\[\](){}<>: ,]+\z""", ""))
    return F.element_at(F.create_map(*[F.lit(x) for pair in _NAMES for x in pair]), w)


def otel_level(c: Column) -> Column:
    """Level of a severity number 1 to 24, four numbers to a level."""
    n = F.regexp_extract(c, r"^\s*\+?0*([1-9]\d?)\s*\z", 1)
    return F.element_at(F.create_map(*[F.lit(x) for k in range(1, 25) for x in (str(k), LEVELS[1 + (k - 1) // 4])]), n)


def _json_value(message: Column, key: str) -> Column:
    # only strings and numbers count: a nested value comes back as JSON text, a bracketed word such as [error] is none
    v = F.get_json_object(message, f"$['{key}']")
    return F.when(v.rlike(r"^\s*[\[{]") & (F.json_array_length(v).isNotNull() | F.json_object_keys(v).isNotNull()), "").otherwise(v)


def json_level(message: Column) -> Column:
    found = [word_level(_json_value(message, k)) for k in JSON_LEVEL_KEYS] + [otel_level(_json_value(message, k)) for k in JSON_NUMBER_KEYS]
    return F.when(message.startswith("{"), F.coalesce(*found))


def explicit_level(message: Column, low: Column) -> Column:
    """message must be trimmed; low: the same in lower case."""
    found = lambda pattern: F.regexp_extract(message, pattern, 1)  # noqa: E731  no match is an empty text, which names no level
    glog = F.element_at(F.create_map(*[F.lit(x) for x in ("I", "INFO", "W", "WARN", "E", "ERROR", "F", "FATAL")]), found(GLOG))
    number = F.when(F.contains(low, F.lit("severity")), otel_level(found(SEVERITY_NUMBER)))
    keyed = F.when(_has(low, "level", "lvl", "severity"), word_level(found(KEYED_LEVEL)))
    return F.coalesce(json_level(message), number, keyed, word_level(found(PREFIX_LEVEL)), glog)


def detect_level(message: Column, low: Column | None = None) -> Column:
    """message, and low, the same in lower case, should be plain columns, as they are looked at many times."""
    keyword, low = F.lit("UNKNOWN"), F.lower(message) if low is None else low
    for level, words in reversed(KEYWORDS):
        few = [w for w in words.split("|") if not any(o != w and o in w for o in words.split("|"))]
        keyword = F.when(_has(low, *few) & message.rlike(rf"(?i)(?<![0-9A-Za-z_])(?:{words})(?![0-9A-Za-z_])"), level).otherwise(keyword)
    return F.coalesce(explicit_level(message, low), keyword, F.lit("UNKNOWN"))


def structured_field(message: Column) -> tuple[Column, Column]:
    """Key and value, null where the message is no field."""
    m = trim(message)
    may = F.contains(m, F.lit(":")) | F.contains(m, F.lit("="))
    return F.when(may & m.rlike(FIELD), F.regexp_extract(m, FIELD, 1)), F.when(may & m.rlike(FIELD), trim(F.regexp_extract(m, FIELD, 2)))


def is_stack_line(message: Column) -> Column:
    return trim(message).rlike(STACK)


_BRACKET_SIGNS = "[](){}<>"
_BRACKETS = r"[\[\](){}<>]*"
_FRACTION = r"(?:[.,]\d{1,20})?"
_CLOCK = r"\d\d?:\d\d:\d\d"
_STAMPS = [
    rf"\d{{4}}-\d\d-\d\dT{_CLOCK}{_FRACTION}(?:Z|[+-]\d\d:?\d\d)?",
    rf"\d{{4}}-\d\d-\d\d {_CLOCK}{_FRACTION}",
    rf"\d{{4}}/\d\d/\d\d {_CLOCK}{_FRACTION}",
    rf"\d\d/[A-Z][a-z]{{2}}/\d{{4}}:{_CLOCK}{_FRACTION} [+-]\d{{4}}",
    rf"[A-Z][a-z]{{2}} [A-Z][a-z]{{2}} (?: \d|\d\d?) {_CLOCK}{_FRACTION} (?:(?:[A-Z]{{3,4}}|[+-]\d{{4}}) )?\d{{4}}",
]
_STAMP = rf"^({_BRACKETS})({'|'.join(_STAMPS)})({_BRACKETS})"


def with_timestamp(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds parsed_ns, epoch nanoseconds of the leading timestamp (null if there is none), and rest, the line after it.

    Each step is a column of its own: later steps look at it several times, and Spark keeps such columns apart.
    """
    df = df.withColumn("t_", trim(F.col(raw))).withColumn("found_", F.regexp_extract("t_", _STAMP, 0))
    df = df.withColumn("stamp_", F.btrim("found_", F.lit(_BRACKET_SIGNS)))
    short_hour = F.regexp_replace(F.regexp_replace("stamp_", r"(:\d\d)[.,]\d+", "$1"), r"([T :])(\d):(\d\d:)", "$10$2:$3")
    # the year first and two digits of the hour: all has its place, and most patterns can be left out
    df = df.withColumn("usual_", F.coalesce(F.substring("stamp_", 5, 1).isin("-", "/") & (F.substring("stamp_", 14, 1) == ":"), F.lit(False)))
    tail = F.substring("stamp_", F.lit(20), F.length("stamp_"))
    df = df.withColumn("bare_", F.when(F.col("usual_"), F.concat(F.substring("stamp_", 1, 19), F.regexp_replace(tail, r"^[.,]\d+", ""))).otherwise(short_hour))
    stamp, bare, usual = F.col("stamp_"), F.col("bare_"), F.col("usual_")
    fraction = F.rpad(F.regexp_extract(stamp, r":\d\d[.,](\d+)", 1), 9, "0").cast("bigint")
    zone = F.when(usual & (F.length(bare) <= 20), "").otherwise(F.regexp_extract(bare, r"([+-]\d\d:?\d\d)(?: \d{4})?\z", 1))
    day = F.regexp_extract(bare, r"^[A-Z][a-z]{2} [A-Z][a-z]{2} ( \d|\d\d?) ", 1)
    named = F.concat_ws(" ", F.regexp_extract(bare, r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) ", 1), F.lpad(F.trim(day), 2, "0"),
        F.regexp_extract(bare, r"(\d\d:\d\d:\d\d)", 1), F.regexp_extract(bare, r"(\d{4})\z", 1))
    plain = F.translate(F.substring(bare, 1, 19), "T/", " -")
    at = lambda text, layout: F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(layout + "X"))
    # a cast takes the same texts as the layout, but for the year 0
    seconds = F.unix_seconds(F.when(usual & ~bare.startswith("0000"), F.concat(plain, F.lit("Z")).try_cast("timestamp")).when(bare.rlike(r"^\d{4}"), at(plain, "yyyy-MM-dd HH:mm:ss")).when(bare.rlike(r"^\d\d/"),
        at(F.substring(bare, 1, 20), "dd/MMM/yyyy:HH:mm:ss")).when(bare.rlike("^[A-Z]"), at(named, "MMM dd HH:mm:ss yyyy")))
    df = df.withColumns({"zone_": zone, "seconds_": seconds, "fraction_": F.when((F.contains(stamp, F.lit(".")) | F.contains(stamp, F.lit(","))) & stamp.rlike(r":\d\d[.,]\d"), fraction).otherwise(0)})
    z = F.col("zone_")
    offset = F.when(z != "", (F.substring(z, 2, 2).cast("int") * 3600 + F.substring(z, -2, 2).cast("int") * 60) * F.when(z.startswith("-"), -1).otherwise(1)).otherwise(0)
    df = df.withColumn("parsed_ns", (F.col("seconds_") - offset) * 1_000_000_000 + F.col("fraction_"))
    rest = F.ltrim(F.substring("t_", F.length("found_") + 1, F.length("t_")), F.lit(_SPACES + ")]}>"))
    return df.withColumn("rest", F.when(F.col("seconds_").isNull(), F.col("t_")).otherwise(rest)).drop("t_", "found_", "stamp_", "usual_", "bare_", "zone_", "seconds_", "fraction_")


def with_parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds parsed_ns, message, level and severity of physical lines."""
    df = with_timestamp(df, raw).withColumn("message", clean_message(F.col("rest"))).drop("rest")
    df = df.withColumn("low_", F.lower("message")).withColumn("level", detect_level(F.col("message"), F.col("low_"))).drop("low_")
    return df.withColumn("severity", severity(F.col("level")))


def sample(message: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(message, F.lit("")), raw)
