"""Which days of a store a text search can leave closed.

For each day and container name the store may keep the set of three-letter ASCII sequences in its lower-case messages, one bit for each of the
128^3 there are: 256 KB at most, however many lines a day has, and only blocks of 4 KB with a bit in them are rows (`_skips/day=...`).
A search whose pattern demands some sequences opens only days that have them all. A day's set holds for the files it was made from; once
lines are appended or rewritten it no longer counts and the day is opened, until `write` (which compaction calls) makes it anew.
"""
from __future__ import annotations

import hashlib
import re
from datetime import date
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.operators.fold import parse

from .readers import listed, stored_lines
from .scratch import children

BLOCK_BITS = 32768  # of bitmap_construct_agg
SETS = "name string, block bigint, bits binary, files string, day date"
# What is alike to an ASCII letter for Java's matcher where case is ignored, and that letter.
ALIKE, LETTERS = "İıſK", "iisk"


def _home(store: str) -> str:
    return f"{store}/_skips"


def _sequences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?=([\x00-\x7f]{3}))"), F.lit(1))


def _files_digest(names: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(names))).encode()).hexdigest()


def write(spark: SparkSession, store: str, days: list[date] | None = None) -> None:
    """Makes the sets of these days (None: of all) anew. Files that are appended meanwhile only make a set count no longer."""
    of = F.col("day").isin([d for d in days if d is not None]) if days is not None else F.lit(True)
    parts = F.split("path", "/")
    files = listed(spark, store).select(F.to_date(F.regexp_extract("path", r"/day=(\d{4}-\d\d-\d\d)/[^/]+$", 1)).alias("day"), F.element_at(parts, -1).alias("f"))
    files = files.filter(F.col("day").isNotNull() & of).groupBy("day").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("f")), "\n"), 256).alias("files")).persist()
    files.count()  # listed before the lines are read
    low = F.lower("message")
    alike = F.when(F.col("message").rlike(f"[{ALIKE}]"), _sequences(F.lower(F.translate("message", ALIKE, LETTERS)))).otherwise(F.array().cast("array<string>"))
    seq = parse(stored_lines(spark, store).filter(of & F.col("day").isNotNull())).select("day", "name", F.explode(F.array_distinct(F.concat(_sequences(low), alike))).alias("s"))
    at = lambda i: F.ascii(F.substring("s", i, 1)).cast("bigint")
    n = seq.select("day", "name", (at(1) * 16384 + at(2) * 128 + at(3) + 1).alias("n")).distinct()
    sets = n.groupBy("day", "name", F.bitmap_bucket_number("n").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    none = files.select("day", *[F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("block", "bigint"), ("bits", "binary"))], "files")
    rows = sets.filter("name IS NOT NULL").join(F.broadcast(files), "day").unionByName(none)  # files: a row a day
    rows.repartition("day").sortWithinPartitions("day", "name", "block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(_home(store))
    files.unpersist()


def days_to_open(lines: DataFrame, name: str, parts: list[str]) -> set[date] | None:
    """lines: stored by day. Days whose messages under this name may hold all of the parts (texts in lower case, without a newline), and those
    without a set that counts. None if nothing can be said: parts have no ASCII sequence of three, or no sets were written."""
    wanted = {p[i : i + 3] for p in parts for i in range(len(p) - 2) if p[i : i + 3].isascii()}
    named = {}
    for f in lines.inputFiles() if wanted else []:
        store, _, rest = unquote(f).rpartition("/day=")
        named.setdefault(rest[:10], []).append(rest.rpartition("/")[2])
    if not named or "__HIVE_DEF" in named or not children(lines.sparkSession, _home(store)):
        return None
    bits = [(n // BLOCK_BITS + 1, n % BLOCK_BITS // 8 + 1, n % 8) for a, b, c in wanted for n in [ord(a) * 16384 + ord(b) * 128 + ord(c)]]
    probes = lines.sparkSession.createDataFrame(bits, "block bigint, byte_ int, bit_ int")
    sets = lines.sparkSession.read.schema(SETS).parquet(_home(store))
    counts = {r.day for r in sets.filter("name IS NULL").select("day", "files").collect() if r.files == _files_digest(named.get(str(r.day), []))}  # a row a day
    byte = F.conv(F.hex(F.substring("bits", F.col("byte_"), F.lit(1))), 16, 10).cast("int")
    of = sets.filter((F.col("name") == name) & F.col("block").isin(sorted({b[0] for b in bits})))
    held = of.join(F.broadcast(probes), "block").filter(F.getbit(byte, F.col("bit_")) == 1).groupBy("day").count().filter(F.col("count") == len(bits))
    hold = {r.day for r in held.select("day").collect()}
    return {d for d in map(date.fromisoformat, named) if d not in counts or d in hold}


def literals(pattern: str) -> list[str]:
    """Texts in lower case that whatever an RE2 pattern matches must hold, letter case aside: runs of plain characters outside groups, without
    what a quantifier makes optional. None are found in what this doesn't read (alternatives, quoting, escapes by number or name)."""
    out, run, i = [], "", 0

    def end() -> None:
        nonlocal run
        out.append(run)
        run = ""

    def past_class(i: int) -> int:
        i += 1 + pattern.startswith("[^", i)
        i += pattern.startswith("]", i)
        while i < len(pattern) and pattern[i] != "]":
            i = pattern.index(":]", i) + 2 if pattern.startswith("[:", i) and ":]" in pattern[i:] else i + 1 + (pattern[i] == "\\")
        return i + 1

    if r"\Q" in pattern:
        return []
    depth = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            end()
            i = past_class(i)
        elif c == "\\":
            e = pattern[i + 1 : i + 2]
            if e.isascii() and e.isalnum() and e not in "dDwWsSbBAz":
                return []
            if depth or e.isalnum() or not e.isascii():
                end()
            else:
                run += e
            i += 2
        elif c in "()":
            end()
            depth += 1 if c == "(" else -1
            i += 1
        elif depth:
            i += 1
        elif c == "|":
            return []
        elif c in "*?{":
            run = run[:-1]
            end()
            counts = re.match(r"\{\d+(,\d*)?\}", pattern[i:])
            i += counts.end() if counts else 1
        elif c in "+.^$\n" or not c.isascii():
            end()
            i += 1
        else:
            run += c.lower()
            i += 1
    end()
    return [x for x in out if len(x) > 2]
