"""Readers: log files, NDJSON, environment files, JSON settings, and the stored lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.operators.live import split_lines
from tidewater.schemas import LOG_LINES


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their file; order within a file by rowid."""
    d = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    return split_lines(d.withColumn("rowid", F.monotonically_increasing_id())).drop("line_no")


def stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their day, by which the files are parted: queries that bound the time prune by it."""
    return spark.read.schema(LOG_LINES + ", day date").parquet(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The store's files, one row each; none is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "_metadata")


def follow(spark: SparkSession, path: str, schema: str = LOG_LINES, files_per_trigger: int = 100) -> DataFrame:
    """A stream over a folder of Parquet files. Back-pressure by files per trigger: nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines, heartbeats (no known column) and malformed lines are skipped."""
    d = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return d.dropna("all")


def env_pairs(lines: DataFrame) -> DataFrame:
    """key, value from lines of column `value`: blanks and comments go, split at the first `=`, matching quotes stripped."""
    t = F.trim("value")
    at = F.instr(t, "=")
    raw = F.trim(F.substring(t, at + 1, F.length(t)))
    value = F.regexp_replace(raw, r"""^(["'])(.*)\1\z""", "$2")
    return lines.filter((t != "") & ~t.startswith("#") & (at > 1)).select(F.trim(F.substring(t, F.lit(1), at - 1)).alias("key"), value.alias("value"))


def env_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What leads from old to new: keys to delete, keys to set."""
    gone = old.join(new.select("key"), "key", "left_anti").select("key", F.lit(None).cast("string").alias("value"), F.lit("delete").alias("change"))
    put = new.join(old.withColumnRenamed("value", "was"), "key", "left").filter(~F.col("value").eqNullSafe(F.col("was"))).select("key", "value", F.lit("set").alias("change"))
    return gone.unionByName(put)


def settings(spark: SparkSession, path: str, schema: str, most: int) -> DataFrame:
    """Rows of a JSON array file; a corrupt file gives none, and of more than `most` rows the first ones in the file's order count."""
    d = spark.read.text(path, wholetext=True)
    rows = F.slice(F.from_json("value", f"array<struct<{schema}>>"), 1, most)
    return d.select(F.explode(rows).alias("x")).select("x.*")
