"""The folder that every executor reaches, for tables written on the way."""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where it is unset, which only a local master can use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="tidewater-")
    return f"file://{_OWN_DIRS[app]}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it doesn't exist."""
    fs, hadoop = _file_system(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def _delete_at_exit(spark, path):
    try:
        delete(spark, path)
    except Exception:  # the session may have ended already
        pass


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written and read again: lineage ends there. The path is for `delete`, once they aren't needed."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete_at_exit, spark, path)
    return path
