"""Container engines as a data source: `spark.read.format("engine")`, and `readStream` for what follows.

Each host is a partition, read by its own task. In a batch, a host that fails gives a row with its error and doesn't stop the others. A
stream's offset is, for each host, the engine's own time up to which was read, so that a batch that is run again reads the same span of each
host again. A host whose clock can't be read keeps its offset while the others go on, and is read from there once it is back. One that fails
within its span fails the task, and after Spark's retries the stream, which goes on from its checkpoint: nothing is lost. A host that is down
just when a stream is restarted is read again from `since_ns` on later, as a source isn't told its old offset; `ingest` drops what it has.

Options: `hosts`, a JSON list of [host, address]; `client`, the import path `module:name` of a callable that takes an address and returns an
object with `now() -> int` (the engine's clock, in ns) and `read(table, since_ns, until_ns) -> iterable of dicts`, from since_ns on, before
until_ns; `table`, one of TABLES. Clients are made in the tasks, so that they need not be pickled.
"""
from __future__ import annotations

import importlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewater.schemas import LOG_LINES

TABLES = {
    "logs": LOG_LINES,
    "containers": "host string, id string, names array<string>, image string, state string, status string, labels map<string,string>, created bigint",
    "events": "host string, id string, type string, action string, attributes map<string,string>, time_s bigint, time_ns bigint",
    "stats": "host string, id string, at_s bigint, cpu bigint, system bigint, online int, memory bigint, memory_limit bigint",
}
ERROR = "error"
# What engines say of a log that cannot be read at all.
UNREADABLE = ("does not support reading", "cannot read logs")
EVER_NS = (1 << 63) - 1


@dataclass
class Span(InputPartition):
    host: str
    address: str
    since_ns: int
    until_ns: int


def _options(options) -> tuple[list[tuple[str, str]], str, str]:
    if options.get("table") not in TABLES:
        raise ValueError(f"option table must be one of {', '.join(TABLES)}")
    hosts = [(str(h), str(a)) for h, a in json.loads(options["hosts"])]
    if len({h for h, _ in hosts}) < len(hosts):
        raise ValueError("hosts must differ")
    return hosts, options["client"], options["table"]


def _client(path: str, address: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)(address)


def _rows(part: Span, client: str, table: str, columns: list[str]):
    """Rows as they come; an error ends the host's rows with a row of its own."""
    if part is None:  # no hosts
        return
    try:
        for r in _client(client, part.address).read(table, part.since_ns, part.until_ns):
            yield tuple(part.host if c == "host" else r.get(c) for c in columns)
    except Exception as e:  # whatever a host does, the others are read
        yield tuple(part.host if c == "host" else (f"{e}" or type(e).__name__) if c == ERROR else None for c in columns)


class _Reader(DataSourceReader):
    def __init__(self, options, columns):
        self.hosts, self.client, self.table = _options(options)
        self.since, self.until, self.columns = int(options.get("since_ns", 0)), int(options.get("until_ns", EVER_NS)), columns

    def partitions(self):
        return [Span(h, a, self.since, self.until) for h, a in self.hosts]

    def read(self, partition):
        return _rows(partition, self.client, self.table, self.columns)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options, columns):
        self.hosts, self.client, self.table = _options(options)
        self.since, self.columns, self.at = int(options.get("since_ns", 0)), columns, {}

    def initialOffset(self):
        return {h: self.since for h, _ in self.hosts}

    def latestOffset(self):
        for h, a in self.hosts:
            try:
                self.at[h] = max(int(_client(self.client, a).now()), self.at.get(h, self.since))
            except Exception:
                self.at.setdefault(h, self.since)
        return dict(self.at)

    def partitions(self, start, end):
        """Of the hosts whose offset has advanced."""
        self.at = {**self.at, **{h: max(t, self.at.get(h, t)) for h, t in end.items()}}
        return [Span(h, a, start.get(h, self.since), end[h]) for h, a in self.hosts if end.get(h, 0) > start.get(h, self.since)]

    def read(self, partition):
        for r in _client(self.client, partition.address).read(self.table, partition.since_ns, partition.until_ns):
            yield tuple(partition.host if c == "host" else r.get(c) for c in self.columns)

    def commit(self, end):
        pass


class EngineSource(DataSource):
    @classmethod
    def name(cls):
        return "engine"

    def schema(self):
        return f"{TABLES[self.options['table']]}, {ERROR} string" if self.options.get("table") in TABLES else _options(self.options)

    def reader(self, schema: StructType):
        return _Reader(self.options, schema.fieldNames())

    def streamReader(self, schema: StructType):
        return _StreamReader(self.options, schema.fieldNames())


def engines(spark: SparkSession, hosts: list[tuple[str, str]], client: str, table: str, stream: bool = False, **options) -> DataFrame:
    """The table of all hosts, with `error` for those that failed."""
    spark.dataSource.register(EngineSource)
    reader = (spark.readStream if stream else spark.read).format("engine")
    return reader.options(hosts=json.dumps(hosts), client=client, table=table, **options).load()


def rows_and_errors(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was read, and host and error of those that failed."""
    return read.filter(F.col(ERROR).isNull()).drop(ERROR), read.filter(F.col(ERROR).isNotNull()).select("host", ERROR)


def outcomes(failures: DataFrame) -> DataFrame:
    """Of host, container_id and error (null: read): also whether the failure is permanent, as operators.backfill takes them."""
    said = F.lower(F.coalesce(F.col(ERROR), F.lit("")))
    permanent = F.lit(False)
    for text in UNREADABLE:
        permanent = permanent | F.contains(said, F.lit(text))
    return failures.withColumn("permanent", permanent)
