"""An engine's multiplexed log stream, as captured in files: frames of stdout and stderr, to lines."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A frame's header is the stream (1 stdout, 2 stderr), three zero bytes and the length, big-endian; a line that has not ended
# is flushed once it is longer than this.
HEADER, MOST_PENDING = 8, 1 << 20
MOST_ROWS, MOST_BYTES = 10_000, 4 << 20
STREAMS = {0: 0, 1: 0, 2: 1}
LINES = "path string, stream tinyint, line_no bigint, raw string, error string"


def decode(data: bytes, most: int = MOST_PENDING):
    """(stream, line, error): lines of each stream in the order they end; frames may end anywhere within a line. Empty lines are left out, and a
    trailing CR. A truncated or unknown frame ends the file with an error row; what was pending comes before it."""
    pending, at, error = {}, 0, None

    def ended(stream, line):
        line = line.removesuffix(b"\r")
        return [(stream, line.decode("utf-8", "replace"), None)] if line else []

    while at < len(data):
        size = int.from_bytes(data[at + 4 : at + HEADER], "big")
        if at + HEADER > len(data) or data[at] not in STREAMS or data[at + 1 : at + 4] != b"\0\0\0" or at + HEADER + size > len(data):
            error = f"broken frame at byte {at}"
            break
        stream = STREAMS[data[at]]
        *whole, rest = (pending.get(stream, b"") + data[at + HEADER : at + HEADER + size]).split(b"\n")
        for line in whole:
            if line:
                yield stream, line.removesuffix(b"\r").decode("utf-8", "replace"), None
        pending[stream] = rest
        if len(rest) > most:
            yield from ended(stream, pending.pop(stream))
        at += HEADER + size
    for stream in sorted(pending):
        yield from ended(stream, pending[stream])
    if error:
        yield None, None, error


def _lines(batches):
    """Lines of many files make a batch, of up to MOST_ROWS rows or MOST_BYTES: files may be small, or hold many lines."""
    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int8(), pa.int64(), pa.string(), pa.string()))],
            names=["path", "stream", "line_no", "raw", "error"])
        for c in columns:
            c.clear()
        return out

    columns, size = ([], [], [], [], []), 0
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content")):
            for no, (stream, line, error) in enumerate(decode(data.as_py() or b"")):
                for c, x in zip(columns, (path, stream, no, line, error)):
                    c.append(x)
                size += len(line or "")
                if len(columns[0]) >= MOST_ROWS or size >= MOST_BYTES:
                    yield batch()
                    size = 0
    if columns[0]:
        yield batch()


def framed_files(spark: SparkSession, path: str) -> DataFrame:
    """LINES of captured streams, a file being one container's; files are read in parallel. A broken file gives the lines before the fault
    and a row with its error, so one does not stop the others."""
    return lines_of(spark.read.format("binaryFile").load(path))


def lines_of(files: DataFrame) -> DataFrame:
    """files: path, content."""
    return files.select("path", "content").mapInArrow(_lines, LINES)
