"""What the training-data operators share: tables, the shared folder, word hashing."""
from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches: spark.checkpoint.dir; a folder of our own only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="tidewater-")
    return f"file://{_OWN_DIRS[app]}"


def small_batches(spark: SparkSession) -> None:
    """Long texts must not pile up in an Arrow batch: batches are bounded by bytes, not only by rows. The session keeps the setting, as
    results are evaluated later; a smaller one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).strip().lower().rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= 8 << 20):
        spark.conf.set(name, str(8 << 20))


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _delete_at_exit(spark, path):
    try:
        delete(spark, path)
    except Exception:  # the session may have ended already
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete_at_exit, spark, path)
    return path


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Shuffle files of what is written within go when it is written. The setting is the session's; jobs of other threads that run
    meanwhile lose their shuffle files at their own end too, which costs them no rows."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        spark.conf.set(cleanup, old)


#: For tables with rows of up to some MB. Parquet looks at sizes only every hundred rows and makes row groups of 128 MB, which readers
#: take in at once; with these options a page is a row or two, and a row group 16 MB.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}


def materialize(df: DataFrame, name: str, options: dict | None = None) -> tuple[DataFrame, str]:
    """Write to the shared folder and read again: lineage ends there, and so do the shuffle files that made it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with shuffles_cleaned(spark):
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def sheltered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns named u0, u1, ..., and the new name of each column: an operator's own names can't clash with them."""
    names = [f"u{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {c: u for u, c in zip(reversed(names), reversed(df.columns))}


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the crc32 of a text's UTF-8 bytes: each byte's step is an exclusive or of the steps of its bits."""
    def step(c):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        return c

    byte = "xor(c, b)"
    term = "c >> 8"
    for j in range(8):
        term = f"xor({term}, (({byte} >> {j}) & 1) * {step(1 << j)})"
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: {term}, CAST(4294967295 AS BIGINT)), 4294967295)"


# ---- words as 64-bit hashes, computed over whole Arrow buffers -------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE, _BASE2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_BYTE2 = mix(_BYTE) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def is_not_space() -> np.ndarray:
    """Bytes of `[^\\x20\\x09-\\x0D]`."""
    t = np.ones(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def is_word_byte() -> np.ndarray:
    """Bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing: digits, a-z and all beyond ASCII."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the rows; null rows are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """start, end: byte positions; hash, hash2: two hashes of the bytes; bounds[i]:bounds[i + 1] are the words of row i."""

    def __init__(self, data, offsets, start, end, hash_, hash2, bounds):
        self.data, self.offsets, self.start, self.end, self.hash, self.hash2, self.bounds = data, offsets, start, end, hash_, hash2, bounds


PIECE = 1 << 20


def _span_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray, by_byte: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of b[s:e]."""
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(by_byte[b] * powers(base, len(b)), out=total[1:])
    h = (total[e] - total[s]) * powers(pow(base, -1, 1 << 64), len(b) + 1)[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def split_words(column: pa.Array, wordly: np.ndarray, fold: np.ndarray | None = None, twice: bool = False) -> Words:
    """Words of the rows; with `twice`, under two independent hashes."""
    data, off = text_buffers(column)
    n, pos = len(data), 0
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    starts, ends, hashes, seconds = [], [], [], []
    while pos < n:
        stop = min(n, pos + PIECE)
        if stop < n:  # cut at a separator or at a row's edge; a word longer than a piece stays whole
            cut = np.flatnonzero(~wordly[fold[data[pos:stop]] if fold is not None else data[pos:stop]] | edge[pos:stop])
            if len(cut) and cut[-1]:
                stop = pos + int(cut[-1])
            else:
                far = np.flatnonzero(~wordly[fold[data[stop:]] if fold is not None else data[stop:]] | edge[stop:n])
                stop = stop + int(far[0]) if len(far) else n
        b = data[pos:stop]
        b = fold[b] if fold is not None else b
        w = wordly[b]
        first = w & np.concatenate(([True], ~w[:-1]))
        first |= w & edge[pos:stop]
        last = w & np.concatenate((~w[1:], [True]))
        last |= w & edge[pos + 1 : stop + 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(_span_hashes(b, s, e, _BYTE, _BASE))
        if twice:
            seconds.append(_span_hashes(b, s, e, _BYTE2, _BASE2))
        starts.append(s + pos)
        ends.append(e + pos)
        pos = stop
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    start = cat(starts, np.int64)
    return Words(data, off, start, cat(ends, np.int64), cat(hashes, np.uint64), cat(seconds, np.uint64), np.searchsorted(start, off))


_STEP = 0x9FB21C651E98DF25
_STEP_INV = pow(_STEP, -1, 1 << 64)


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i + k] for every i up to len(h) - k."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(_STEP, len(h)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_STEP_INV, len(h) + 1)[: len(h) - k + 1] + np.uint64(k))


def inside(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of the n - k + 1 windows of k words, those within one row."""
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(max(0, n - k + 1)) + k <= row_end[: max(0, n - k + 1)]


def row_slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """The batch in parts of up to `most` bytes of text; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64))
    lo = 0
    while lo < batch.num_rows:
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


import pyarrow.compute  # noqa: E402, F401  (pa.compute above)
