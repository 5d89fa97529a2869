"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters, digits and non-ASCII bytes. A window is WINDOW consecutive words of a benchmark item; an
item of fewer words is one window of its own. In every WINDOW words there are WINDOW - GRAM + 1 word GRAMs; their smallest hash is
the window's fingerprint, so two equal windows always share it. Benchmark fingerprints are joined with those of the documents;
each shared one is extended to the whole window, which is found by its own 64-bit hash and compared word by word, and to all
windows beside it.

A benchmark of at most BLOCK_WORDS words, which is a proven size, is broadcast, and documents are never shuffled. A larger one
stays a table of windows: rows of the documents get a key in a written table, their fingerprints are joined with the windows'
by shuffle, and only rows with a shared fingerprint are read again for the whole windows. Each row is judged by itself, by its key.

Defined cases: a null or wordless text has no words and isn't contaminated; a null item is ignored; equal rows give equal rows,
as many as there are; empty tables give no rows or no hits; other columns are not returned.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import inside, is_word_byte, lower_ascii, materialize, ngram_hashes, row_slices, sheltered, small_batches, split_words

WINDOW, GRAM = 13, 5
#: Words of the benchmark that are broadcast: about 40 bytes for each (its window and fingerprint, and the word), so 80 MB.
BLOCK_WORDS = 2_000_000
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType()))])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for every i up to len(x) - width, by doubling."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Lookup:
    """Hashes that are wanted, behind a bitmap that turns nearly all others away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = max(16, int(len(self.hashes)).bit_length() + 5)
        self.shift = np.uint64(64 - self.bits)
        self.map = np.zeros(1 << self.bits, dtype=bool)
        self.map[(self.hashes >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.map[(h >> self.shift).astype(np.int64)])
        if not len(at):
            return at
        i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[i] == h[at]]


def index_items(items: list[tuple[str, str]]) -> dict:
    """Fingerprints, by window length the windows (hash, item, first word, sorted by hash), and the items' words, joined by spaces."""
    words = split_words(pa.array([t for _, t in items], pa.large_string()), is_word_byte(), lower_ascii())
    raw, prints, windows = words.data.tobytes().lower(), [], {}
    length = np.minimum(WINDOW, np.diff(words.bounds))
    for k in np.unique(length[length > 0]).tolist():
        rows, starts, fingerprint, full = _windows(words, k)
        own = np.flatnonzero(length[rows] == k)
        own = own[np.argsort(full[own].view(np.uint64), kind="stable")]
        windows[k] = (full[own].view(np.uint64), rows[own].astype(np.int32), (starts[own] + words.bounds[rows[own]]).astype(np.int32))
        if k == WINDOW:
            prints.append(fingerprint[own].view(np.uint64))
    at = np.concatenate(([0], np.cumsum(words.end - words.start + 1)))
    joined = b" ".join(raw[s:e] for s, e in zip(words.start.tolist(), words.end.tolist()))
    return {"prints": np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64), "windows": windows, "items": [i for i, _ in items], "words": joined, "at": at}


def hits(words, index: dict, lookups: dict) -> list[tuple[int, int, int, list[str]]]:
    """(row, first word, end, items) of every window of the benchmark in the texts."""
    out, h, raw = [], words.hash, None
    for k, (full_of, item_of, start_of) in index["windows"].items():
        if len(h) < k:
            continue
        if k == WINDOW:
            at = lookups["prints"].find(sliding_min(ngram_hashes(h, GRAM), WINDOW - GRAM + 1))
        else:
            at = np.arange(len(h) - k + 1)
        if not len(at):
            continue
        full = ngram_hashes(h, k)
        at = at[lookups[k].find(full[at])]
        at = at[inside(words.bounds, k, len(h))[at]]
        if not len(at):
            continue
        raw = words.data.tobytes() if raw is None else raw
        rows = np.searchsorted(words.bounds, at, side="right") - 1
        first, last = np.searchsorted(full_of, full[at]), np.searchsorted(full_of, full[at], side="right")
        for r, i, x, y in zip(rows.tolist(), at.tolist(), first.tolist(), last.tolist()):
            text = b" ".join(raw[s:e] for s, e in zip(words.start[i : i + k].tolist(), words.end[i : i + k].tolist())).lower()
            same = [index["items"][item_of[j]] for j in range(x, y) if index["words"][index["at"][start_of[j]] : index["at"][start_of[j] + k] - 1] == text]
            if same:
                out.append((r, i, i + k, same))
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _found(shared, batches, text: str = "text"):
    """Of each part of the batches: the part, words per row, and by row the merged spans and the items."""
    index = shared.value
    lookups = {"prints": Lookup(index["prints"])} | {k: Lookup(v[0]) for k, v in index["windows"].items()}
    for whole in batches:
        for batch in row_slices(whole, text):
            words = split_words(batch.column(text), is_word_byte(), lower_ascii())
            found: dict[int, tuple[list, set]] = {}
            for row, s, e, items in hits(words, index, lookups):
                spans, names = found.setdefault(row, ([], set()))
                base = int(words.bounds[row])
                spans.append((s - base, e - base))
                names.update(items)
            yield batch, np.diff(words.bounds), {r: (merge(spans), sorted(names)) for r, (spans, names) in found.items()}


def _finder(shared):
    def find(batches):
        for batch, n_words, found in _found(shared, batches):
            rows = [found.get(r, ([], [])) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()),
                pa.array([[s for s, _ in x] for x, _ in rows], pa.list_(pa.int64())), pa.array([[e for _, e in x] for x, _ in rows], pa.list_(pa.int64())),
                pa.array([y for _, y in rows], pa.list_(pa.string())),
            ], names=FOUND.names)
    return find


def _keeper(shared, text: str):
    def keep(batches):
        for batch, n_words, found in _found(shared, batches, text):
            clean = np.ones(batch.num_rows, dtype=bool)
            for r, (spans, _) in found.items():
                clean[r] = 20 * sum(e - s for s, e in spans) < n_words[r]
            yield batch.filter(pa.array(clean))
    return keep


def _windows(words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of k words within a row: row, first word in it, fingerprint, hash."""
    h, gram = words.hash, min(GRAM, k)
    at = np.flatnonzero(inside(words.bounds, k, len(h)))
    rows = np.searchsorted(words.bounds, at, side="right") - 1
    return rows, at - words.bounds[rows], sliding_min(ngram_hashes(h, gram), k - gram + 1)[at].view(np.int64), ngram_hashes(h, k)[at].view(np.int64)


def _spelled(words, rows, starts, k: int) -> pa.Array:
    """The words of windows, in lower case, joined by spaces."""
    raw, at = words.data.tobytes(), (words.bounds[rows] + starts).tolist()
    begin, end = words.start, words.end
    return pa.array([b" ".join(raw[s:e] for s, e in zip(begin[i : i + k].tolist(), end[i : i + k].tolist())).lower() for i in at], pa.binary())


def _item_windows(batches):
    for whole in batches:
        for batch in row_slices(whole, "text"):
            words = split_words(batch.column("text"), is_word_byte(), lower_ascii())
            length = np.minimum(WINDOW, np.diff(words.bounds))
            for k in np.unique(length[length > 0]).tolist():
                rows, starts, prints, _ = _windows(words, k)
                own = np.flatnonzero(length[rows] == k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(prints[own]),
                    _spelled(words, rows[own], starts[own], k), batch.column("item_id").take(pa.array(rows[own])).cast(pa.string())],
                    names=["k", "print", "words", "item"])


def _row_prints(lengths):
    def run(batches):
        for whole in batches:
            for batch in row_slices(whole, "text"):
                words, key = split_words(batch.column("text"), is_word_byte(), lower_ascii()), np.asarray(batch.column("row_"))
                for k in lengths:
                    rows, _, prints, _ = _windows(words, k)
                    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (prints[1:] != prints[:-1])))[: len(rows)])
                    yield pa.RecordBatch.from_arrays([pa.array(key[rows[new]]), pa.array(np.full(len(new), k, np.int32)), pa.array(prints[new])], names=["row_", "k", "print"])
    return run


def _row_windows(batches):
    """Windows of the rows whose fingerprints are among the row's `shared` ones."""
    for whole in batches:
        for batch in row_slices(whole, "text"):
            words, key = split_words(batch.column("text"), is_word_byte(), lower_ascii()), np.asarray(batch.column("row_"))
            shared: dict[int, list[set]] = {}
            for i, xs in enumerate(batch.column("shared").to_pylist()):
                for x in xs:
                    shared.setdefault(x["k"], [set() for _ in range(batch.num_rows)])[i].add(x["print"])
            for k, wanted in shared.items():
                rows, starts, prints, _ = _windows(words, k)
                own = np.array([j for j, (r, x) in enumerate(zip(rows.tolist(), prints.tolist())) if x in wanted[r]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[rows[own]]), pa.array(np.full(len(own), k, np.int32)),
                    pa.array(starts[own].astype(np.int64)), _spelled(words, rows[own], starts[own], k)], names=["row_", "k", "start", "words"])


def _count_words(batches):
    for whole in batches:
        for batch in row_slices(whole, "text"):
            words = split_words(batch.column("text"), is_word_byte(), lower_ascii())
            yield pa.RecordBatch.from_arrays([batch.column("row_"), batch.column("doc_id").cast(pa.int64()),
                pa.array(np.diff(words.bounds), pa.int64())], names=["row_", "doc_id", "n_words"])


def _by_shuffle(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows: a written table with the key row_. row_ and the columns of FOUND, for every row."""
    windows, _ = materialize(items.mapInArrow(_item_windows, "k int, print long, words binary, item string").distinct(), "windows")
    lengths = sorted(r[0] for r in windows.select("k").distinct().collect())
    texts = rows.select("row_", "text")
    prints = texts.mapInArrow(_row_prints(lengths), "row_ long, k int, print long").distinct()
    shared = prints.join(windows.select("k", "print").distinct(), ["k", "print"]).groupBy("row_").agg(F.collect_list(F.struct("k", "print")).alias("shared"))
    near, _ = materialize(texts.join(shared, "row_").mapInArrow(_row_windows, "row_ long, k int, start long, words binary"), "near")
    hit = near.join(windows.select("words").distinct(), "words")
    spans = hit.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("k")).alias("end")))).alias("spans"))
    names = hit.select("row_", "words").distinct().join(windows.select("words", "item"), "words").groupBy("row_").agg(F.collect_set("item").alias("items"))
    out = rows.select("row_", "doc_id", "text").mapInArrow(_count_words, "row_ long, doc_id long, n_words long").join(spans, "row_", "left").join(names, "row_", "left")
    none = F.array().cast("array<bigint>")
    return out.select("row_", "doc_id", "n_words", F.coalesce("spans.start", none).alias("starts"), F.coalesce("spans.end", none).alias("ends"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _items(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, bool]:
    """The benchmark's items, and if they may be broadcast."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, total <= 2 * block_words  # a word and its separator take two bytes at least


def _index(items: DataFrame):
    return items.sparkSession.sparkContext.broadcast(index_items([(r[0], r[1]) for r in items.collect()]))


def _keyed(docs: DataFrame) -> DataFrame:
    return materialize(docs.withColumn("row_", F.monotonically_increasing_id()), "rows")[0]


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row: doc_id, n_words, starts and ends of hit runs (in words), items whose windows occur."""
    items, small = _items(benchmark, block_words)
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_finder(_index(items)), FOUND) if small else _by_shuffle(_keyed(docs), items).drop("row_")


def digest(found: DataFrame, *key: str) -> DataFrame:
    """The query's columns; runs may overlap."""
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["starts"], a["end"]))).alias("n"),
        F.greatest(a["end"], x["ends"]).alias("end"))
    n_hit = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step)["n"]
    return found.select(
        *key, "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows that aren't contaminated; each is judged by itself, whatever others share its doc_id."""
    items, small = _items(benchmark, block_words)
    rows, own = sheltered(docs)
    if small:
        return rows.mapInArrow(_keeper(_index(items), own["text"]), rows.schema).toDF(*docs.columns)
    rows = _keyed(rows)
    found = _by_shuffle(rows.select("row_", F.col(own["doc_id"]).alias("doc_id"), F.col(own["text"]).alias("text")), items)
    bad = digest(found, "row_").filter("contaminated").select("row_")
    return rows.join(bad, "row_", "left_anti").select(*[F.col(u).alias(c) for u, c in zip(rows.columns, docs.columns)])


def brute_force(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """The contract, by definition: for tests."""
    import re

    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: find.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        k = min(WINDOW, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, names = split(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit.update(range(i, i + k))
                    names |= windows[x]
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM (SELECT item_id, {_SPLIT} AS w FROM benchmark) WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM b)),
d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
p AS (SELECT doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT doc_id, j, p.k, item_id FROM p JOIN i ON p.x = i.x AND p.k = i.k),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS pos FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
