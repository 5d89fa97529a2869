"""Removal of repeated 20-word windows, found by fixed-block anchors.

Documents are packed into chunks of a few MB, written once. In each document, non-overlapping blocks of BLOCK words are reference
anchors, and every rolling window of BLOCK words is a probe. A repeat of WINDOW = 2 * BLOCK words holds a whole anchor of either
copy wherever it starts, so probes that meet no anchor of another place rule out all windows around them: no repeat is lost.

1. Chunks send the hashes of their anchors and probes to buckets of the hash space; a bucket tells each chunk which of its hashes
   are anchors that are probed from elsewhere too.
2. Chunks extend these hits: windows whose anchors are all hit are candidates, and runs of them are the maximal repeats. Their
   128-bit window hashes go to buckets, each chunk's first place of a window with it; the bucket tells a chunk which of its windows
   start there first of all (smallest doc_id, then smallest hash of the text, then smallest start).
3. Every candidate window that isn't the first is removed.

A window that lies in a third of all rows costs a bucket one entry for each chunk, not for each row. Buckets grow in number with
the input, so their size doesn't. Rows of written tables are large, so they go in small row groups. Shuffle files of a step are cleaned up when its result is written.

Defined cases: null and short texts lose nothing; rows with equal doc_ids are ordered by a 64-bit hash of the text, in chunks and buckets
alike, so results don't depend on partitions; equal rows: all but one lose all of their windows; null doc_ids come first; empty input gives no rows; other columns are not returned. Windows count as equal by two independent 64-bit
hashes of their words: among 10^13 windows, an unequal pair is taken for equal with a chance of about 10^-13.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import LARGE_ROWS, inside, is_not_space, materialize, ngram_hashes, row_slices, small_batches, split_words

WINDOW, BLOCK = 20, 10
CHUNK_BYTES = 2 << 20
#: Chunks whose hashes one bucket takes on average: a chunk has about a third of a million probes, so a bucket has under 3 million.
#: Each chunk sends every bucket one row; larger buckets keep these rows long.
CHUNKS_PER_BUCKET = 8
LEAST_BUCKETS = 16
_HALF = np.uint64(32)
#: Stands for a null doc_id in the order.
NULL_ID = -(1 << 63)


def _pack(batches):
    for whole in batches:
        for b in row_slices(whole, "text", CHUNK_BYTES):
            ids = pa.array([b.column("doc_id").cast(pa.int64()).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([b.column("text").to_pylist()], pa.list_(pa.string()))], names=["ids", "texts"])


def pack(docs: DataFrame) -> tuple[DataFrame, str]:
    """chunk, ids, texts."""
    small_batches(docs.sparkSession)
    packed = docs.select("doc_id", "text").mapInArrow(_pack, "ids array<long>, texts array<string>")
    return materialize(packed.select(F.monotonically_increasing_id().alias("chunk"), "ids", "texts"), "chunks", LARGE_ROWS)


class Chunk:
    """Rolling hashes of one chunk's documents, in the order of their ids."""

    def __init__(self, texts: pa.Array, twice: bool = False):
        w = split_words(texts, is_not_space(), twice=twice)
        self.words, n = w, len(w.hash)
        self.probe = ngram_hashes(w.hash, BLOCK)
        self.whole = inside(w.bounds, BLOCK, n)
        starts = np.repeat(w.bounds[:-1], np.diff(w.bounds))
        self.anchor = self.whole & ((np.arange(n) - starts)[: len(self.whole)] % BLOCK == 0)

    def sent(self):
        """Sorted distinct probe hashes; which of them are anchors (0, 1 or 2 for more); whether probed more than once."""
        at = np.flatnonzero(self.whole)
        h, inv, n = np.unique(self.probe[at], return_inverse=True, return_counts=True)
        anchors = np.bincount(inv[self.anchor[at]], minlength=len(h))
        return at, h, inv, np.minimum(anchors, 2), np.minimum(n, 2)

    def candidates(self, hit: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Starts of windows whose own anchors are all hit and that meet an anchor of another place."""
        n = len(self.words.hash) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        missed = np.concatenate(([0], np.cumsum(self.anchor & ~hit)))
        met = np.concatenate(([0], np.cumsum(hit & (~self.anchor | many))))
        reach = WINDOW - BLOCK + 1
        i = np.arange(n)
        ok = (missed[i + reach] == missed[i]) & (met[i + reach] > met[i])
        return np.flatnonzero(ok & inside(self.words.bounds, WINDOW, len(self.words.hash)))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> _HALF) * np.uint64(buckets)) >> _HALF).astype(np.int64)


def _lists(values: np.ndarray, cuts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _bytes(values: np.ndarray, cuts: np.ndarray) -> pa.BinaryArray:
    """A byte a value, cut into rows. As lists, a reader of a written table would hold several numbers for each of them."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.int8))])


def _chunks(batches):
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            ids = row.column("ids").flatten().to_pylist()
            ids = np.array([NULL_ID if x is None else x for x in ids], np.int64)
            yield row, ids, row.column("texts").flatten()


def _anchors(buckets):
    """Per bucket of the hash: hashes (32 bits within the bucket), 2 * anchors + (probed more than once)."""
    def run(batches):
        for row, _, texts in _chunks(batches):
            _, h, _, anchors, probes = Chunk(texts).sent()
            if not len(h):
                continue
            k = _bucket(h, buckets)  # sorted, as h is
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            cuts = np.append(at, len(h))
            yield pa.RecordBatch.from_arrays([
                pa.array(k[at]), pa.array(np.full(len(at), row.column("chunk")[0].as_py(), np.int64)),
                _lists(_within(h).view(np.int32), cuts, pa.int32()), _lists((2 * anchors + probes - 1).astype(np.int8), cuts, pa.int8()),
            ], names=["bucket", "chunk", "hashes", "kinds"])
    return run


def _within(h: np.ndarray) -> np.ndarray:
    """32 bits of a hash that, with its bucket, tell it from others: the low half of it."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _groups(values: np.ndarray):
    """inverse and number of the groups of equal values."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.concatenate((s[:1] == s[:1], s[1:] != s[:-1]))
    g = np.empty(len(values), np.int64)
    g[order] = np.cumsum(new) - 1
    return g, int(new.sum())


def _meet(t: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, 0, 1 (an anchor that is probed from elsewhere) or 2 (several anchors) by its hashes."""
    h = t.column("hashes").combine_chunks().flatten().to_numpy()
    kinds = t.column("kinds").combine_chunks().flatten().to_numpy()
    sizes = t.column("hashes").combine_chunks().value_lengths().to_numpy()
    g, n = _groups(h)
    anchors = np.bincount(g, weights=kinds >> 1, minlength=n)
    probes = np.bincount(g, weights=(kinds & 1) + 1, minlength=n)
    said = np.where((anchors >= 1) & (probes >= 2), np.where(anchors >= 2, 2, 1), 0).astype(np.int8)[g]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "said": _bytes(said, cuts)})


def _answers(row, column) -> np.ndarray:
    """The buckets' answers in the order of the chunk's sorted hashes."""
    got = row.column(column)[0].values
    if got is None or not len(got):
        return np.zeros(0, np.int8)
    order = np.argsort(got.field("bucket").to_numpy(zero_copy_only=False), kind="stable")
    return np.frombuffer(b"".join(got.field("said").take(pa.array(order)).to_pylist()), np.int8)


def _hits(row, texts):
    c = Chunk(texts, twice=True)
    at, h, inv, _, _ = c.sent()
    answer = _answers(row, "hits")
    hit, many = np.zeros(len(c.whole), bool), np.zeros(len(c.whole), bool)
    if len(answer):
        hit[at], many[at] = answer[inv] > 0, answer[inv] > 1
    return c, c.candidates(hit, many)


def _firsts(c: Chunk, ids, ties, at):
    """Of a chunk's candidate windows: sorted distinct hashes, and where each starts first."""
    full, full2 = ngram_hashes(c.words.hash, WINDOW)[at], ngram_hashes(c.words.hash2, WINDOW)[at]
    doc = np.searchsorted(c.words.bounds, at, side="right") - 1
    rank = _document_order(ids, ties)
    order = np.lexsort((at, rank[doc], full2, full))
    s, s2 = full[order], full2[order]
    new = np.flatnonzero(np.concatenate((s[:1] == s[:1], (s[1:] != s[:-1]) | (s2[1:] != s2[:-1]))))
    return s[new], s2[new], order[new], doc


def text_hash(text: str | None) -> int:
    """What orders documents of one doc_id."""
    return xxhash.xxh64_intdigest((text or "").encode()) - (1 << 63)


def _hashes(texts) -> np.ndarray:
    return np.fromiter((text_hash(t.as_py()) for t in texts), np.int64, len(texts))


def _document_order(ids, ties) -> np.ndarray:
    """Rank of each document by (doc_id, hash of the text)."""
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ties, ids))] = np.arange(len(ids))
    return rank


def _windows(buckets):
    def run(batches):
        for row, ids, texts in _chunks(batches):
            c, at = _hits(row, texts)
            if not len(at):
                continue
            ties = _hashes(texts)
            h, h2, first, doc = _firsts(c, ids, ties, at)
            k = _bucket(h, buckets)
            cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            cuts = np.append(cut, len(h))
            yield pa.RecordBatch.from_arrays([
                pa.array(k[cut]), pa.array(np.full(len(cut), row.column("chunk")[0].as_py(), np.int64)),
                _lists(h.view(np.int64), cuts, pa.int64()), _lists(h2.view(np.int64), cuts, pa.int64()), _lists(ids[doc[first]], cuts, pa.int64()),
                _lists(ties[doc[first]], cuts, pa.int64()), _lists((at[first] - c.words.bounds[doc[first]]).astype(np.int32), cuts, pa.int32()),
            ], names=["bucket", "chunk", "hashes", "hashes2", "docs", "ties", "starts"])
    return run


def _earliest(t: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, whether its first place of a window is the first of all."""
    flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy()
    h, h2, docs, ties, starts = flat("hashes"), flat("hashes2"), flat("docs"), flat("ties"), flat("starts")
    sizes = t.column("hashes").combine_chunks().value_lengths().to_numpy()
    chunk = np.repeat(t.column("chunk").to_numpy(), sizes)
    order = np.lexsort((chunk, starts, ties, docs, h2, h))
    s, s2 = h[order], h2[order]
    first = np.concatenate((s[:1] == s[:1], (s[1:] != s[:-1]) | (s2[1:] != s2[:-1])))
    said = np.zeros(len(h), np.int8)
    said[order[first]] = 1
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "said": _bytes(said, cuts)})


def _remove(batches):
    """Per document: words, words removed, and what is kept."""
    for row, ids, texts in _chunks(batches):
        c, at = _hits(row, texts)
        n = len(c.words.hash)
        gone = np.zeros(n + 1, np.int64)
        if len(at):
            _, _, first, _ = _firsts(c, ids, _hashes(texts), at)
            repeat = np.ones(len(at), bool)
            repeat[first[_answers(row, "firsts") > 0]] = False
            np.add.at(gone, at[repeat], 1)
            np.add.at(gone, at[repeat] + WINDOW, -1)
        covered = np.cumsum(gone[:n]) > 0
        b, out = c.words.bounds, []
        removed = np.concatenate(([0], np.cumsum(covered)))
        for i, text in enumerate(texts.to_pylist()):
            words = (text or "").encode().split()
            if removed[b[i + 1]] > removed[b[i]]:
                words = [w for w, g in zip(words, covered[b[i] : b[i + 1]].tolist()) if not g]
            out.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([
            row.column("ids").flatten(), pa.array(np.diff(b), pa.int64()),
            pa.array(removed[b[1:]] - removed[b[:-1]], pa.int64()), pa.array(out, pa.string()),
        ], names=["doc_id", "n_words", "n_removed", "kept"])


def _reply(said: DataFrame, name: str) -> tuple[DataFrame, str]:
    by_chunk = said.groupBy(F.col("chunk").alias("chunk_")).agg(F.collect_list(F.struct("bucket", "said")).alias(name))
    return materialize(by_chunk, name, LARGE_ROWS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by one space)."""
    chunks, _ = pack(docs)
    buckets = max(LEAST_BUCKETS, -(-chunks.count() // CHUNKS_PER_BUCKET))
    kind = "chunk long, bucket long, said binary"
    sent = chunks.mapInArrow(_anchors(buckets), "bucket long, chunk long, hashes array<int>, kinds array<tinyint>")
    hits, _ = _reply(sent.groupBy("bucket").applyInArrow(_meet, kind), "hits")
    with_hits = chunks.join(hits, F.col("chunk") == F.col("chunk_"), "left").drop("chunk_")
    sent = with_hits.mapInArrow(_windows(buckets), "bucket long, chunk long, hashes array<long>, hashes2 array<long>, docs array<long>, ties array<long>, starts array<int>")
    firsts, _ = _reply(sent.groupBy("bucket").applyInArrow(_earliest, kind), "firsts")
    both = with_hits.join(firsts, F.col("chunk") == F.col("chunk_"), "left").drop("chunk_")
    return both.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The contract, by definition: for tests."""
    import re

    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda r: (NULL_ID if r[0] is None else r[0], text_hash(r[1]))):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - WINDOW + 1):
            x = tuple(w[i : i + WINDOW])
            if x in seen:
                gone.update(range(i, i + WINDOW))
            seen.add(x)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, j, array_to_string(w[j:j + {WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS j FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT doc_id, j FROM p QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, j) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(j, j + {WINDOW})) AS at FROM r),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d),
k AS (SELECT t.doc_id, count(g.at) AS n_removed, string_agg(CASE WHEN g.at IS NULL THEN word END, ' ' ORDER BY t.at) AS kept FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.at = g.at GROUP BY t.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
