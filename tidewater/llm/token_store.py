"""Content-addressed store of token ids.

Documents are encoded and ended with END. A rolling hash over ROLL ids cuts each document's stream into chunks of LEAST to MOST
ids, so equal passages give equal chunks wherever they stand. Tables in the store's folder:

- chunks: address (blake2b of the ids), ids (unsigned little-endian, 16 or 32 bits); every chunk once, in buckets of the address;
- recipes: part, doc_id, start, n_tokens, root (Merkle root over the addresses), parts (addresses); in ascending doc_id order;
- manifests: part, first and last doc_id, n_docs, n_tokens, root (Merkle root over the part's document roots);
- manifest: one row with the format, id width, end id, the tokenizer file's SHA-256, buckets, counts, and the root over the parts' roots.

`verify` and `reconstruct` need nothing but the folder. They rebuild every document from its recipe and the chunks as read: each
chunk's bytes must hash to its address, the addresses to the document's root, those to the part's, and those to the store's, else
they fail. Documents are rebuilt chunk by chunk, so a very long one is never held whole for it.

Ids are encoded piece by piece with a bounded table of pieces: the vocabulary's pre-tokenizer never joins across white space, so a
text's ids are those of its pieces.

Defined cases: a null or empty text has only END; rows with equal doc_ids are ordered by a hash of the text; empty input gives no
rows; other columns are ignored; a null doc_id comes first.
"""
from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import delete, exists, lower_ascii, materialize, mix, new_path, row_slices, shuffles_cleaned, small_batches, text_buffers

END, ROLL, LEAST, MOST, CUT_BITS = 2, 8, 128, 4096, 9
FORMAT, MOST_SEEN, MOST_BUCKETS = 1, 1_000_000, 50_000
CACHE_PIECES, SLOT_BITS, PIECE = 1_500_000, 22, 1 << 20
# fixed values: what the vocabulary's file says of its own normalizer and pre-tokenizer
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_PLAIN_WORD = re.compile(r"[!-~¡-ÿ]*")
_LOWER = lower_ascii()
#: 0 white space, 1 letters, 2 digits, 3 signs; 4 what makes a word a piece as it stands.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[[ord("'"), ord("|")]] = 4
#: Second bytes of the letters À to ÿ, in lower case.
_SECOND = np.zeros(256, np.uint8)
_SECOND[0x80:0xC0] = np.arange(0x80, 0xC0)
_SECOND[0x80:0x9F] += 0x20
_SECOND[[0x97, 0xB7]] = 0
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Growing:
    """An array that is appended to."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate((self.data[: self.n], np.zeros(self.n + 2 * len(more), self.data.dtype)))
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.data[at]


class Encoder:
    """ids of texts, through the tokenizers library, with pieces kept in a table of bounded size.

    A text's bytes are parted at white space, and words of letters up to ÿ, digits and ASCII signs into the vocabulary's own pre-token
    pieces, over whole Arrow buffers. A piece of up to 16 bytes is found in the table by all of its bytes, so equal keys are equal
    pieces; new ones go to the library's model many at a time. Words with anything else (an apostrophe, a bar, other letters) are
    pieces as they stand; what isn't Latin-1 goes through the library's whole pipeline. A file with another normalizer or
    pre-tokenizer than this one is used through the library alone.
    """

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        import os

        import regex
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), cache
        with open(path, "rb") as f:
            raw = f.read()
        self.sha256, file = hashlib.sha256(raw).hexdigest(), json.loads(raw)
        self.by_pieces = file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == PRE_TOKENIZER and file["model"].get("end_of_word_suffix") == WORD_END
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.last = np.zeros(self.size, bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith(WORD_END)
        self.pieces = regex.compile(PIECES).findall
        self._clear()

    def _clear(self) -> None:
        self.slots, self.slotless = np.full(1 << SLOT_BITS, -1, np.int32), {}
        self.heads, self.tails, self.lens = Growing(np.uint64), Growing(np.uint64), Growing(np.int8)
        self.at, self.count, self.ids = Growing(np.int64), Growing(np.int32), Growing(self.dtype)

    def _library(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of lower-case pieces without white space, and how many each has. The last token of a piece is marked in the
        vocabulary, which parts the ids again."""
        groups, out, counts = [pieces[i : i + 128] for i in range(0, len(pieces), 128)], [], []
        for group, ids in zip(groups, self._library([" ".join(g) for g in groups], self.model)):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                counts.append(np.diff(ends, prepend=0))
            else:
                each = self._library(group)
                counts.append(np.array([len(x) for x in each], np.int64))
                ids = np.concatenate(each)
            out.append(ids)
        return _all(out, self.dtype), _all(counts, np.int64)

    def _by_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words as they stand."""
        plain = {w: self.pieces(w.lower()) for w in words if _PLAIN_WORD.fullmatch(w) and "<|" not in w}
        some = sorted({p for ps in plain.values() for p in ps})
        ids, n = self._by_model(some)
        known = dict(zip(some, np.split(ids, np.cumsum(n)[:-1])))
        rest = [w for w in words if w not in plain]
        whole = dict(zip(rest, self._library(rest)))
        got = [_all([known[p] for p in plain[w]], self.dtype) if w in plain else whole[w] for w in words]
        return _all(got, self.dtype), np.array([len(x) for x in got], np.int64)

    def _learn(self, new: dict[bytes, bool]) -> None:
        """Adds pieces (their bytes, and whether they are words as they stand) to the table."""
        words = [b for b, whole in new.items() if not whole] + [b for b, whole in new.items() if whole]
        k, n = len(new) - sum(new.values()), self.count.n
        for own, by in ((words[:k], self._by_model), (words[k:], self._by_words)):
            ids, count = by([b.decode() for b in own])
            self.at.add(self.ids.n + np.cumsum(count) - count)
            self.count.add(count)
            self.ids.add(ids)
        buf, lens = np.frombuffer(b"".join(words) + bytes(8), np.uint8), np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lens)
        head, tail, key = _keys(buf, ends - lens, ends)
        self.heads.add(head)
        self.tails.add(tail)
        self.lens.add(np.minimum(lens, 17))
        left = np.flatnonzero(lens <= 16)
        for slot in _slots(key):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = n + free
            left = left[self.slots[slot[left]] != n + left]
        for i in [*left.tolist(), *np.flatnonzero(lens > 16).tolist()]:
            self.slotless[words[i]] = n + i

    def _find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The table's entries of the pieces buf[start:end]."""
        head, tail, key = _keys(buf, start, end)
        n, found, left = end - start, np.full(len(start), -1, np.int64), np.arange(len(start))
        n = np.where(n > 16, -1, n)

        def look(left):
            for slot in _slots(key):
                e = self.slots[slot[left]]
                ok = np.flatnonzero((e >= 0) & (self.heads.of(e) == head[left]) & (self.tails.of(e) == tail[left]) & (self.lens.of(e) == n[left])) if self.count.n else left[:0]
                found[left[ok]] = e[ok]
                left = left[found[left] < 0]
            return left

        left = look(left)
        if len(left):
            raw = buf.tobytes()
            new = dict(zip([raw[x:y] for x, y in zip(start[left].tolist(), end[left].tolist())], word[left].tolist()))
            for b in new.keys() & self.slotless.keys():
                del new[b]
            if new:
                self._learn(new)
                left = look(left)
            found[left] = [self.slotless[raw[x:y]] for x, y in zip(start[left].tolist(), end[left].tolist())]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if not self.by_pieces:
            got = self._library([t or "" for t in texts.to_pylist()])
            return np.concatenate([np.zeros(0, self.dtype), *got]), np.array([len(x) for x in got], np.int64)
        data, off = text_buffers(texts)
        out, counts = [np.zeros(0, self.dtype)], np.zeros(len(texts), np.int64)
        for lo, hi in spans(data, off, _CLASS == 0):
            if self.count.n > self.most:
                self._clear()
            buf, start, end, word = _split(data[lo:hi], off[(off > lo) & (off < hi)] - lo)
            if not len(start):
                continue
            e = self._find(buf, start, end, word)
            n = self.count.of(e)
            cum = np.cumsum(n, dtype=np.int64)
            out.append(self.ids.of(np.repeat(self.at.of(e) - cum + n, n) + np.arange(cum[-1])))
            row = np.searchsorted(off, start + lo, side="right") - 1
            counts += np.bincount(row, weights=n, minlength=len(counts)).astype(np.int64)
        return np.concatenate(out), counts


def _all(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def spans(data: np.ndarray, off: np.ndarray, space: np.ndarray):
    """The data in spans of about PIECE bytes that end at white space or at a row's edge; a longer word stays whole."""
    n, pos = len(data), 0
    while pos < n:
        stop = min(n, pos + PIECE)
        while stop < n:
            edges = off[(off > pos) & (off <= stop)]
            gaps = np.flatnonzero(space[data[pos + 1 : stop]])
            last = max(int(edges[-1]) if len(edges) else pos, pos + 1 + int(gaps[-1]) if len(gaps) else pos)
            if last > pos:
                stop = last
                break
            stop = min(n, stop + PIECE)
        yield pos, stop
        pos = stop


def _split(b: np.ndarray, edges: np.ndarray):
    """The bytes (padded), with plain words in lower case; starts and ends of pieces; which pieces are words as they stand."""
    kind, low, n = _CLASS[b], _LOWER[b], len(b)
    two = np.flatnonzero(b[:-1] == 0xC3)  # À to ÿ, but for the signs × and ÷
    two = two[_SECOND[b[two + 1]] > 0]
    kind[two] = kind[two + 1] = 1
    low[two + 1] = _SECOND[b[two + 1]]
    wordly = kind > 0
    cut = np.zeros(n + 1, bool)  # before this byte
    cut[0] = cut[n] = True
    cut[edges] = True
    cut[1:n] |= ~wordly[:-1]
    first = np.flatnonzero(wordly & cut[:n])
    after = cut.copy()
    after[1:n] |= ~wordly[1:]
    last = np.flatnonzero(wordly & after[1:]) + 1
    odd = np.concatenate(([0], np.cumsum(kind == 4, dtype=np.int64)))
    whole = odd[last] > odd[first]
    within = np.zeros(n + 1, np.int8)
    within[first[whole]] += 1
    within[last[whole]] -= 1
    within = np.cumsum(within[:n], dtype=np.int8) > 0
    inner = np.zeros(n + 1, bool)
    inner[1:n] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~within[1:]
    start = np.flatnonzero(wordly & (cut | inner)[:n])
    end = np.flatnonzero(wordly & (after | inner)[1:]) + 1
    buf = np.zeros(n + 8, np.uint8)
    buf[:n] = np.where(within, b, low)
    return buf, start, end, within[start]


def _keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """First and last eight bytes of each piece (the last ones: 0 for up to eight), and their hash. buf ends with eight zeros."""
    n = end - start
    eight = np.ndarray((len(buf) - 7,), "<u8", buf.data, strides=(1,))
    head = eight[start] & _MASK[np.minimum(n, 8)]
    tail = np.zeros(len(start), np.uint64)
    far = np.flatnonzero(n > 8)
    tail[far] = eight[end[far] - 8]
    return head, tail, mix(head + tail * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))


def _slots(key: np.ndarray):
    return (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (key & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _candidates(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the ROLL ids before them says to cut."""
    if len(ids) < ROLL:
        return np.zeros(0, np.int64)
    t = mix(ids.astype(np.uint64) + np.uint64(1)).astype(np.uint32)
    roll = np.zeros(len(ids) - ROLL + 1, np.uint32)
    for k in range(ROLL):
        roll = roll * np.uint32(0x9E3779B1) + t[k : len(ids) - ROLL + 1 + k]
    return np.flatnonzero(roll >> np.uint32(32 - CUT_BITS) == 0) + ROLL


def _ends(at: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids with these candidates."""
    if n <= LEAST:
        return [n]
    out, last = [], 0
    for c in [*at, n]:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST or c == n and c > last:
            out.append(c)
            last = c
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of a stream's chunks."""
    return _ends(_candidates(ids).tolist(), len(ids))


def address(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=20).digest()


class Merkle:
    """Root over leaves that are added one by one: pairs are hashed level by level, and a last one without a partner moves up as it
    is. Only one node a level is held."""

    def __init__(self, leaves=()):
        self.levels: list[bytes | None] = []
        for leaf in leaves:
            self.add(leaf)

    def add(self, node: bytes) -> None:
        for k, left in enumerate(self.levels):
            if left is None:
                self.levels[k] = node
                return
            self.levels[k], node = None, address(left + node)
        self.levels.append(node)

    def root(self) -> bytes:
        out = None
        for left in self.levels:
            if left is not None:
                out = left if out is None else address(left + out)
        return address(b"") if out is None else out


ENCODED = "doc_id long, order_ long, row long, n_tokens long, root binary, parts array<binary>, pieces array<binary>"


def _encode(path):
    def run(batches):
        enc, seen = encoder(path), set()
        wide = enc.dtype.itemsize
        for whole in batches:
            for b in row_slices(whole, "text"):
                ids, n = enc.encode(b.column("text"))
                ends = np.cumsum(n + 1)
                all_ = np.full(int(ends[-1]), END, enc.dtype)
                own = np.ones(len(all_), bool)
                own[ends - 1] = False
                all_[own] = ids
                raw, at = all_.tobytes(), _candidates(all_)
                begins = ends - n - 1
                lo, hi = np.searchsorted(at, begins + ROLL), np.searchsorted(at, ends)
                parts, pieces, roots = [], [], []
                for begin, size, x, y in zip(begins.tolist(), (n + 1).tolist(), lo.tolist(), hi.tolist()):
                    bounds = [begin, *(begin + c for c in _ends((at[x:y] - begin).tolist(), size))]
                    own_pieces = [raw[wide * u : wide * v] for u, v in zip(bounds, bounds[1:])]
                    own_parts = [address(x) for x in own_pieces]
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                    for j, a in enumerate(own_parts):  # a chunk leaves its task once, however often it occurs there
                        if a in seen:
                            own_pieces[j] = None
                        seen.add(a)
                    parts.append(own_parts)
                    pieces.append(own_pieces)
                    roots.append(Merkle(own_parts).root())
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").cast(pa.int64()), b.column("order_"), b.column("row"), pa.array(n + 1, pa.int64()), pa.array(roots, pa.binary()),
                    pa.array(parts, pa.list_(pa.binary())), pa.array(pieces, pa.list_(pa.binary())),
                ], names=["doc_id", "order_", "row", "n_tokens", "root", "parts", "pieces"])
    return run


def write(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> str:
    """Writes the store and returns its folder: `path`, which must not exist yet, or a new one that goes with the session."""
    spark = docs.sparkSession
    small_batches(spark)
    store, enc = path.rstrip("/") if path else new_path(spark, "tokens"), encoder(tokenizer_path)
    if path and exists(spark, store):
        raise FileExistsError(f"{store} already exists")
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("order_"), F.monotonically_increasing_id().alias("row"))
    encoded, encoded_path = materialize(named.mapInArrow(_encode(tokenizer_path), ENCODED), "encoded")
    pieces = encoded.select(F.explode(F.arrays_zip("parts",
        "pieces")).alias("x")).filter("x.pieces IS NOT NULL").select(F.col("x.parts").alias("address"), F.col("x.pieces").alias("ids"))
    n_parts = max(1, encoded.select("row").rdd.getNumPartitions())
    buckets = min(n_parts, MOST_BUCKETS)
    _write_bucketed(pieces.repartition(buckets, "address").sortWithinPartitions("address").dropDuplicates(["address"]), f"{store}/chunks", buckets)
    order = [F.col("doc_id").asc_nulls_first(), F.col("order_"), F.col("row")]
    ranged = encoded.drop("pieces").repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    ranged, ranged_path = materialize(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    whole = ranged.groupBy("part").agg(F.sum("n_tokens").alias("t"))  # one row a file, which is what is ordered here
    before = whole.select(F.col("part").alias("part_"), F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.join(before, F.col("part") == F.col("part_"))
    recipes = placed.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).select("part", "doc_id", "start", "n_tokens", "root", "parts")
    _write(recipes.repartitionByRange(n_parts, "start").sortWithinPartitions("start"), f"{store}/recipes")
    delete(spark, ranged_path)
    delete(spark, encoded_path)
    _write(_part_manifests(spark.read.parquet(f"{store}/recipes")), f"{store}/manifests")
    about = F.lit(FORMAT).alias("format"), F.lit(enc.dtype.itemsize).alias("id_bytes"), F.lit(END).alias("end_id"), F.lit(enc.sha256).alias("tokenizer_sha256"), F.lit(buckets).alias("n_buckets")
    _write(_top(spark, store).select(*about, "*"), f"{store}/manifest")
    return store


def _write(df: DataFrame, path: str) -> None:
    with shuffles_cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def _table_name() -> str:
    return f"spark_catalog.default.tidewater_{uuid.uuid4().hex[:12]}"


def _write_bucketed(chunks: DataFrame, path: str, buckets: int) -> None:
    """Chunks in buckets of their address: reading back joins recipes with them without shuffling them again."""
    spark, name = chunks.sparkSession, _table_name()
    with shuffles_cleaned(spark):
        chunks.write.format("parquet").mode("error").option("compression", "zstd").option("path", path).bucketBy(buckets, "address").sortBy("address").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay


def _bucketed(spark: SparkSession, store: str, buckets: int) -> DataFrame:
    name, path = _table_name(), f"{store}/chunks".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} (address BINARY, ids BINARY) USING parquet CLUSTERED BY (address) SORTED BY (address) INTO {buckets} BUCKETS LOCATION '{path}'")
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return chunks


def _roots(leaf_columns):
    """Manifests of runs of rows with one `part`, in order."""
    def run(batches):
        part, out, tree = None, None, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in leaf_columns)):
                if part is None or r[0] != part:
                    if part is not None:
                        yield _manifest(part, out, tree)
                    part, out, tree = r[0], [r[1], r[1], 0, 0], Merkle()
                out[1] = r[1]
                out[2] += 1
                out[3] += r[2]
                tree.add(r[3])
        if part is not None:
            yield _manifest(part, out, tree)
    return run


def _manifest(part, out, tree):
    values = [part, *out, tree.root()]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["part", "first_doc", "last_doc", "n_docs", "n_tokens", "root"])


def _part_manifests(recipes: DataFrame) -> DataFrame:
    """A row a part; a part's documents pass through one by one."""
    r = recipes.select("part", "doc_id", "n_tokens", "root", "start").repartition("part").sortWithinPartitions("part", "start")
    return r.drop("start").mapInArrow(_roots(["part", "doc_id", "n_tokens", "root"]), "part int, first_doc long, last_doc long, n_docs long, n_tokens long, root binary")


def _top(spark: SparkSession, store: str) -> DataFrame:
    """One row over all parts: their number, documents, ids and chunks, and the root over their roots."""
    m = spark.read.parquet(f"{store}/manifests")
    ordered = m.select(F.lit(0).alias("part"), F.col("part").cast("long").alias("doc_id"), "n_tokens", "root", "part").toDF("part", "doc_id",
        "n_tokens", "root", "at").coalesce(1).sortWithinPartitions("at")  # a row a file
    tree = ordered.drop("at").mapInArrow(_roots(["part", "doc_id", "n_tokens", "root"]), "part int, first_doc long, last_doc long, n_docs long, n_tokens long, root binary")
    counts = m.agg(F.count("*").alias("n_parts"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    chunks = spark.read.schema("address binary, ids binary").parquet(f"{store}/chunks").agg(F.count("*").alias("n_chunks"))
    return counts.join(chunks).join(tree.select("root"), how="left").withColumn("root", F.coalesce("root", F.lit(address(b""))))


def checked_manifest(spark: SparkSession, store: str) -> dict:
    """The store's top manifest; fails if parts, counts or roots don't fit the recipes and each other."""
    said = spark.read.parquet(f"{store}/manifest").collect()
    if len(said) != 1 or said[0].format != FORMAT:
        raise ValueError(f"{store} is no token store of format {FORMAT}")
    columns = ["part", "first_doc", "last_doc", "n_docs", "n_tokens", "root"]
    now, then = _part_manifests(spark.read.parquet(f"{store}/recipes")).select(*columns), spark.read.parquet(f"{store}/manifests").select(*columns)
    if now.unionAll(then).groupBy(*columns).count().filter("count <> 2").limit(1).count():
        raise ValueError("a part's documents do not fit its manifest")
    top = _top(spark, store).first()
    if any(top[c] != said[0][c] for c in top.asDict()):
        raise ValueError("the parts do not fit the store's manifest")
    return said[0].asDict()


def _placed_chunks(spark: SparkSession, store: str, buckets: int) -> DataFrame:
    """Every chunk of every document, in the documents' order within each partition."""
    recipes, chunks = spark.read.parquet(f"{store}/recipes"), _bucketed(spark, store, buckets)
    used = recipes.select("start", "doc_id", "n_tokens", "root", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("seq", "address"))
    found = used.join(chunks.withColumnRenamed("address", "address_"), F.col("address") == F.col("address_"), "left").drop("address_")
    return found.repartition("start").sortWithinPartitions("start", "seq")


def _documents(batches, wide: int, end: bytes):
    """(doc_id, start, n_tokens, its chunks' bytes): an iterator for each document, which must be read to its end."""
    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("start", "doc_id", "n_tokens", "root", "n", "seq", "address", "ids")))

    def chunks(first, group):
        tree, k, last = Merkle(), 0, b""
        for *_, seq, said, ids in group:
            if said is None:
                raise ValueError(f"the recipe of document {first[1]} is missing")
            if ids is None or address(ids) != said:
                raise ValueError(f"chunk {said.hex()} is missing or does not hash to its address")
            if seq != k:
                raise ValueError(f"a chunk of document {first[1]} is missing")
            tree.add(said)
            k, last = k + 1, ids
            yield ids
        if k != first[4] or tree.root() != first[3]:
            raise ValueError(f"the recipe of document {first[1]} does not give its root")
        if last[-wide:] != end:
            raise ValueError(f"document {first[1]} has no end")

    for _, group in groupby(rows(), key=lambda r: r[0]):
        first = next(group)
        yield first[1], first[0], first[2], chunks(first, chain([first], group))


def verify(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: documents rebuilt from the files, chunk by chunk; fails where they don't fit together."""
    small_batches(spark)
    about = checked_manifest(spark, store)
    wide, end = about["id_bytes"], about["end_id"].to_bytes(about["id_bytes"], "little")

    def run(batches):
        out = []
        for doc, start, n_tokens, chunks in _documents(batches, wide, end):
            crc = n = 0
            for ids in chunks:
                a = np.frombuffer(ids, f"<u{wide}")
                crc, n = zlib.crc32(a.astype("<u4").tobytes(), crc), n + len(a)
            if n != n_tokens:
                raise ValueError(f"document {doc} has {n} ids, not {n_tokens}")
            out.append((doc, start, n, crc))
            if len(out) == 4096:
                yield _verified(out)
                out = []
        if out:
            yield _verified(out)

    return _placed_chunks(spark, store, about["n_buckets"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _verified(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def reconstruct(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, ids."""
    small_batches(spark)
    about = checked_manifest(spark, store)
    wide, end = about["id_bytes"], about["end_id"].to_bytes(about["id_bytes"], "little")

    def run(batches):
        for doc, start, _, chunks in _documents(batches, wide, end):
            ids = np.frombuffer(b"".join(chunks), f"<u{wide}").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return _placed_chunks(spark, store, about["n_buckets"]).mapInArrow(run, "doc_id long, start long, ids array<long>")
