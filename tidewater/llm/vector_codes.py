"""Product-quantisation codes of integer vectors, entries found by partial-distance search.

A vector is cut into PARTS equal parts; each part gets the index of the nearest entry of its codebook. The search goes over blocks of entries
and, within a block, over the part's dimensions from the one in which the codebook varies most. Squared differences are added up as
integers; an entry is dropped from a row's mask as soon as its sum strictly exceeds the best complete distance of the row so far. Entries
with equal distances are never dropped, and the lower index wins, so codes are those of a full search.

A round is one pass over the vectors: each task adds up its parts by entry, so a row for each (part, entry) and task is all that is
shuffled, and the codebooks are all that the driver holds. Codes are written once, then errors are summed over labels; labels with over a
thousandth of the rows (so at most a thousand) are joined by broadcast, the others by shuffle.

Defined cases: rows whose vector is null or holds null or non-finite components are left out. Codebooks have the length of the smallest
vec_id's vector among those whose number of components is a multiple of PARTS and not zero; a vector of another length keeps its row, with
null code and error, and has no part in codebooks. Equal vec_ids go by the vector, null ones last; fewer than ENTRIES vectors give shorter
codebooks. Repeated rows are rows of their own. An empty table gives no rows. Other columns are not returned. A component of 65,536 or more
is an error, as its distances could pass a long's range.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .centroid_clusters import finite, scaled
from .shared import materialize, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST, CHUNK, ENTRY_BLOCK, HOT = 1 << 24, 4096, 16, 1000


def nearest(x: np.ndarray, book: np.ndarray, block: int = ENTRY_BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Code and squared distance of each row of x (integers), and how many squared differences it took."""
    n, spread = len(x), book - book.mean(axis=0)
    order = np.argsort(-(spread * spread).sum(axis=0), kind="stable")  # most varying first
    x, book = x[:, order], book[:, order]
    # the first complete distance: the entry closest in the first dimension
    ranked = np.argsort(book[:, 0], kind="stable")
    edges = book[ranked, 0]
    at = np.searchsorted(edges, x[:, 0])
    lo, hi = np.maximum(at - 1, 0), np.minimum(at, len(book) - 1)
    code = ranked[np.where(np.abs(edges[lo] - x[:, 0]) <= np.abs(edges[hi] - x[:, 0]), lo, hi)]
    difference = x - book[code]
    best, steps = (difference * difference).sum(axis=1), x.size
    for base in range(0, len(book), block):
        entries = book[base : base + block]
        d = x[:, :1] - entries[None, :, 0]
        total = d * d
        steps += total.size
        alive = total <= best[:, None]
        rows, entry = np.nonzero(alive)
        total = total[alive]
        for j in range(1, x.shape[1]):
            d = x[rows, j] - entries[entry, j]
            total = total + d * d
            steps += len(d)
            alive = total <= best[rows]
            rows, entry, total = rows[alive], entry[alive], total[alive]
        if not len(rows):
            continue
        start = np.flatnonzero(np.concatenate(([True], np.diff(rows) > 0)))
        least = np.minimum.reduceat(total, start)
        size = np.diff(np.append(start, len(rows)))
        first = np.flatnonzero(total == np.repeat(least, size))  # by entry within a row
        first = first[np.concatenate(([True], np.diff(rows[first]) > 0))]
        r, c = rows[first], entry[first] + base
        wins = (least < best[r]) | (c < code[r])  # what is left is no farther
        best[r[wins]], code[r[wins]] = least[wins], c[wins]
    return code, best, steps


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * SCALE)
    if len(x) and np.abs(x).max() >= MOST:
        raise ValueError(f"a component of {MOST // SCALE} or more")
    return x.astype(np.int64)


def _sums(books: np.ndarray):
    """part, entry, n, total: of all vectors of a task."""
    parts, entries, width = books.shape

    def run(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                x = _integers(batch.column("embedding").slice(lo, CHUNK), parts * width)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    code, _, _ = nearest(own, books[p])
                    n[p] += np.bincount(code, minlength=entries)
                    for j in range(width):  # sums of a chunk are below 2 to the 53rd
                        total[p, :, j] += np.bincount(code, weights=own[:, j], minlength=entries).astype(np.int64)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"])

    return run


def _codes(books: np.ndarray | None):
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(lo, CHUNK)
                fits = np.zeros(batch.num_rows, bool)
                if books is not None:
                    parts, _, width = books.shape
                    vectors = batch.column("embedding")
                    fits = vectors.value_lengths().to_numpy(zero_copy_only=False) == parts * width
                code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
                if fits.any():
                    x = _integers(vectors.filter(pa.array(fits)), parts * width)
                    found = [nearest(x[:, p * width : (p + 1) * width], books[p])[:2] for p in range(parts)]
                    digits = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                    code[fits] = [row.tobytes().hex() for row in digits]
                    error[fits] = sum(d for _, d in found)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                    names=["vec_id", "label", "code", "error"])

    return run


def train(able: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position); able: vec_id, label, embedding without nulls."""
    whole = able.filter((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    ordered = lambda df, n: df.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(n).collect()
    smallest = ordered(whole, 1)
    if not smallest:
        return None
    dim = len(smallest[0].embedding)
    whole = whole.filter(F.size("embedding") == dim)
    first = np.array([scaled(r.embedding, SCALE) for r in ordered(whole, ENTRIES)])  # a codebook
    books = first.reshape(len(first), PARTS, dim // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = whole.select("embedding").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        sums = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in sums.collect():  # a number for each of the codebooks'
            books[r.part, r.entry, r["at"]] = r.s // r.n
    return books


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code, error of each vector kept, written; and the codebooks."""
    small_batches(vectors.sparkSession)
    kinds = dict(vectors.dtypes)
    able = vectors.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & finite(F.col("embedding")))
    books = train(able, rounds)
    coded, _ = materialize(able.mapInArrow(_codes(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    return coded, books


def decode(code: str, books: np.ndarray) -> list[int]:
    """The vector that a code stands for."""
    return [int(x) for p, e in enumerate(bytes.fromhex(code)) for x in books[p, e]]


def with_label_error(coded: DataFrame, hot: int = HOT) -> DataFrame:
    totals, _ = materialize(coded.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n_")), "labels")
    rows = totals.agg(F.sum("n_")).first()[0] or 0
    often, rare = totals.filter(F.col("n_") * hot > rows).drop("n_"), totals.filter(F.col("n_") * hot <= rows).drop("n_")
    of = F.col("label").eqNullSafe(F.col("label_"))
    out = coded.join(F.broadcast(often), of).drop("label_")  # at most `hot` labels
    return out.unionByName(coded.join(F.broadcast(often), of, "left_anti").join(rare, of).drop("label_"))


def digest(coded: DataFrame, books: np.ndarray | None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    numbers = "" if books is None else ",".join(map(str, books.reshape(-1).tolist()))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(vec_id, code, error, label_error, codebooks_sha256) by definition, in Python's integers: for tests with unique ids."""
    able = {i: (label, scaled(v, SCALE)) for i, label, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    dim = len(able[min(able)][1]) if able else 0
    width = dim // PARTS
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(PARTS)]
    pieces = {i: cut(v) for i, (_, v) in able.items()}
    books = [[pieces[i][p] for i in sorted(able)[:ENTRIES]] for p in range(PARTS)]
    for k in range(ROUNDS + 1):
        best = {i: [min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p])) for p, x in enumerate(v)] for i, v in pieces.items()}
        if k < ROUNDS:
            for p in range(PARTS):
                for n in range(len(books[p])):
                    if own := [pieces[i][p] for i in able if best[i][p][1] == n]:
                        books[p][n] = [sum(c) // len(own) for c in zip(*own)]
    error = {i: sum(d for d, _ in b) for i, b in best.items()}
    sums = {}
    for i, (label, _) in able.items():
        sums[label] = sums.get(label, 0) + error[i]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{n:02x}" for _, n in best[i]), error[i], sums[able[i][0]], sha) for i in able]


def _sql() -> str:
    """Unrolled rounds of a full search; all vectors must have one length."""
    distance = "list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""w AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
v AS (SELECT vec_id, label, list_transform(e, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM w WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM v, range({PARTS}) r(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM v ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS (SELECT p, c, x AS m FROM x JOIN f USING (vec_id))"""]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS (SELECT vec_id, x.p, any_value(x) AS x, min({{'d': {distance}, 'c': c}}) AS b FROM x JOIN c{i} USING (p) GROUP BY vec_id, x.p)")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (SELECT p, c, j, sum(x) AS s, count(*) AS n FROM (SELECT p, b.c AS c, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY p, c, j),
u{i} AS (SELECT p, c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY p, c),
c{i + 1} AS (SELECT p, c, coalesce(u{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN u{i} USING (p, c))""")
    return f"""WITH {', '.join(parts)},
o AS (SELECT vec_id, string_agg(lower(lpad(to_hex(b.c), 2, '0')), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h"""


SQL = _sql()
