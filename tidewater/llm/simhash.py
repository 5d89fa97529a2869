"""SimHash near-duplicates with bit-sliced comparison.

Equal fingerprints are one node. Their bits are cut into six, seven or eight blocks, the more the more fingerprints there are, and
fingerprints are put in buckets by every choice of all but four blocks: those that differ in four bits or fewer agree in one such
choice at least, so no link is lost whatever the number. Within a bucket the 64 bit planes are stored vertically, 64 fingerprints to
a word; differences to all of them are counted at once by carry-save counters, and words whose lanes all exceed the radius are
abandoned. Buckets over TILE members are compared in tiles, pair of blocks by pair of blocks; of each tile only a spanning forest
leaves, never all pairs.

Defined cases: null, empty and wordless texts have fingerprint zero; rows with equal doc_id are judged as they come, and share
components by their fingerprints; empty input gives no rows. The component of a null doc_id's row is that of its fingerprint.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .shared import materialize, row_slices, sheltered, small_batches

SHINGLE, RADIUS, TILE = 4, 4, 2048
#: Blocks become smaller, and keys of more bits, where a bucket would hold over so many fingerprints on average.
BUCKET, MOST_BLOCKS = 64, 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ENTRIES = 1 << 19


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.translate(_LOWER).split()  # bytes.split: runs of \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    if len(words) <= SHINGLE:
        return np.array([digest(joined, 42)], np.uint64)
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _prints(batches):
    for whole in batches:
        for batch in row_slices(whole, "text"):
            fp = [fingerprint(shingle_hashes((t or "").encode())) for t in batch.column("text").to_pylist()]
            rest = [c for c in batch.schema.names if c not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)),
                *[batch.column(c) for c in rest]], names=["doc_id", "fp", *rest])


def fingerprints(docs: DataFrame, *longs: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", *longs).mapInArrow(_prints, "doc_id long, fp long" + "".join(f", {c} long" for c in longs))


def linked_pairs(fp: np.ndarray, group: np.ndarray, side: np.ndarray | None, radius: int = RADIUS):
    """Chunks of (i, j), i < j, of equal group (and of unequal sides, if given) at most `radius` bits apart. group is sorted."""
    n = len(fp)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, n))
    words_of = (size + 63) // 64
    word0 = np.cumsum(words_of) - words_of
    g = np.repeat(np.arange(len(first)), size)
    lane = np.arange(n) - first[g]
    word, bit = word0[g] + lane // 64, (lane % 64).astype(np.uint64)
    at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    one = np.uint64(1)
    planes = [np.bitwise_or.reduceat(((fp >> np.uint64(j)) & one) << bit, at) for j in range(64)]
    valid = np.bitwise_or.reduceat(one << bit, at)
    reach = words_of[g] - lane // 64  # a row is compared with its own word and those after it
    cum = np.cumsum(reach)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + ENTRIES, side="right")))
        r = reach[lo:hi]
        q = np.repeat(np.arange(lo, hi), r)
        w = word[q] + np.arange(len(q)) - np.repeat(np.cumsum(r) - r, r)
        c0, c1, c2, over = (np.zeros(len(q), np.uint64) for _ in range(4))
        for j in range(64):
            d = planes[j][w] ^ (np.uint64(0) - ((fp[q] >> np.uint64(j)) & one))
            k0 = c0 & d
            c0 ^= d
            k1 = c1 & k0
            c1 ^= k0
            over |= c2 & k1  # eight
            c2 |= k1
            if j % 8 == 7:
                far = over | (c2 & (c1 | c0)) if radius == 4 else _beyond(c0, c1, c2, over, radius)
                keep = np.flatnonzero(~far & valid[w])
                if len(keep) < len(q):
                    q, w, c0, c1, c2, over = q[keep], w[keep], c0[keep], c1[keep], c2[keep], (over | (far & ~over))[keep]
                    if not len(q):
                        break
        if len(q):
            near = ~(over | _beyond(c0, c1, c2, over, radius)) & valid[w]
            own = w == word[q]
            near[own] &= ~((one << bit[q[own]]) | ((one << bit[q[own]]) - one))  # lanes after its own
            has = np.flatnonzero(near)
            lanes = np.unpackbits(near[has].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            e, l = np.nonzero(lanes)
            i = q[has[e]]
            j = i - lane[i] + (w[has[e]] - word0[g[i]]) * 64 + l
            if side is not None:
                ok = side[i] != side[j]
                i, j = i[ok], j[ok]
            yield i, j
        lo = hi


def _beyond(c0, c1, c2, over, radius):
    """Lanes whose three-bit count is over the radius (up to 7)."""
    out = over.copy()
    for k in range(radius + 1, 8):
        out |= (c0 if k & 1 else ~c0) & (c1 if k & 2 else ~c1) & (c2 if k & 4 else ~c2)
    return out


def forest(n: int, chunks) -> np.ndarray:
    """Root (smallest index) of each of n nodes under the given pairs."""
    root = np.arange(n)
    for i, j in chunks:
        while len(i):
            a, b = root[i], root[j]
            go = a != b
            i, j, a, b = i[go], j[go], a[go], b[go]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (nxt := root[root]).tolist() != root.tolist() if n < 64 else not np.array_equal(nxt := root[root], root):
                root = nxt
    return root


def _compare(batches):
    """Rows sorted by tile: key, tile, side, fp. A tile may go on in the next batch."""
    def edges(t):
        if not len(t[0]):
            return None
        key, tile, side, fp = t
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])))
        group = np.cumsum(new)
        size = np.bincount(group)[group]
        some = size > 1
        group, side, fp = group[some], side[some], fp[some].view(np.uint64)
        if not len(fp):
            return None
        root = forest(len(fp), linked_pairs(fp, group, None))
        has = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[has].view(np.int64)), pa.array(fp[root[has]].view(np.int64))], names=["src", "dst"])

    rest = None
    for b in batches:
        t = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if rest is not None:
            t = [np.concatenate(x) for x in zip(rest, t)]
        last = np.flatnonzero((t[0] != t[0][-1]) | (t[1] != t[1][-1])) if len(t[0]) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        if (out := edges([x[:cut] for x in t])) is not None:
            yield out
        rest = [x[cut:] for x in t]
    if rest is not None and (out := edges(rest)) is not None:
        yield out


def blocks_for(n: int) -> list[tuple[int, int]]:
    """First bit and width of each block, for n fingerprints."""
    b = RADIUS + 2
    while b < MOST_BLOCKS and n > BUCKET << (64 * (b - RADIUS) // b):
        b += 1
    widths = [64 // b + (i < 64 % b) for i in range(b)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _keys(blocks: list[tuple[int, int]], fp="fp"):
    """One key per choice of blocks: which choice, and the blocks' bits."""
    part = lambda b: F.shiftrightunsigned(F.shiftleft(F.col(fp), 64 - b[0] - b[1]), 64 - b[1])
    out = []
    for k, choice in enumerate(combinations(blocks, len(blocks) - RADIUS)):
        key = F.lit(k).cast("long")
        for b in choice:
            key = F.shiftleft(key, b[1]).bitwiseOR(part(b))
        out.append(key)
    return F.array(*out)


def link_edges(prints: DataFrame) -> DataFrame:
    """prints: distinct fp. Edges (src, dst) whose components are those of all links."""
    rows = prints.select("fp", F.explode(_keys(blocks_for(prints.count()))).alias("key"))
    heavy = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select(F.col("key").alias("key_"), F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    rows = rows.join(heavy, F.col("key") == F.col("key_"), "left").drop("key_")
    side = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, side) * F.col("parts") + F.greatest(j, side))
    rows = rows.select("key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(tiles)).alias("tile"), F.coalesce(side, F.lit(0)).alias("side"), "fp")
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "fp").mapInArrow(_compare, "src long, dst long")


def _components(docs: DataFrame, *longs: str) -> DataFrame:
    """doc_id, fp, the columns longs, component (a fingerprint), component_id."""
    prints, _ = materialize(fingerprints(docs, *longs), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = connected_components(link_edges(nodes.select("fp")))
    labelled = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(smallest, "component").select(F.col("fp").alias("fp_"), "component_id", "component")
    return prints.join(by_fp, F.col("fp") == F.col("fp_")).drop("fp_")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of all that are linked, directly or not)."""
    return _components(docs).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component stays, the first by doc_id (nulls last), hash of the text, and key in a written table. All columns
    pass through, whatever their names."""
    rows, own = sheltered(docs)
    doc, text = F.col(own["doc_id"]), F.col(own["text"])
    rows, _ = materialize(rows.withColumns({"row": F.monotonically_increasing_id(), "text_hash": F.xxhash64(text)}), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash", "row")).alias("first")
    judged = _components(rows.select(doc.alias("doc_id"), text.alias("text"), "text_hash", "row"), "text_hash", "row")
    kept = judged.groupBy("component").agg(first).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*[F.col(u).alias(c) for u, c in zip(rows.columns, docs.columns)])


def brute_force(docs: list[tuple]) -> dict:
    """doc_id -> (hex fingerprint, component_id), by definition: for tests."""
    import re

    fps = []
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sh = [" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append((doc, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    comp = {d: d for d, _ in fps}
    changed = True
    while changed:
        changed = False
        for a, x in fps:
            for b, y in fps:
                if (x ^ y).bit_count() <= RADIUS and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    return {d: (f"{x:016x}", comp[d]) for d, x in fps}


# ---- SQL: XXH64 in 128-bit integers. A rotation by r is a product with 2^r modulo 2^64 - 1 ---------------------------

_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_SEED, _M = 42, 1 << 64


def _big(n: int) -> str:
    return f"CAST('{n % _M}' AS UHUGEINT)"


def _times_sql(a: str, n: int) -> str:
    return f"(({a}) * {_big(n)} % CAST('{_M}' AS UHUGEINT))"


def _turned(a: str, r: int) -> str:
    return f"(({a}) * {_big(1 << r)} % {_big(_M - 1)})"


def _sum(*xs: str) -> str:
    return f"(({' + '.join(xs)}) % CAST('{_M}' AS UHUGEINT))"


def _round(v: str, lane: str) -> str:
    return _times_sql(_turned(_sum(v, _times_sql(lane, _P2)), 31), _P1)


def _le(at: str, n: int) -> str:
    """n bytes of b from place `at` on, little-endian."""
    return " + ".join(f"b[{at} + {i + 1}] * {_big(1 << 8 * i)}" for i in range(n))


def _sql() -> str:
    start = [_SEED + _P1 + _P2, _SEED + _P2, _SEED, _SEED - _P1]
    v = ", ".join(f"list_reduce(list_transform(range(0, n // 32), lambda k: lanes[4 * k + {i + 1}]), lambda v, x: {_round('v', 'x')}, {_big(s)}) AS v{i}" for i, s in enumerate(start))
    joined = _sum(*[_turned(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18))])
    merged = f"list_reduce([v0, v1, v2, v3], lambda h, v: {_sum(_times_sql(f'xor(h, {_round(_big(0), chr(118))})', _P1), _big(_P4))}, {joined})"
    lanes = f"list_reduce(lanes[4 * (n // 32) + 1:], lambda h, x: {_sum(_times_sql(_turned(f'xor(h, {_round(_big(0), chr(120))})', 27), _P1), _big(_P4))}, h)"
    four = f"CASE WHEN n % 8 >= 4 THEN {_sum(_times_sql(_turned(f'xor(h, {_times_sql(_le(chr(110) + ' // 8 * 8', 4), _P1)})', 23), _P2), _big(_P3))} ELSE h END"
    last = f"list_reduce(b[n // 4 * 4 + 1:], lambda h, x: {_times_sql(_turned(f'xor(h, {_times_sql(chr(120), _P5)})', 11), _P1)}, h)"
    shifted = lambda r: f"xor(h, h // {_big(1 << r)})"
    bits = " + ".join(f"CASE WHEN 2 * sum(h >> {j} & 1) > count(h) THEN CAST('{1 << j}' AS UHUGEINT) ELSE 0 END" for j in range(64))
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[j:j + {SHINGLE - 1}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS j FROM d WHERE len(w) > 0)),
x0 AS (SELECT t, strlen(t) AS n, list_transform(regexp_extract_all(hex(t), '..'), lambda x: CAST(CAST('0x' || x AS INT) AS UHUGEINT)) AS b FROM (SELECT DISTINCT t FROM s)),
x1 AS (SELECT t, n, b, list_transform(range(0, n // 8), lambda k: {_le('8 * k', 8)}) AS lanes FROM x0),
x2 AS (SELECT *, {v} FROM x1),
x3 AS (SELECT t, n, b, lanes, {_sum(f"CASE WHEN n >= 32 THEN {merged} ELSE {_big(_SEED + _P5)} END", "CAST(n AS UHUGEINT)")} AS h FROM x2),
x4 AS (SELECT t, n, b, {lanes} AS h FROM x3), x5 AS (SELECT t, n, b, {four} AS h FROM x4), x6 AS (SELECT t, {last} AS h FROM x5),
x7 AS (SELECT t, {_times_sql(shifted(33), _P2)} AS h FROM x6), x8 AS (SELECT t, {_times_sql(shifted(29), _P3)} AS h FROM x7), x AS (SELECT t, CAST({shifted(32)} AS UBIGINT) AS h FROM x8),
f AS (SELECT doc_id, CAST({bits} AS UBIGINT) AS fp FROM d LEFT JOIN s USING (doc_id) LEFT JOIN x USING (t) GROUP BY doc_id),
n AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp), l AS (SELECT a.fp AS a, b.fp AS b FROM n a JOIN n b ON bit_count(xor(a.fp, b.fp)) <= {RADIUS}),
r AS (SELECT fp AS a, fp AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT r.a AS fp, min(n.least) AS component_id FROM r JOIN n ON r.b = n.fp GROUP BY r.a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN c USING (fp)
"""


#: For doc_ids that don't repeat.
SQL = _sql()
