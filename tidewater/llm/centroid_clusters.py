"""k-means over integer vectors with adaptive lower bounds.

Each vector keeps its cluster, lower bounds on the distances to its NEAR next nearest centroids, and one bound for all the rest. When
centroids have moved, bounds shrink by the movements: those of the near ones by their own, the rest's by the largest. The distance to
the vector's own centroid is computed anew, exactly. If it is below every bound, the order is certified and the vector stays. If it
is below the rest's bound only, the near centroids whose bounds it reaches are computed exactly. Else all centroids are.

Distances are integers and exact; bounds are rounded to the safe side, and a vector stays only if its distance is strictly below a
bound, so ties always are computed (the smaller number wins) and results are those of a full search.

Each round is one map over a written table, which holds vectors and bounds; each task adds one row of sums for each cluster after its own
rows, so vectors are never shuffled and new centroids come from a few rows. The centroids are all that the driver holds.

Defined cases: vectors that are null, have not DIM components or hold null or non-finite ones are left out; repeated rows are vectors of
their own; null ids are hashed as nulls and come last among the first centroids' candidates, equal hashes go by the vector; fewer than K
vectors give as many centroids; an empty table gives no rows; other columns are not returned. A distance or sum beyond a long is an error.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import delete, materialize, small_batches

DIM, K, ROUNDS, SCALE, SEED, NEAR = 64, 16, 3, 64, 1, 4
CHUNK = 4096
FLOAT_EXACT = 1 << 22  # integers up to this size have squared distances of 64 components below 2 to the 53rd

STATE = "vec_id {id}, v array<bigint>, cluster int, distance bigint, near array<int>, lower array<double>, rest double, of int, n bigint, total array<bigint>, inertia bigint"


def finite(v: Column) -> Column:
    return F.forall(v.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def scaled(v: list[float] | np.ndarray, scale: int) -> list[int]:
    """floor(scale * x), exactly: scale is a power of two."""
    return [int(np.floor(x * scale)) for x in np.asarray(v, np.float64)]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each of c; exact."""
    size = max((int(np.abs(a).max()) for a in (x, c) if a.size), default=0)
    kind = np.float64 if size <= FLOAT_EXACT and x.shape[1] <= DIM else object
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)


def own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of c; exact."""
    size = max((int(np.abs(a).max()) for a in (x, c) if a.size), default=0)
    kind = np.int64 if size <= FLOAT_EXACT and x.shape[1] <= DIM else object
    d = x.astype(kind) - c.astype(kind)
    return (d * d).sum(axis=1)


def below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - 2.0**-50)


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + 2.0**-50)


class Bounds:
    """cluster, squared distance, near centroids with their lower bounds, and the rest's bound, of some vectors."""

    def __init__(self, cluster, distance, near, lower, rest):
        self.cluster, self.distance, self.near, self.lower, self.rest = cluster, distance, near, lower, rest


def full_search(x: np.ndarray, centroids: np.ndarray, near: int = NEAR) -> Bounds:
    d = distances(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")  # ties by number
    d = np.take_along_axis(d, order, axis=1)
    rest = below(d[:, near + 1]) if d.shape[1] > near + 1 else np.full(len(x), np.inf)
    return Bounds(order[:, 0], d[:, 0], order[:, 1 : near + 1], below(d[:, 1 : near + 1]), rest)


def adapt(x: np.ndarray, b: Bounds, centroids: np.ndarray, moved: np.ndarray) -> tuple[Bounds, np.ndarray]:
    """Bounds under moved centroids, and how each row was judged: 0 certified, 1 by some near centroids, 2 by all. moved: how far at most."""
    lower = np.nextafter(b.lower - moved[b.near], -np.inf)
    rest = np.nextafter(b.rest - (moved.max() if len(moved) else 0.0), -np.inf)
    cluster, near = b.cluster.copy(), b.near.copy()
    distance = own_distances(x, centroids[cluster])
    upper = above(distance)
    how = np.where(upper < rest, np.where((upper[:, None] < lower).all(axis=1), 0, 1), 2)
    some = np.flatnonzero(how == 1)
    if len(some):
        i, z = np.nonzero(lower[some] <= upper[some, None])
        i = some[i]
        exact = own_distances(x[i], centroids[near[i, z]])
        lower[i, z] = below(exact)
        # the nearest of each row's computed ones: least distance, then smaller number
        order = np.lexsort((near[i, z], exact, i))
        first = order[np.concatenate(([True], np.diff(i[order]) > 0))]
        r, c, d = i[first], near[i[first], z[first]], exact[first]
        wins = (d < distance[r]) | ((d == distance[r]) & (c < cluster[r]))
        r, at, c, d = r[wins], z[first][wins], c[wins], d[wins]
        near[r, at], lower[r, at] = cluster[r], below(distance[r])
        cluster[r], distance[r] = c, d
        order = np.argsort(lower[some], axis=1, kind="stable")
        near[some], lower[some] = np.take_along_axis(near[some], order, axis=1), np.take_along_axis(lower[some], order, axis=1)
    every = np.flatnonzero(how == 2)
    if len(every):
        new = full_search(x[every], centroids, near.shape[1])
        distance = distance.astype(object) if new.distance.dtype == object else distance
        cluster[every], distance[every], near[every], lower[every], rest[every] = new.cluster, new.distance, new.near, new.lower, new.rest
    return Bounds(cluster, distance, near, lower, rest), how


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array([int(x) for x in a], pa.int64()) if a.dtype == object else pa.array(a.astype(np.int64))


def _lists(a: np.ndarray, kind) -> pa.Array:
    offsets = pa.array((np.arange(len(a) + 1) * a.shape[1]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a).reshape(-1), kind))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _rounds(centroids: np.ndarray, moved: np.ndarray | None, dim: int, scale: int, last: bool):
    """One assignment of all vectors; without `moved` the first, by a full search of raw vectors."""
    k, near = len(centroids), min(NEAR, len(centroids) - 1)

    def row(schema, size, **columns):
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches):
        total, count, inertia, schema = np.zeros((k, dim), object), [0] * k, [0] * k, None
        for whole in batches:
            if schema is None:
                id_ = whole.schema.field("vec_id").type
                schema = pa.schema([("vec_id", id_), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("near", pa.list_(pa.int32())),
                    ("lower", pa.list_(pa.float64())), ("rest", pa.float64()), ("of", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64())), ("inertia", pa.int64())])
            for lo in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(lo, CHUNK)
                if moved is None:
                    x = np.floor(_matrix(batch.column("embedding"), dim, np.float64) * scale)
                    if np.abs(x).max() >= 2.0**63:
                        raise ValueError("a component is beyond a long")
                    x = x.astype(np.int64)
                    b = full_search(x, centroids, near)
                else:
                    x = _matrix(batch.column("v"), dim, np.int64)
                    of = lambda name, kind: batch.column(name).to_numpy(zero_copy_only=False).astype(kind)
                    b = Bounds(of("cluster", np.int64), None, _matrix(batch.column("near"), near, np.int64) if near else np.zeros((len(x), 0), np.int64),
                        _matrix(batch.column("lower"), near, np.float64) if near else np.zeros((len(x), 0)), of("rest", np.float64))
                    b, _ = adapt(x, b, centroids, moved)
                for c in np.unique(b.cluster).tolist():
                    own = b.cluster == c
                    count[c] += int(own.sum())
                    inertia[c] += int(b.distance[own].astype(object).sum())
                    if not last:
                        part = x[own]
                        total[c] += part.sum(axis=0, dtype=np.int64 if np.abs(part).max() < 1 << 40 else object)
                columns = {"vec_id": batch.column("vec_id"), "cluster": pa.array(b.cluster, pa.int32()), "distance": _longs(b.distance)}
                if not last:
                    columns |= {"v": _lists(x, pa.int64()), "near": _lists(b.near, pa.int32()), "lower": _lists(b.lower, pa.float64()), "rest": pa.array(b.rest)}
                yield row(schema, len(x), **columns)
        of = [c for c in range(k) if count[c]]
        if of:
            columns = {"of": pa.array(of, pa.int32()), "n": pa.array([count[c] for c in of], pa.int64()), "inertia": pa.array([inertia[c] for c in of], pa.int64())}
            if not last:
                columns["total"] = pa.array([[int(s) for s in total[c]] for c in of], pa.list_(pa.int64()))
            yield row(schema, len(of), **columns)

    return run


def first_centroids(able: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    chosen = able.select("embedding", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    rows = chosen.orderBy(F.asc_nulls_last("h"), "embedding").limit(k).collect()  # k vectors
    return np.array([scaled(r.embedding, scale) for r in rows], dtype=object)


def _integers(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.int64) if rows.size else np.zeros((0, DIM), np.int64)


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector kept; and the final centroids."""
    spark = vectors.sparkSession
    small_batches(spark)
    able = vectors.select("vec_id", "embedding").filter((F.size("embedding") == dim) & finite(F.col("embedding")))
    centroids = _integers(first_centroids(able, k, scale, seed))
    spec = STATE.format(id=dict(vectors.dtypes)["vec_id"])
    now, path, moved = able, None, None
    for i in range(rounds + 1):
        last = i == rounds
        if i:
            now = now.filter("of IS NULL").select("vec_id", "v", "cluster", "near", "lower", "rest")
        now, written = materialize(now.mapInArrow(_rounds(centroids, moved, dim, scale, last), spec), "clusters")
        if path:
            delete(spark, path)
        path = written
        if not last:
            sums = now.filter("of IS NOT NULL").select("of", "n", F.posexplode("total").alias("at", "s")).groupBy("of", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            new = centroids.copy()
            for r in sums.collect():  # k x dim numbers
                new[r["of"], r["at"]] = r["s"] // r["n"]
            moved = above(own_distances(new, centroids))
            centroids = new
    totals = dict(now.filter("of IS NOT NULL").groupBy("of").agg(F.sum("inertia")).collect())  # k numbers
    final = [[int(x) for x in c] for c in centroids]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    pick = lambda values, kind: F.coalesce(*[F.when(F.col("cluster") == c, F.lit(v).cast(kind)) for c, v in values.items()]) if values else F.lit(None).cast(kind)
    return now.filter("of IS NULL").select("vec_id", "cluster", "distance", pick(totals, "long").alias("cluster_inertia"),
        F.lit(sum(totals.values())).cast("long").alias("inertia"), pick(dict(enumerate(digests)), "string").alias("centroid_sha256")), final


def brute_force(rows: list[tuple], k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> list[tuple]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of unique ids by definition, in Python's integers: for tests."""
    able = {i: scaled(v, SCALE) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(np.array(v, float)).all()}
    c = [able[i] for i in sorted(able, key=lambda i: hashlib.sha256(f"{SEED}:{i}".encode()).hexdigest())[:k]]
    for i in range(rounds + 1):
        best = {x: min((sum((p - q) ** 2 for p, q in zip(v, cc)), n) for n, cc in enumerate(c)) for x, v in able.items()}
        if i < rounds:
            for n in range(len(c)):
                if own := [able[x] for x, (_, m) in best.items() if m == n]:
                    c[n] = [sum(col) // len(own) for col in zip(*own)]
    sums = {n: sum(d for d, m in best.values() if m == n) for n in range(len(c))}
    return [(x, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for x, (d, n) in best.items()]


def _sql() -> str:
    """Unrolled rounds of a full search."""
    distance = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = {DIM}),
v AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM e WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM v) ORDER BY h LIMIT {K})"""]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS (SELECT vec_id, any_value(v) AS v, min({{'d': {distance.format(a='v', b='m')}, 'c': c}}) AS b FROM v, c{i} GROUP BY vec_id)")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j),
u{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(u{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN u{i} USING (c))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.c = b.c"""


SQL = _sql()
