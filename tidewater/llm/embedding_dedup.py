"""Near-duplicate vectors by a forest of random-projection trees.

Vectors of one label (and one dimension) are compared. Equal vectors are one node that counts its copies. Each of TREES trees
splits a node at the median of a random projection; vectors within SPILL of it go to both sides. Splitting goes on, level by
level and for all nodes of all trees in one job, until a node has LEAF members or fewer, or the split would leave over four
fifths of it on one side (a cluster tighter than the spill). Medians are Spark aggregates over all rows, not over a sample, and
every vector is in a leaf of every tree.

Within leaves, cosines are computed in double precision. Leaves over TILE members are compared in tiles, block by block, so
no task holds one whole. A pair that meets in several leaves counts in the first of them only. A tile gives, for each vector, its
number of links, and a spanning forest of them; components are united over the forests.

Defined cases: null labels; null, empty or zero vectors; null or non-finite components: such rows link with nothing, have n_links 0
and are components of their own. Nodes have ids of their own, so rows that share a vec_id are judged by their own vectors: equal
vectors of one label link with each other, whatever their ids. Empty input gives no rows; other columns are not returned.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .shared import delete, materialize, small_batches
from .simhash import forest

COSINE = 0.93
TREES, LEAF, SPILL, TILE = 6, 512, 0.02, 1024
SEED = 20_240_229


def directions(tree: int, levels: int, dim: int) -> np.ndarray:
    d = np.random.default_rng([SEED, tree, dim]).standard_normal((levels, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _arrays(column: pa.Array) -> list:
    return [None if x is None or x.null_count else x for x in (v.values if v.is_valid else None for v in column)]


def _check(batches):
    """Rows whose vectors can link, with the vector's bytes hashed to find equal ones."""
    import hashlib

    for b in batches:
        keys, dims = [], []
        for label, v in zip(b.column("label"), b.column("embedding")):
            a = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if label.is_valid and v.is_valid and v.values is not None and not v.values.null_count else None
            ok = a is not None and len(a) and np.isfinite(a).all() and a.any()
            keys.append(hashlib.md5((a + 0.0).tobytes()).hexdigest() if ok else None)
            dims.append(len(a) if ok else None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), b.column("label"), b.column("embedding"), pa.array(keys, pa.string()),
            pa.array(dims, pa.int32())], names=["vec_id", "label", "embedding", "key", "dim"])


def _project(levels):
    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            n, out = b.num_rows, np.zeros((b.num_rows, TREES, levels), np.float32)
            vectors = b.column("embedding")
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                v = np.array([vectors[i].values.to_numpy(zero_copy_only=False) for i in rows.tolist()], np.float64).reshape(len(rows), dim)
                v /= np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(v).max(axis=1, keepdims=True)
                for t in range(TREES):
                    out[rows, t] = v @ directions(t, levels, dim).T
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * TREES + 1) * levels, pa.int32()), pa.array(out.reshape(-1)))
            rep = lambda c: b.column(c).take(pa.array(np.repeat(np.arange(n), TREES)))
            yield pa.RecordBatch.from_arrays([rep("node"), rep("label"), rep("dim"), pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)),
                pa.array(np.ones(n * TREES, np.int64)), flat], names=["node", "label", "dim", "tree", "leaf", "proj"])
    return run


def grow(nodes: DataFrame, label_type: str, leaf: int = LEAF) -> DataFrame:
    """node, label, dim, tree, leaf: a row for each leaf that a vector is in. Written tables hold each level."""
    spark = nodes.sparkSession
    most = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(1, int(np.ceil(np.log2(max(2, most / leaf)))) * 2 + 4)
    spec = f"node long, label {label_type}, dim int, tree int, leaf long, proj array<float>"
    state, path = materialize(nodes.select("node", "label", "dim", "embedding").mapInArrow(_project(levels), spec), "trees")
    at, done = ["tree", "label", "dim", "leaf"], []
    for _ in range(levels):
        p = F.col("proj")[0]
        q = F.percentile_approx(p, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)), 1000).alias("q")
        splits = state.groupBy(*at).agg(F.count("*").alias("n"), q).filter(F.col("n") > leaf)
        splits = splits.filter((F.col("q")[0] < F.col("q")[1] - SPILL) & (F.col("q")[2] > F.col("q")[1] + SPILL))
        splits, at_path = materialize(splits.select(*[F.col(c).alias(f"{c}_") for c in at], F.col("q")[1].alias("cut")), "splits")
        if not splits.limit(1).count():
            break
        on = [F.col(c) == F.col(f"{c}_") for c in at]
        left = F.when(p <= F.col("cut") + SPILL, F.col("leaf") * 2)
        right = F.when(p >= F.col("cut") - SPILL, F.col("leaf") * 2 + 1)
        child, rest = F.explode(F.array_compact(F.array(left, right))).alias("leaf"), F.expr("slice(proj, 2, greatest(size(proj) - 1, 0))").alias("proj")
        done.append(materialize(state.join(splits, on, "left_anti").drop("proj"), "leaves")[0])  # finished leaves are written once
        new, new_path = materialize(state.join(splits, on).select("node", "label", "dim", "tree", child, rest), "trees")
        delete(spark, path)
        delete(spark, at_path)
        state, path = new, new_path
    return reduce(DataFrame.unionByName, done, state.drop("proj"))


def _groups(batches):
    """Sorted batches, cut where a leaf's tile ends."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        g, tile = t.column("group").to_numpy(), t.column("tile").to_numpy()
        cut = np.flatnonzero((g[1:] != g[:-1]) | (tile[1:] != tile[:-1])) + 1
        for lo, hi in zip([0, *cut[:-1].tolist()], cut.tolist()):
            yield t.slice(lo, hi - lo)
        rest = t.slice(int(cut[-1])) if len(cut) else t
    if rest is not None and rest.num_rows:
        yield rest


def _met_before(own: np.ndarray, i, j, here: np.ndarray) -> np.ndarray:
    """Whether the two vectors of a pair share a leaf that comes before this one. own: sorted leaves by vector, padded with -1."""
    out = np.zeros(len(i), bool)
    for a in range(own.shape[1]):
        x = own[i, a]
        live = (x >= 0) & (x < here) & ~out
        if live.any():
            k = np.flatnonzero(live)
            out[k] = (own[j[k]] == x[k, None]).any(axis=1)
    return out


def _links(batches):
    """what 0: vector a has b links more; what 1: a and b are linked."""
    for t in _groups(batches):
        n = t.num_rows
        if n < 2:
            continue
        lists = t.column("embedding").combine_chunks()
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        scale = np.abs(v).max(axis=1, keepdims=True)
        v = v / scale
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        side, here = t.column("side").to_numpy(), int(t.column("group")[0].as_py())
        within = int(t.column("tile")[0].as_py()) < 0 or len(np.unique(side)) == 1
        leaves = t.column("leaves").combine_chunks()
        size = leaves.value_lengths().to_numpy()
        own = np.full((n, size.max()), -1, np.int64)
        own[np.arange(size.max())[None, :] < size[:, None]] = leaves.flatten().to_numpy()
        links, chunks = np.zeros(n, np.int64), []
        for lo in range(0, n, 256):
            i, j = np.nonzero(v[lo : lo + 256] @ v.T >= COSINE)
            i += lo
            ok = (i < j) & (within | (side[i] != side[j]))
            i, j = i[ok], j[ok]
            chunks.append((i, j))
            for k in range(0, len(i), 100_000):
                x, y = i[k : k + 100_000], j[k : k + 100_000]
                new = ~_met_before(own, x, y, here)
                np.add.at(links, x[new], copies[y[new]])
                np.add.at(links, y[new], copies[x[new]])
        root = forest(n, chunks)
        got, has = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array([0, 1], np.int32), [len(got), len(has)])), pa.array(np.concatenate((node[got], node[has]))),
                pa.array(np.concatenate((links[got], node[root[has]]))),
        ], names=["what", "a", "b"])


def near_duplicates(vectors: DataFrame, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    kinds = dict(vectors.dtypes)
    spec = f"vec_id long, label {kinds['label']}, embedding {kinds['embedding']}, key string, dim int"
    rows, _ = materialize(vectors.select("vec_id", "label", "embedding").mapInArrow(_check, spec), "vectors")
    able = rows.filter("key IS NOT NULL AND vec_id IS NOT NULL")
    # equal vectors: counted before the shuffle; any of them stands for all, as they are equal
    nodes = able.groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"),
        F.min_by("embedding", "vec_id").alias("embedding"), F.min("dim").alias("dim"))
    nodes, _ = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    trees, _ = materialize(grow(nodes, kinds["label"], leaf).select("node", F.xxhash64("tree", "label", "dim", "leaf").bitwiseAND(F.lit((1 << 63) - 1)).alias("group")), "leaves")
    own = trees.groupBy(F.col("node").alias("own_")).agg(F.sort_array(F.collect_set("group")).alias("leaves"))
    parts = trees.groupBy(F.col("group").alias("group_")).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    full = nodes.join(own, F.col("node") == F.col("own_")).select("node", "copies", "embedding", "leaves")
    placed = full.select("*", F.explode("leaves").alias("group")).join(parts, F.col("group") == F.col("group_"))
    side = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, side) * F.col("parts") + F.greatest(k, side))
    placed = placed.select("group", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(-1))).otherwise(tiles)).alias("tile"), side.alias("side"),
        "node", "copies", "embedding", "leaves")
    found, _ = materialize(placed.repartition("group", "tile").sortWithinPartitions("group", "tile", "node").mapInArrow(_links, "what int, a long, b long"), "links")
    links = found.filter("what = 0").groupBy(F.col("a").alias("linked_")).agg(F.sum("b").alias("links"))
    comp = connected_components(found.filter("what = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    comp = comp.withColumnRenamed("node", "member")
    smallest = comp.join(nodes.select("node", "least"), F.col("member") == F.col("node")).groupBy(F.col("component").alias("component_")).agg(F.min("least").alias("c"))
    comp = comp.join(smallest, F.col("component") == F.col("component_")).select("member", "c")
    judged = nodes.join(links, F.col("node") == F.col("linked_"), "left").join(comp, F.col("node") == F.col("member"), "left")
    judged = judged.select(F.col("label").alias("label_"), F.col("key").alias("key_"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("c", "least").alias("c"))
    out = rows.drop("embedding").join(judged, (F.col("label") == F.col("label_")) & (F.col("key") == F.col("key_")) & F.col("vec_id").isNotNull(), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")).withColumn("kept",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def brute_force(rows: list[tuple]) -> dict:
    """vec_id -> (n_links, component_id), by definition: for tests."""
    able = {i: np.array(v, float) for i, label, v in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, x, _ in rows}
    links = {i: set() for i, _, _ in rows}
    ids = sorted(able)
    for x in ids:
        for y in ids:
            if x < y and label[x] == label[y] and len(able[x]) == len(able[y]) and able[x] @ able[y] / np.linalg.norm(able[x]) / np.linalg.norm(able[y]) >= COSINE:
                links[x].add(y)
                links[y].add(x)
    comp = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for x, ys in links.items():
            if (m := min([comp[x], *(comp[y] for y in ys)])) < comp[x]:
                comp[x], changed = m, True
    return {i: (len(links[i]), comp[i]) for i in links}


#: Compares all pairs of a label: for small tables.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
