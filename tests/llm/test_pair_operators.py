"""Near-duplicates, decontamination, substring removal, components."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import components, decontaminate, embedding_dedup, simhash, substring_dedup

DOCS = "doc_id long, text string, n_words long, fp long, component_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], DOCS)


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages, short, empty, null and long texts."""
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(0, 120))) for i in range(60)]
    base = words(rng, 400)
    for i in range(60, 120):  # near copies of one text
        w = base.split()
        w[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[3][1]) for i in range(120, 150)]
    passage = words(rng, 45)
    rows += [(i, words(rng, 13) + "\n" + passage + " " + words(rng, rng.randint(0, 30))) for i in range(150, 175)]
    rows += [(200, None), (201, ""), (202, "  \t\n"), (203, "One TWO"), (204, "one two"), (205, "a " * 50), (206, "é à " * 3000), (207, passage.upper())]
    return rows


def test_simhash_equals_brute_force(spark, corpus, monkeypatch):
    want = simhash.brute_force(corpus)
    for tile, blocks in ((2048, 6), (4, 6), (2048, 7), (16, 8)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "MOST_BLOCKS", blocks)
        monkeypatch.setattr(simhash, "BUCKET", 64 if blocks == 6 else 0)
        assert len(simhash.blocks_for(len(corpus))) == blocks
        got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs(spark, corpus)).collect()}
        assert got == want
    monkeypatch.undo()
    assert [(b, w) for b, w in simhash.blocks_for(10**6)] == [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
    assert len(simhash.blocks_for(10**10)) == 8 and all(sum(w for _, w in simhash.blocks_for(n)) == 64 for n in (1, 10**9, 10**11))
    kept = simhash.keep_first(docs(spark, corpus))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}
    assert simhash.near_duplicates(docs(spark, corpus).limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Also of repeated rows and of rows without a doc_id, beside copies with ids or not."""
    rng = random.Random(12)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (None, b), (5, c), (None, c), (6, c), (7, d), (7, d)]
    for order in (rows, rows[::-1]):
        kept = [(r.doc_id, r.text) for r in simhash.keep_first(docs(spark, order)).collect()]
        assert sorted(kept, key=lambda r: r[0] or 0) == [(None, b), (1, a), (5, c), (7, d)]


def test_bit_sliced_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = np.concatenate([base[rng.integers(0, 12, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(2)])
    group = np.sort(rng.integers(0, 4, len(fp)))
    got = {(int(a), int(b)) for i, j in simhash.linked_pairs(fp, group, None) for a, b in zip(i, j)}
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= 4}
    assert got == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    want.pop(5)
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_decontamination_equals_brute_force(spark, corpus):
    rng = random.Random(8)
    text = dict(corpus)
    items = [(1, text[3]), (2, " ".join(text[60].split()[50:80])), (10, "one two"), (11, "W1"), (12, None), (13, ""), (14, words(rng, 40)), (15, " ".join(text[70].split()[50:80]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.brute_force(corpus, [(i, t) for i, t in items if t is not None]))
    for block in (decontaminate.BLOCK_WORDS, 20):
        got = decontaminate.digest(decontaminate.contamination(docs(spark, corpus), b, block_words=block))
        assert sorted(map(tuple, got.collect())) == want
    left = decontaminate.clean_documents(docs(spark, corpus), b)
    assert sorted(r.doc_id for r in left.collect()) == [r[0] for r in want if not r[5]]
    assert decontaminate.clean_documents(docs(spark, corpus), b.limit(0)).count() == len(corpus)


def test_decontamination_judges_each_row(spark):
    """Repeated rows, and unequal texts of one or no doc_id with equally many words, on either side of the block size."""
    rng = random.Random(3)
    item, other, clean = words(rng, 20), words(rng, 20), words(rng, 20)
    rows = [(1, item), (1, item), (1, other), (1, clean), (1, clean), (None, item), (None, clean), (None, words(rng, 20)), (2, clean), (3, None), (None, None)]
    b = spark.createDataFrame([(7, item), (8, other), (9, "")], "item_id long, text string")
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(decontaminate.brute_force(rows, [(7, item), (8, other), (9, "")]), key=key)
    left = sorted([r for r, w in zip(rows, decontaminate.brute_force(rows, [(7, item), (8, other)])) if not w[5]], key=key)
    for block in (decontaminate.BLOCK_WORDS, 10):
        got = decontaminate.digest(decontaminate.contamination(docs(spark, rows), b, block_words=block))
        assert sorted(map(tuple, got.collect()), key=key) == want
        kept = decontaminate.clean_documents(docs(spark, rows), b, block_words=block)
        assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=key) == left


def test_substring_removal_equals_brute_force(spark, corpus, monkeypatch):
    want = sorted(substring_dedup.brute_force(corpus))
    for size in (substring_dedup.CHUNK_BYTES, 3000):
        monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", size)
        got = substring_dedup.digest(substring_dedup.remove_repeats(docs(spark, corpus).repartition(5)))
        assert sorted(map(tuple, got.collect())) == want
    assert any(r[2] for r in want)
    assert substring_dedup.remove_repeats(docs(spark, corpus).limit(0)).count() == 0
    twice = substring_dedup.remove_repeats(docs(spark, [(1, "a b " * 30), (1, "a b " * 30), (None, "q " * 40)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in twice) == [(False, 58), (False, 60), (True, 39)]
    rng = random.Random(21)  # equal doc_ids, null ones and the smallest long, whatever chunks they lie in
    passages = [words(rng, 25) for _ in range(4)]
    rows = [(rng.choice([1, 1, 2, -(1 << 63), None]), " ".join(rng.choice([*passages, words(rng, 5)]) for _ in range(rng.randint(1, 4)))) for _ in range(60)]
    rows += [(1, "a a a a a " + passages[0]), (1, passages[0] + " zzz")]
    want = sorted(substring_dedup.brute_force(rows), key=str)
    for size, parts in ((2 << 20, 1), (2 << 20, 7), (60, 3)):
        monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", size)
        got = substring_dedup.digest(substring_dedup.remove_repeats(docs(spark, rows).repartition(parts)))
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_written_chunks_and_answers_are_read_in_small_parts(spark, tmp_path):
    """A row group holds some MB, however many rows a task writes, and answers are no lists of numbers."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(4)
    text = spark.range(60, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit(words(rng, 150_000)).alias("text"))
    _, path = substring_dedup.pack(text)
    groups = [f.metadata.row_group(i) for f in map(pq.ParquetFile, glob.glob(path.removeprefix("file://") + "/*.parquet")) for i in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 30 and max(g.total_byte_size for g in groups) < 32 << 20
    said = substring_dedup._meet(pa.table({"chunk": [1, 2], "bucket": [0, 0], "hashes": pa.array([[5, 7], [5]], pa.list_(pa.int32())), "kinds": pa.array([[2, 0], [0]], pa.list_(pa.int8()))}))
    assert said["said"].to_pylist() == [b"\x01\x00", b"\x01"]


def test_forest_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows, centre = [], rng.standard_normal((6, 32))
    for i in range(400):
        rows.append((i, int(i % 3 == 0), (centre[i % 6] + rng.standard_normal(32) * 0.2).astype(np.float32).tolist()))
    rows += [(500 + i, 1, rows[9][2]) for i in range(40)] + [(600, None, rows[0][2]), (601, 1, None), (602, 1, [0.0] * 32), (603, 1, [float("nan")] * 32), (604, 1, []), (605, 1, rows[0][2][:8])]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    want = embedding_dedup.brute_force([(i, x, v) for i, x, v in rows])
    for leaf, tile in ((512, 1024), (40, 16)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(d, leaf, tile).collect()}
        total = sum(n for n, _ in want.values())
        assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)  # never a false link
        assert sum(n for n, _ in got.values()) >= (1.0 if leaf == 512 else 0.9) * total
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_forest_finds_links_where_trees_split(spark):
    """8,000 vectors of one label in leaves of 16, pairs at cosine 0.93 to 0.96: recall against all pairs."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    off = rng.standard_normal((4000, 64))
    off -= (off * v).sum(axis=1, keepdims=True) * v
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(0.932, 0.96, (4000, 1))
    every = np.concatenate((v, c * v + np.sqrt(1 - c * c) * off))
    true = int((every @ every.T >= 0.93).sum()) - 8000
    d = spark.createDataFrame([(i, 1, x) for i, x in enumerate(every.tolist())], "vec_id long, label int, embedding array<double>")
    found = embedding_dedup.near_duplicates(d, leaf=16).agg({"n_links": "sum"}).first()[0]
    assert true >= 8000 and 0.98 * true <= found <= true


def test_vectors_that_share_an_id(spark):
    """Each row is judged by its own vector; extra columns clash with names of the result and of the operator."""
    rows = [(1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [1.0, 0.001]), (3, 1, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (4, 2, [1.0, 0.0]), (9, 1, [0.0, 1.0]), (9, 1, [0.0, 1.0])]
    d = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "vec_id long, label int, embedding array<float>, node long, key int, kept int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (0, 0, None, True), (4, 0, 4, True), (9, 2, 1, False), (9, 2, 1, False)], key=str)


@pytest.mark.parametrize("broken", [np.zeros, np.ones])
def test_windows_of_equal_hashes_are_told_apart(spark, monkeypatch, broken):
    """Words decide, not their hashes: with all window hashes alike, results stay."""
    rng = random.Random(21)
    texts = [(i, words(rng, 30)) for i in range(6)]
    items = [(1, texts[2][1]), (2, "w1 w2 w3"), (3, words(rng, 20))]
    monkeypatch.setattr(decontaminate, "ngram_hashes", lambda h, k: broken(max(0, len(h) - k + 1), np.uint64))
    index = decontaminate.index_items([(str(i), t) for i, t in items])
    import pyarrow as pa
    from tidewater.llm.shared import is_word_byte, lower_ascii, split_words

    found = decontaminate.hits(split_words(pa.array([t for _, t in texts], pa.large_string()), is_word_byte(), lower_ascii()), index, {"prints": decontaminate.Lookup(index["prints"])} | {k: decontaminate.Lookup(v[0]) for k, v in index["windows"].items()})
    assert {(r, tuple(names)) for r, _, _, names in found} == {(2, ("1",))} and len(found) == 18
