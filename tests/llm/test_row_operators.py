"""Mixing, sharding, the pipeline."""
import hashlib
import math
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tidewater.llm import mixing, sharding
from tidewater.llm.shared import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, replica long, shard int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4) for i, t, s in rows], DOCS)


ROWS = [(i, f"text {i % 50}", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)] + [(5000, None, None), (5001, "", "s1"), (5002, "é" * 200_000, "s1"), (5003, "same", "s2"), (5003, "same", "s2")]


def test_mixing(spark):
    weights = {"hot": 1.0, "s1": 2.0, "s2": 1.0}
    out = mixing.poisson_mix(docs(spark, ROWS), weights, total=4000).collect()
    n = Counter(s for _, _, s in ROWS)
    copies = Counter(r.doc_id for r in out)
    for i, _, s in ROWS[:3000]:
        u, rate = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / (1 << 52), weights.get(s, 0) * 4000 / 4 / n[s]
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert copies[i] == k
    by = Counter(r.source for r in out)
    assert set(by) == {"hot", "s1", "s2"} and abs(by["s1"] / len(out) - 0.5) < 0.05
    assert 400 < sum(a.doc_id > b.doc_id for a, b in zip(out, out[1:])) < len(out) - 400  # dealt out, not in order
    assert mixing.poisson_mix(docs(spark, ROWS).limit(0)).count() == 0
    assert None in {r.source for r in mixing.poisson_mix(docs(spark, ROWS), None, total=60_000).collect()}


def test_mixing_at_high_rates(spark):
    """Counts by logarithms of the terms, where exp(-rate) is 0 or denormal."""
    for n, rate in ((300, 1000.0), (20, 720.0), (3, 50_000.0)):
        out = mixing.poisson_mix(docs(spark, [(i, "x", "s") for i in range(n)]), None, total=int(n * rate)).groupBy("doc_id", "n_replicas").count().collect()
        assert len(out) == n and all(r["count"] == r.n_replicas for r in out)
        for r in out:
            u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
            cdf = lambda k: math.fsum(math.exp(j * math.log(rate) - rate - math.lgamma(j + 1)) for j in range(k + 1))
            assert cdf(r.n_replicas - 1) <= u + 1e-9 and u < cdf(r.n_replicas) + 1e-9
    assert len({r.n_replicas for r in out}) > 1


def test_many_sources_go_by_a_salted_join(spark, monkeypatch):
    few = sorted((r.doc_id, r.replica) for r in mixing.poisson_mix(docs(spark, ROWS)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", 2)
    assert sorted((r.doc_id, r.replica) for r in mixing.poisson_mix(docs(spark, ROWS)).collect()) == few


@pytest.mark.parametrize("size", [20_000, 37])
def test_shards(spark, monkeypatch, size):
    monkeypatch.setattr(sharding, "SLICE", size)
    out = sharding.shard_rows(docs(spark, ROWS), 40).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _, _ in ROWS)
    n = Counter(r.shard for r in out)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
        assert abs(sum(r.source == "hot" for r in out if r.shard == s) - n[s] / 3) <= 2.5  # each shard has the mixture
    text = {i: t or "" for i, t, _ in ROWS}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in out)
    if size == 37:
        monkeypatch.setattr(sharding, "SLICE", 20_000)
        assert sorted((r.doc_id, r.shard) for r in sharding.shard_rows(docs(spark, ROWS), 40).collect() if r.doc_id < 5000) == sorted((r.doc_id, r.shard) for r in out if r.doc_id < 5000)
    assert sharding.shard_rows(docs(spark, ROWS).limit(0), 40).count() == 0


def test_pipeline_stages(spark, sf):
    d = table(spark, sf, "documents")
    columns, last = d.columns, corpus_pipeline.STAGES[-1][0]
    for name, stage in corpus_pipeline.STAGES:
        n = d.count()
        d = stage(spark, d, sf).cache()
        assert name == last or d.columns == columns
        assert 0 < d.count() <= n or "mixing" in name
    assert d.agg({"shard": "max"}).first()[0] == 39


def test_null_source_is_apart_from_the_empty_one(spark):
    rows = [(i, "x", (None, "", "a")[i % 3]) for i in range(300)]
    only = lambda w: {r.source for r in mixing.poisson_mix(docs(spark, rows), w, total=900).collect()}
    assert only({"": 1.0}) == {""} and only({None: 1.0}) == {None} and only({"a": 1.0, None: 1.0}) == {"a", None}


def test_tiny_sources_are_spread_over_the_shards(spark):
    rows = [(i, "x", "big") for i in range(600)] + [(1000 + i, "x", f"host{i}") for i in range(300)]
    out = sharding.shard_rows(docs(spark, rows), 10).collect()
    tiny = Counter(r.shard for r in out if r.source != "big")
    assert set(tiny) == set(range(10)) and max(tiny.values()) < 50


def test_columns_of_any_name_pass_through(spark):
    """Names that operators use within, in a table that holds them all, and two columns of one name."""
    from tidewater.llm import decontaminate, language_id, simhash

    inner = ["h", "s", "f", "g", "n", "m", "slice", "slice2", "s2", "s3", "cut", "cut2", "before", "all", "block", "base", "crc", "key", "low", "cdf", "salt", "salt2", "row", "row_", "text_hash", "first", "fp", "component",
             "component_id", "u0", "u1", "k", "print", "words", "start", "end", "bad_", "gone_", "h_", "s_", "f_", "g_", "cut_", "slice_", "before_", "cdf_", "key_", "rank", "source_", "null", "lang_pred", "extra", "extra"]
    rows = [(i, f"some words of text number {i} and a few more of it", "en", f"s{i % 2}", *range(len(inner))) for i in range(30)]
    spec = "doc_id long, text string, lang string, source string, " + ", ".join(f"c{i} int" for i in range(len(inner)))
    d = spark.createDataFrame(rows, spec).toDF("doc_id", "text", "lang", "source", *inner)
    b = spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string")
    whole = sorted(map(tuple, d.collect()))
    for out in (language_id.keep_identified(d), decontaminate.clean_documents(d, b), decontaminate.clean_documents(d, b, block_words=1), simhash.keep_first(d)):
        assert out.columns == d.columns and set(map(tuple, out.collect())) <= set(whole)
    assert sorted(map(tuple, decontaminate.clean_documents(d, b).collect())) == whole
    mixed = mixing.poisson_mix(d, None, total=300)
    assert mixed.columns == [*d.columns, "replica", "n_replicas", "shuffle_key"] and {tuple(r)[:-3] for r in mixed.collect()} <= set(whole)
    out = sharding.shard_rows(d, 4)
    assert out.columns[: len(d.columns) - 1] == [c for c in d.columns if c != "text"]
    assert sorted(tuple(r)[: len(d.columns) - 1] for r in out.collect()) == sorted((r[0], *r[2:]) for r in whole)


def _folder(spark, tmp_path, rows, items):
    docs(spark, rows).withColumnRenamed("n_chars", "row").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path, [], [(1, "x")])).count() == 0


def test_pipeline_edges(spark, tmp_path):
    """Null and repeated doc_ids, null, empty and very long texts; each stage's decision on each."""
    rng = __import__("random").Random(5)
    words = lambda n: " ".join(f"{rng.choice('bdfg')}a{rng.choice('lmnr')}{rng.choice('aeiou')}{rng.choice('xyz')}o" for _ in range(n))
    a, b, c, item, long = words(40), words(40), words(40), words(30), words(30_000)
    rows = [(1, a, "s"), (1, a, "s"), (1, b, "s"), (None, c, None), (None, c, None), (None, item, "s"), (4, item, "t"), (5, None, "s"), (6, "", "s"), (7, "123 !", "s"), (8, long, "t"), (9, long, "s")]
    sf = _folder(spark, tmp_path, rows, [(1, item), (2, None)])
    d, kept = table(spark, sf, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, sf).cache()
        kept.append(sorted(((r.doc_id or 0, (r.text or "")[:99]) for r in d.collect())))
    assert len(kept[0]) == 9
    first = {(1, a), (1, b), (0, c), (4, item), (8, long[:99])}
    assert set(kept[1]) == {(i, t[:99]) for i, t in first} and len(kept[1]) == 5
    assert set(kept[2]) == {(i, t[:99]) for i, t in first if t != item}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= {1, None, 8} and sorted((r.shard, r.slot) for r in out) == [(i * 40 // len(out), 0) for i in range(len(out))]
