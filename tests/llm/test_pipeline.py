"""The whole pipeline against its stages by definition."""
import hashlib
import math
from collections import Counter

import corpus_pipeline
from tidewater.llm import decontaminate, simhash
from tidewater.llm.shared import table


def poisson(doc, rate):
    u = int(hashlib.md5(f"mix:{doc}".encode()).hexdigest()[:13], 16) / (1 << 52)
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_pipeline_equals_brute_force(spark, sf):
    rows = [r for r in table(spark, sf, "documents").collect() if any(c.isalpha() for c in r.text or "")]  # the others are `und`
    component = {d: c for d, (_, c) in simhash.brute_force([(r.doc_id, r.text) for r in rows]).items()}
    rows = [r for r in rows if component[r.doc_id] == r.doc_id]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect() if r.text is not None]
    bad = {r[0] for r in decontaminate.brute_force([(r.doc_id, r.text) for r in rows], items) if r[5]}
    rows = [r for r in rows if r.doc_id not in bad]
    n = Counter(r.source for r in rows)
    total, weights = len(rows), {s: math.sqrt(k) for s, k in n.items()}
    want = Counter({r.doc_id: poisson(r.doc_id, weights[r.source] * total / sum(weights.values()) / n[r.source]) for r in rows})
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == +want
    shards = Counter(r.shard for r in got)
    assert bad and max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(k)) for s, k in shards.items())
