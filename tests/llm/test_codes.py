"""Byte-level BPE, clusters with adaptive bounds, product-quantisation codes."""
import hashlib
import random

import numpy as np
import pytest

import public_tokenizers
from tidewater.llm import byte_bpe, centroid_clusters, vector_codes

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
POOL = "abcdefghij éèüßñ日本語中文한국어русский🙂🙃\n\t  '''1234567890!?.,́‍\x00\x1c 　"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(ranks, n):
    rng, tokens = random.Random(5), list(ranks)
    for k in range(n):
        yield ("".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))) if k % 2 else b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 12))).decode("utf-8", "replace"))


@pytest.mark.parametrize("states, window", [(300_000, 512), (40, 3)])
def test_transducer_equals_the_library(ranks, library, states, window):
    import regex

    pieces, split = byte_bpe.Pieces(byte_bpe.Transducer(ranks, states, window)), regex.compile(PATTERN)
    for text in random_texts(ranks, 1500):
        assert byte_bpe.encode_text(text, split, pieces).tolist() == library.encode_ordinary(text)


def test_transducer_equals_merging_by_definition(ranks):
    rng, tokens, machine = random.Random(6), list(ranks), byte_bpe.Transducer(ranks, window=8)
    for _ in range(1500):  # one piece, whatever it holds
        data = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))[:80]
        assert machine.encode(data) == [ranks[x] for x in machine.merged(data)]
    small = {bytes([b]): b for b in range(256)} | {x: 256 + i for i, x in enumerate([b"ab", b"aa", b"bb", b"aab", b"abab", b"bbb", b"aaaa"])}
    machine = byte_bpe.Transducer(small, 5, 2)
    for n in range(1, 11):
        for bits in range(1 << n):
            data = bytes(97 + (bits >> i & 1) for i in range(n))
            assert machine.encode(data) == [small[x] for x in machine.merged(data)]


def test_a_token_that_no_merges_make():
    """It stands for a whole piece only, as in the library."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    machine, library = byte_bpe.Transducer(ranks), tiktoken.Encoding("x", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "xyzab", "abxyz", "ab"):
        assert machine.encode(text.encode()) == library.encode_ordinary(text)
    with pytest.raises(ValueError):
        byte_bpe.Transducer({b"a": 0})
    with pytest.raises(ValueError):
        byte_bpe.Transducer({bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257}).encode(b"abcx")


def test_held_back_tokens_are_bounded(ranks):
    """A long piece is written as it is read: what is held back after each window is no longer than a few tokens."""
    machine, rng = byte_bpe.Transducer(ranks, window=64), random.Random(7)
    piece = "".join(rng.choice("etaoinshr") for _ in range(20_000)).encode()
    held, met = [], machine._met

    def watched(state, seams):
        sure = met(state, seams)
        held.append(len(seams) - sum(machine.length[x] for x in sure))
        return sure

    machine._met = watched
    assert b"".join(machine.token[x] for x in machine.encode(piece)) == piece
    assert len(held) > 300 and max(held) <= 2 * max(map(len, ranks))


def test_utf8_machine_decodes_streams(ranks):
    rng, machine = random.Random(8), byte_bpe.Decoder(ranks)
    for _ in range(300):
        data = bytes(rng.choice([rng.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 65]) for _ in range(rng.randint(0, 60)))
        ids, step = [ranks[bytes([b])] for b in data], rng.randint(1, 7)
        parts = list(machine.decode(ids[i : i + step] for i in range(0, len(ids), step)))
        assert "".join(parts) == data.decode("utf-8", "replace")
    smile = [ranks[bytes([b])] for b in "🙂".encode()]
    assert list(machine.decode([[smile[0]], [smile[1]], [smile[2]], [smile[3], smile[0]]])) == ["🙂", "�"]
    with pytest.raises(ValueError):
        list(machine.decode([[60_000]]))


def test_parts_hold_whole_matches(library):
    import regex

    split, rng = regex.compile(PATTERN), random.Random(9)
    text = "".join(rng.choice("ab  \n'1.é") for _ in range(3000))
    for most in (1, 7, 100):
        parts = list(byte_bpe.parts_of(text, most))
        assert "".join(parts) == text and [m for p in parts for m in split.findall(p)] == split.findall(text)


def test_round_trip_of_documents(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    cases = [(-1, None), (-2, ""), (-3, "x" * 200_000 + " 日本" * 50_000), (-4, "a b"), (-4, "a b"), (None, "c")]
    docs = spark.createDataFrame([*[(r.doc_id, r.text) for r in rows], *cases], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded")
    want = sorted((str(i), len(x := library.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in [*[(r.doc_id, r.text) for r in rows], *cases])
    once = byte_bpe.round_trip(docs, PATH, PATTERN)
    twice = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH)
    for coded in (once, twice):
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digest(coded).collect()) == want
    assert byte_bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().decoded is None


VECTORS = "vec_id long, label int, embedding array<float>, cluster int, v int, n int, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, 1, 2, 3, "x") for i, label, v in rows], VECTORS)


@pytest.fixture(scope="module")
def cloud():
    """Groups of near vectors, copies, ties between centroids, and what can't be used."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 64))
    rows = [(i, int(i % 5) if i % 7 else None, (centres[i % 12] + rng.normal(0, 0.15, 64)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, 1, rows[3][2]) for i in range(30)]
    rows += [(440 + i, 2, [float(i % 2)] * 64) for i in range(20)]
    bad = [(500, 1, None), (501, 1, [1.0] * 63 + [float("nan")]), (502, 1, [float("inf")] + [0.0] * 63), (503, 1, [0.0] * 63 + [None])]
    return rows, bad


def test_clusters_equal_brute_force(spark, cloud):
    rows, bad = cloud
    short = [(504, 1, [0.5] * 48), (505, 1, [])]
    got, centroids = centroid_clusters.clusters(vectors(spark, rows + bad + short).repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and len(centroids) == 16
    want = centroid_clusters.brute_force([(i, v) for i, _, v in rows + bad + short])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    for few in (rows[:9], rows[:1], rows[440:], [(i, 1, rows[0][2]) for i in range(40)]):
        want = centroid_clusters.brute_force([(i, v) for i, _, v in few])
        assert sorted(map(tuple, centroid_clusters.clusters(vectors(spark, few))[0].collect())) == sorted(want)
    assert centroid_clusters.clusters(vectors(spark, rows[:1]).limit(0))[0].count() == 0
    assert centroid_clusters.clusters(vectors(spark, bad))[0].count() == 0
    repeated = vectors(spark, rows[:40] + rows[:40] + [(None, 1, rows[5][2])])
    assert centroid_clusters.clusters(repeated)[0].count() == 81


def test_bounds_are_safe_and_save_work():
    """Over many rounds of moving centroids: clusters and distances of a full search, ties included, and bounds below all true distances."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (600, 64)) + 20 * rng.integers(0, 4, (600, 1))
    c = x[rng.choice(600, 16, replace=False)].copy()
    c[7] = c[3]
    b, judged = centroid_clusters.full_search(x, c), []
    for step in range(30):
        new = c + rng.integers(-(20 // (1 + step)), 20 // (1 + step) + 1, c.shape)
        moved = centroid_clusters.above(centroid_clusters.own_distances(new, c))
        c = new
        if step % 5 == 4:
            c[9] = c[2]
            moved[9] = 1e9
        b, how = centroid_clusters.adapt(x, b, c, moved)
        judged.append(how)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (b.cluster == d.argmin(axis=1)).all() and (b.distance == d.min(axis=1)).all()
        true = np.sqrt(d)
        assert (b.lower <= np.take_along_axis(true, b.near, axis=1)).all()
        others = true.copy()
        np.put_along_axis(others, np.concatenate((b.cluster[:, None], b.near), axis=1), np.inf, axis=1)
        assert (b.rest <= others.min(axis=1)).all()
    assert {0, 1, 2} == set(np.concatenate(judged).tolist()) and (judged[-2] == 0).mean() > 0.5


def test_large_components_are_exact():
    x = np.array([[1 << 40] * 3, [(1 << 40) + 1] * 3, [0] * 3], dtype=np.int64)
    assert centroid_clusters.distances(x, x).tolist() == [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in x] for a in x]


def test_codes_equal_brute_force(spark, cloud):
    rows, bad = cloud
    coded, books = vector_codes.encode(vectors(spark, rows + bad).repartition(5))
    got = vector_codes.digest(coded, books)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and books.shape == (16, 64, 4)
    want = vector_codes.brute_force(rows + bad)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(r.label_error for r in vector_codes.with_label_error(coded, 1).collect()) == sorted(x[3] for x in want)  # no label is hot
    one = {r.vec_id: r for r in coded.collect()}[3]
    assert sum((a - b) ** 2 for a, b in zip(vector_codes.decode(one.code, books), vector_codes.scaled(rows[3][2], 256))) == one.error
    for few in (rows[:9], rows[:1], [(i, None, rows[0][2]) for i in range(70)]):
        got = vector_codes.digest(*vector_codes.encode(vectors(spark, few)))
        assert sorted(map(tuple, got.collect())) == sorted(vector_codes.brute_force(few))
    assert vector_codes.digest(*vector_codes.encode(vectors(spark, rows[:1]).limit(0))).count() == 0
    odd = [(-1, 1, [0.5] * 48), (-2, 1, [0.5] * 50), (-3, 1, [])]
    got = {r.vec_id: r for r in vector_codes.encode(vectors(spark, rows[:20] + odd))[0].collect()}
    assert len(got) == 23 and got[0].code is None and got[-1].error == 0 and got[-2].code is None and got[-3].error is None
    repeated = vectors(spark, rows[:20] + rows[:20] + [(None, 1, rows[5][2])])
    assert vector_codes.digest(*vector_codes.encode(repeated)).count() == 41
    with pytest.raises(Exception, match="65536"):
        vector_codes.encode(vectors(spark, [(1, 1, [65536.0] * 64)]))


def test_partial_distances_are_those_of_a_full_search():
    rng = np.random.default_rng(6)
    for width, size, block in ((4, 64, 16), (1, 64, 16), (24, 64, 5), (4, 3, 16), (4, 1, 1)):
        book = rng.integers(-40, 41, (size, width)) * np.array([1, 4, 2, 3] * 6)[:width]
        x = np.concatenate((rng.integers(-160, 161, (500, width)), book))
        code, best, steps = vector_codes.nearest(x, book, block)
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        if width == 24:
            assert steps < 0.6 * d.size * width
    book = np.zeros((5, 4), np.int64)  # ties go to the lower index
    assert vector_codes.nearest(np.ones((3, 4), np.int64), book, 2)[0].tolist() == [0, 0, 0]
