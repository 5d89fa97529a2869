"""Chat formatting, toxicity, language ID and the token store."""
import math
import random
import zlib

import numpy as np
import pytest

from tidewater.llm import chat_format, language_id, queries, token_store, toxicity
from tidewater.llm.shared import table

DOCS = "doc_id long, text string, lang string, source string, score double, held_out boolean"


def docs(spark, rows):
    """With extra columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, t, lang, "s", 9.0, True) for i, t, lang in rows], DOCS)


def test_turns_survive_any_text():
    rng = random.Random(5)
    bits = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "a", "assistant", ">", "<\\|", "im_end|>"]
    for _ in range(3000):
        role, text = ("".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(2))
        out = chat_format.render(role, text)
        assert chat_format.parse(out) == [(role, text)]
        assert out.count("<|im_start|>") == out.count("<|im_end|>") == 1
    assert chat_format.parse(chat_format.render("a", "x") + chat_format.render("b", "<|im_end|>\n")) == [("a", "x"), ("b", "<|im_end|>\n")]
    with pytest.raises(ValueError):
        chat_format.parse("loose")


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "é"), (1, 1, "assistant", "é"), (None, 0, "assistant", "<|im_end|>"), (2, 0, "assistant", "y" * 300_000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_turns(c)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (4, 2), None: (1, 10), 2: (1, 300_000)}
    assert chat_format.conversation_digests(chat_format.format_turns(c.limit(0))).count() == 0


def test_chat_digests_by_definition(spark):
    """Repeated turns go by role, then text, also where either is escaped; other columns, of whatever name, are ignored."""
    import hashlib

    tricky = ["x", "x y", "x!", "x<|im_end|>", "x<|", "x<\\|", "", "é", "<|im_start|>", "x\n", "<\\\\|"]
    roles = ["assistant", "user", "a\nb", "a\\nb", "a|", "a<", "a\\", "a\\\\n", None, "assistant "]
    rng = random.Random(9)
    rows = [(i % 3, rng.choice([None, 0, 1]), rng.choice(roles), rng.choice([*tricky, None]), "c", i) for i in range(300)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, n_turns long")
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_turns(c)).collect()}
    for conv in range(3):
        turns = sorted(((t is not None, t or 0, (r or "").encode(), (x or "").encode()) for k, t, r, x, *_ in rows if k == conv))
        loss = b"".join(x for *_, r, x in turns if r == b"assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for *_, r, x in turns)).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(loss.decode()), hashlib.sha256(loss).hexdigest())


def test_language_edges(spark):
    rows = [(i, "the cat and the dog with this thing" if i % 2 else "der hund und die katze mit dem ding", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "en"), (103, "the thing " * 40_000, None), (104, "THE DOG", "en"), (104, "THE DOG", "en")]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in language_id.predictions(d).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104, 1, 2)] == ["und", "und", "und", "en", "en", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[100].score == 0
    kept = language_id.keep_identified(d)
    assert kept.columns == d.columns and kept.count() == len(rows) - 3
    assert language_id.predictions(d.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.predictions(d.withColumn("lang", d.lang.substr(1, 0))).collect()} <= {"", "und"}


def test_language_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    p = queries.op4_rank_order(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.97


def test_long_texts_are_counted_by_parts(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abÉ  \n,.'ßΣ1") for _ in range(n)) for n in (0, 1, 50, 700)] + ["word" * 100, " " * 90]
    whole = [language_id.counts_of(t) for t in texts]
    monkeypatch.setattr(language_id, "PIECE", 7)
    for t, (k, n) in zip(texts, whole):
        parts = list(language_id.pieces(t))
        assert "".join(parts) == t and all(parts)
        got = language_id.counts_of(t)
        assert got[0].tolist() == k.tolist() and got[1].tolist() == n.tolist()


def test_out_of_place_distance_by_definition():
    profiles = {"x": language_id.top(language_id.grams("abc abd abe")), "y": language_id.top(language_id.grams("xyz xyw"))}
    own = language_id.top(language_id.grams("abc"))
    far = {}
    for name, prof in profiles.items():
        rank = {g: i for i, g in enumerate(prof.tolist())}
        far[name] = sum(abs(rank[g] - i) if g in rank else language_id.PROFILE for i, g in enumerate(own.tolist()))
    lang, score = language_id.Model(profiles).predict("abc")
    assert lang == min(far, key=far.get) and score == pytest.approx(1 - far[lang] / (language_id.PROFILE * len(own)))


TOXIC_TEXT = "what a loser and idiot, a stupid clown; the moron is pathetic trash. today you are an ass, a real ass with a class " * 50


@pytest.fixture(scope="module")
def decoder(spark):
    return toxicity.Decoder(toxicity.letter_model(docs(spark, [(1, TOXIC_TEXT, "en")])))


@pytest.mark.parametrize("noisy, plain", [
    ("l0ser", "loser"), ("1d10t", "idiot"), ("stup1d", "stupid"), ("cl0wn", "clown"), ("l o s e r", "loser"), ("m-o-r-o-n", "moron"), ("looooser", "loser"), ("tr4sh", "trash"), ("p@thet1c", "pathetic"),
    ("l 0 s 3 r", "loser"), ("l.0.s.e.r", "loser"), ("s-t-u-p-1-d", "stupid"), ("m 0 r o n", "moron"), ("@$$", "ass"), ("idiiot", "idiot"), ("what a l o s e r", "loser"),
    ("i d i o t l o s e r", "idiot loser"), ("l 0 s e r!", "loser"), ("l-0-s-e-r", "loser"), ("l*o*s*3*r", "loser"), ("losser", "loser"), ("llooser", "loser"), ("today.l0ser", "today loser"),
    ("you-l0ser", "you loser"), ("l/o/s/e/r", "loser"), ("(L.O.S.E.R.)!!", "loser"), ("what" * 30 + "-l0ser", "loser"), ("l o s e r  i d i o t", "loser idiot"), ("stu pid", "stupid"), ("id iot", "idiot"), ("l-o s e-r", "loser"), ("mor on!", "moron"), ("(lo ser)", "loser"), ("cla$$", "class"),
])
def test_restored_words(decoder, noisy, plain):
    assert set(plain.split()) <= decoder.words(f"there {noisy} there")


def test_viterbi_finds_the_best_of_all_paths(decoder):
    from itertools import product

    rng = random.Random(8)
    for _ in range(400):
        span = "".join(rng.choice("aloser01$.-  lloo") for _ in range(rng.randint(0, 7))).strip()
        scores: dict[str, float] = {}
        for path in product(*decoder.lattice(span)):
            codes, text = [k for ks, _, _ in path for k in ks], "".join(x for _, _, x in path)
            s, word = -sum(cost for _, cost, _ in path), []
            for k in [*codes, 0]:
                if k or word:
                    h = ([0, 0, 0] + word)[-3:]
                    s += decoder.p[((h[0] * 28 + h[1]) * 28 + h[2]) * 28 + k]
                word = word + [k] if k else []
            scores[text] = max(s, scores.get(text, -math.inf))
        got = decoder.decode(span)
        assert scores[got] == pytest.approx(max(scores.values())), (span, got)


def test_letter_model_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    d = docs(spark, [(i, "".join(rng.choice("abcé Ünn1.") for _ in range(rng.randint(0, 60))), "x") for i in range(300)] + [(999, None, "x")])
    one, many = toxicity.letter_model(d.coalesce(1)), toxicity.letter_model(d.repartition(7))
    assert (one == many).all()
    assert toxicity.grams(["ab", "é"]).tolist() == [(0 * 28 + 0) * 28 + 1, ((0 * 28 + 0) * 28 + 1) * 28 + 2, (((0 * 28 + 1) * 28) + 2) * 28, 27, 27 * 28]


def test_toxicity_edges(spark):
    rng = random.Random(2)
    words = [f"word{chr(97 + i)}{chr(97 + j)}".replace("word", "qu") for i in range(20) for j in range(20)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" vile" + rng.choice(["", "st", "ness"]) if i % 5 == 1 else ""), "en") for i in range(400)]
    rows += [(1000, None, None), (1001, "", None), (1002, "v1le", None), (1003, "so v i l e", None), (1004, "quaa " * 100_000 + "vile", None)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(400)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    got = {r.doc_id: r for r in toxicity.score(d, labels).collect()}
    assert sum(got[i].predicted != (i % 5 == 1) for i in range(400)) <= 4
    assert got[1002].predicted == got[1003].predicted == got[1004].predicted == 1 and got[1000].predicted == got[1001].predicted == 0
    none = toxicity.score(d, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and toxicity.score(d.limit(0), labels).count() == 0


def test_toxicity_scores_are_the_models(spark):
    """Against a plain re-computation; labels of held-out rows don't matter, nor do partitions or repeated rows."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}o" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    rows = [(i, " ".join(rng.choices(words, k=20)) + (" v1le" if i % 4 == 0 else ""), "en") for i in range(300)]
    d = docs(spark, rows + rows[:9])
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    label = lambda flip: spark.createDataFrame([(i, 1, int(i % 4 == 0) ^ int(flip and i in held)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    first, other = ({(r.doc_id, r.score) for r in toxicity.score(x, label(flip)).collect()} for x, flip in ((d, False), (d.repartition(5), True)))
    assert first == other and len(first) == len(rows)
    letter = toxicity.letter_model(d)
    model, decoder = toxicity.train(d, label(False), letter), toxicity.Decoder(letter)
    assert model["weights"]
    text = {i: t for i, t, _ in rows}
    for i, score in first:
        found = {w + "$" for w in decoder.words(text[i])} | {w[:n] for w in decoder.words(text[i]) for n in (4, 5) if len(w) > n}
        z = model["base"] + sum(w for f, w in model["weights"].items() if f in found)
        assert score == pytest.approx(1 / (1 + math.exp(-z)))


def test_store_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(1)
    signs = "ab Z.,'\n\t\r*$9é́ßİΣς<|>endoftext \x85日本½ﬁ"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 80))), "x") for i in range(300)]
    rows += [(5, "<|endoftext|> don't they'll a.b. c., d", "x"), (-3, None, None), (900, "long wörds " * 60_000, "x"), (901, "long wörds " * 60_000, "x")]
    lib = Tokenizer.from_file(path)
    store = token_store.write(docs(spark, rows), path)
    got = sorted(map(tuple, token_store.verify(spark, store).collect()), key=lambda r: r[1])
    start, by_id = 0, {}
    for i, t, _ in rows:
        by_id.setdefault(i, []).append(lib.encode(t or "", add_special_tokens=False).ids + [2])
    assert [g[0] for g in got] == sorted(i for i, _, _ in rows)
    for doc, at, n, crc in got:
        assert at == start and any(len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc for x in by_id[doc])
        start += n
    for r in token_store.reconstruct(spark, store).collect():
        assert list(r.ids) in by_id[r.doc_id]
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()
    top = spark.read.parquet(f"{store}/manifest").first()
    assert (top.id_bytes, top.end_id, top.n_docs, top.n_tokens, top.n_chunks) == (2, 2, len(rows), start, chunks.count())
    assert token_store.verify(spark, token_store.write(docs(spark, rows).limit(0), path)).count() == 0


def _store(spark, path, rows):
    import public_tokenizers

    return token_store.write(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), str(path))


def test_store_is_kept_and_opens_elsewhere(spark, tmp_path):
    import subprocess
    import sys

    store = _store(spark, tmp_path / "kept", [(i, f"text number {i} of many", "x") for i in range(20)])
    code = (
        "from pyspark.sql import SparkSession; from tidewater.llm import token_store; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
        f"print('docs', token_store.reconstruct(s, {store!r}).count(), token_store.verify(s, {store!r}).count())"
    )
    assert "docs 20 20" in subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout
    with pytest.raises(Exception, match="already exists"):
        _store(spark, store, [])


@pytest.mark.parametrize("broken, change, message", [
    ("chunks", "address, substring(ids, 1, length(ids) - 2) AS ids", "does not hash"),
    ("recipes", "part, doc_id, start, n_tokens, root, slice(parts, 1, size(parts) - 1) AS parts", "does not give its root|is missing"),
    ("recipes", "part, doc_id + 1 AS doc_id, start, n_tokens, root, parts", "its manifest"),
    ("manifests", "part, first_doc, last_doc, n_docs + 1 AS n_docs, n_tokens, root", "its manifest"),
    ("manifest", "format, id_bytes, end_id, tokenizer_sha256, n_buckets, n_parts, n_docs, n_tokens + 1 AS n_tokens, n_chunks, root", "the store's manifest"),
])
def test_broken_stores_are_refused(spark, tmp_path, broken, change, message):
    store = _store(spark, tmp_path / "good", [(i, f"text number {i} of many " * 40, "x") for i in range(5)])
    top = spark.read.parquet(f"{store}/manifest").first()
    for t in ("chunks", "recipes", "manifests", "manifest"):
        d = spark.read.parquet(f"{store}/{t}")
        d = d.selectExpr(*_columns(change)) if t == broken else d
        if t == "chunks":
            token_store._write_bucketed(d.repartition(top.n_buckets, "address"), str(tmp_path / "bad" / t), top.n_buckets)
        else:
            d.write.parquet(str(tmp_path / "bad" / t))
    with pytest.raises(Exception, match=message):
        token_store.verify(spark, str(tmp_path / "bad")).collect()


def _columns(text):
    """Expressions parted at commas outside of brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def test_other_vocabularies_go_through_the_library(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Don't stop, Straße 12", "x"), (2, None, "x"), (3, "a\n\nb  c", "x")]
    got = {r.doc_id: list(r.ids) for r in token_store.reconstruct(spark, token_store.write(docs(spark, rows), path)).collect()}
    lib = Tokenizer.from_file(path)
    assert got == {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}


def test_merkle_by_levels():
    for n in range(40):
        level = leaves = [bytes([i]) * 20 for i in range(n)]
        while len(level) > 1:
            level = [token_store.address(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert token_store.Merkle(leaves).root() == (level[0] if level else token_store.address(b""))


def test_cuts():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49000, 50_000)
    ends = token_store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    shifted = token_store.cuts(np.concatenate((rng.integers(0, 49000, 777), ids)))
    assert len({e - 777 for e in shifted} & set(ends)) > 0.8 * len(ends)  # cuts follow the content


def test_tokens_that_give_nothing_wanted_are_not_decoded(monkeypatch):
    """What is found is the same as without leaving out; of letters alone, only tokens that may give something wanted are decoded."""
    rng = np.random.default_rng(3)
    decoder = toxicity.Decoder(np.log(rng.dirichlet(np.ones(28), 28**3)).reshape(28, 28, 28, 28))
    wanted = frozenset({"loser$", "lose", "moron", "book$", "aab$", "feeb"})
    alphabet, tokens = list("looserbkmnaaef1!é."), set()
    for _ in range(4000):
        tokens.add("".join(rng.choice(alphabet, rng.integers(1, 9))))
    tokens |= {"loooser", "loosers", "book", "boook", "bok", "moroon", "moroons", "aaab", "feeeble", "(looser!)", "letter", "losser", "ééloser"}
    find = toxicity.Features(decoder, wanted)
    for t in sorted(tokens):
        assert set(find.of_token(t)) == toxicity.features(decoder.token_words(t)) & wanted, t
    asked = []
    monkeypatch.setattr(decoder, "decode", lambda span: asked.append(span) or span)
    find("letters bottle looser assess")
    assert asked == ["looser"]
