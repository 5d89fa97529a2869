"""Toxicity by noisy-channel deobfuscation.

Every token is a lattice of what its characters may stand for: a sign for letters or for itself (l0ser), a repeated letter for one or
two (looser, loooser), any other character within it for nothing or for a gap between words (l.o.s.e.r, you-loser). So is every run of
tokens of one character each (l 0 s e r) and of up to three (stu pid, l-o s e-r), where a space stands for nothing or for a gap. The Viterbi path under a character 4-gram
model, trained on the words of all documents, is the restored text. A token of letters without a doubled one has a single path
and is its own restoration; that is the only one that isn't decoded. A sparse logistic model over words and word stems scores the
restored text, in training as in use; the text as it stands isn't looked at. A run's neighbours may be words of one letter (what a
l o s e r), so a run is also restored without its first and without its last letter.

The 4-gram counts are taken over all documents, within words and by code points, so they are the same however rows are partitioned;
they are at most 28^4 rows. The logistic model is fitted on labelled documents that aren't held out, at most SAMPLE of them, taken by
hash; it chooses among the FEATURES words and stems that tell the labels apart best, of those in LEAST_DOCS toxic documents of the
sample or more and LIFT times as frequent there, and only weights for toxicity are kept. What reaches the driver is bounded by SAMPLE
and FEATURES. Documents are scored one by one, whole, within the scan: nothing is shuffled for it.

Defined cases: null, empty and wordless texts get the model's base score; several labels of a document: toxic if one says so;
null labels are ignored; without labels all scores are 0; equal rows get equal scores; empty input gives no rows; other columns are
not returned.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import materialize, row_slices, small_batches

SAMPLE, FEATURES, LEAST_DOCS, LIFT, STEMS, REFIT = 40_000, 4_000, 3, 3, (4, 5), 2e-6
HELD_OUT_OF, MOST_PIECES = 5, 200_000
# fixed values: what a sign may stand for
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
_EDGES = ".,;:?\"'()[]{}<>"
_DOUBLED = re.compile(r"(.)\1")
_SINGLES = re.compile(r"(?<!\S)[.,;:?\"'()\[\]{}<>]*[^\s.,;:?\"'()\[\]{}<>][.,;:?\"'()\[\]{}<>!]*(?:\s+[.,;:?\"'()\[\]{}<>]*[^\s.,;:?\"'()\[\]{}<>][.,;:?\"'()\[\]{}<>!]*(?!\S))+")
#: Log-probabilities lost in the channel: a sign for a letter, a sign as itself, two equal letters for one, a character within a word
#: that vanishes, several spaces that do.
SIGN, ITSELF, DOUBLED, VANISHED, SPACES = 1.0, 3.0, 2.0, 0.5, 3.0
ORDER = 28
_SAME = re.compile(r"(.)\1+")
_CODES: list[np.ndarray] = []


def codes() -> np.ndarray:
    """Of a code point: 0 no letter, 1-26 a to z, 27 another letter."""
    if not _CODES:
        c = np.fromiter((27 * chr(i).isalpha() for i in range(0x110000)), np.int32, 0x110000)
        c[97:123] = np.arange(1, 27)
        _CODES.append(c)
    return _CODES[0]


def code(letter: str) -> int:
    return int(codes()[ord(letter)])


def grams(texts: list[str]) -> np.ndarray:
    """4-grams of the words of texts, each word between gaps (code 0)."""
    c = codes()[np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = c[np.concatenate(([True], (c[1:] > 0) | (c[:-1] > 0)))]  # one gap between words
    pad = np.concatenate((np.zeros(2, c.dtype), c))
    h1, h2, h3 = pad[2:-1], pad[1:-2], pad[:-3]
    h2 = np.where(h1 > 0, h2, 0)
    h3 = np.where(h2 > 0, h3, 0)
    now = c[1:]
    some = (now > 0) | (h1 > 0)
    return (((h3 * ORDER + h2) * ORDER + h1) * ORDER + now)[some]


def _count(batches):
    total = np.zeros(ORDER**4, np.int64)
    for whole in batches:
        for b in row_slices(whole, "text", 1 << 20):
            total += np.bincount(grams([t for t in b.column("text").to_pylist() if t]), minlength=ORDER**4)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """log P(fourth | first three), from the words of all documents; shorter histories fill in for rare ones."""
    small_batches(docs.sparkSession)
    counts = np.zeros(ORDER**4)
    for gram, n in docs.select("text").mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    c4 = counts.reshape(ORDER, ORDER, ORDER, ORDER)
    p = np.full(ORDER, 1.0 / ORDER)
    for c in (c4.sum(axis=(0, 1)), c4.sum(axis=0), c4):
        p = (c + 5 * p[None]) / (c.sum(axis=-1, keepdims=True) + 5)
    return np.log(p)


def bare(token: str) -> str:
    return token.strip(_EDGES).rstrip("!").rstrip(_EDGES) or token.strip(_EDGES)


class Decoder:
    def __init__(self, model: np.ndarray):
        self.p, self.options, self.pieces = model.reshape(-1).tolist(), {}, {}

    def arcs(self, c: str, run: int) -> list[tuple[tuple[int, ...], float, str]]:
        """What a run of one character may stand for: codes, cost, text. The text of a gap is a space."""
        key = (c, min(run, 3))
        if key not in self.options:
            if c.isspace():
                out = [((), 0.0 if run == 1 else SPACES, ""), ((0,), 0.0, " ")]
            elif c in SIGNS:
                letters = [(code(x), x) for x in SIGNS[c]]
                out = [((k,), SIGN, x) for k, x in letters] + [((k, k), SIGN + SIGN / 2, x + x) for k, x in letters if run > 1] + [((0,), ITSELF * min(run, 2), " ")]
            elif c.isalpha():
                k = code(c)
                out = [((k,) * run, 0.0, c * run)] if run < 3 else [((k,), 0.0, c), ((k, k), 0.0, c + c)]
                out += [((k,), DOUBLED, c)] if run == 2 else []
            else:
                out = [((), VANISHED, ""), ((0,), 0.0, " ")]
            self.options[key] = out
        return self.options[key]

    def lattice(self, span: str) -> list[list]:
        """Arcs of each run of equal characters, a run of white space being one of spaces."""
        out, i = [], 0
        while i < len(span):
            c, j = span[i], i + 1
            while j < len(span) and (span[j] == c or c.isspace() and span[j].isspace()):
                j += 1
            out.append(self.arcs(" " if c.isspace() else c, j - i))
            i = j
        return out

    def decode(self, span: str) -> str:
        """The likeliest text behind a span in lower case: letters, and a space where words part."""
        p, done = self.p, []
        best = {0: (0.0, None)}  # by the last three codes: score, and the path as a chain of texts
        for arcs in self.lattice(span):
            new: dict = {}
            for last, (score, path) in best.items():
                for ks, cost, text in arcs:
                    s, h = score - cost, last
                    for k in ks:
                        if k:
                            s += p[h * 28 + k]
                            h = h % 784 * 28 + k
                        elif h:
                            s += p[h * 28]
                            h = 0
                    if h not in new or new[h][0] < s:
                        new[h] = (s, (path, text))
            best = new
            if len(best) == 1:  # all paths meet: what lies behind is settled
                h, (s, path) = best.popitem()
                done.append(_spelled(path))
                best = {h: (s, None)}
        s, path = max(((s + (p[h * 28] if h else 0.0), path) for h, (s, path) in best.items()), key=lambda x: x[0])
        return "".join([*done, _spelled(path)])

    def token_words(self, token: str) -> list[str]:
        """Words behind a token in lower case."""
        t = bare(token)
        return [t] if t.isalpha() and not _DOUBLED.search(t) else self.decode(t).split()

    def run_words(self, text: str) -> list[str]:
        """Words behind the runs of tokens of one character."""
        out = []
        for m in _SINGLES.finditer(text):
            run = "".join(x if x.isspace() else bare(x) for x in re.split(r"(\s+)", m[0]))
            out += self.decode(run).split()
            inner = run.split(None, 1)[-1]
            for part in (inner, run.rsplit(None, 1)[0]) if len(run.split(None, 3)) > 3 else ():
                out += self.decode(part).split()
        return out

    def piece(self, token: str) -> str:
        """A token of up to three characters without its edges; of others nothing."""
        found = self.pieces.get(token)
        if found is None:
            if len(self.pieces) > MOST_PIECES:
                self.pieces.clear()
            t = bare(token)
            found = self.pieces[token] = t if len(t) <= 3 else ""
        return found

    def piece_runs(self, tokens: list[str]) -> set[str]:
        """Runs of pieces; tokens in the text's order."""
        out, run, known = set(), [], self.pieces.get
        for t in tokens:
            if len(t) < 8:
                p = known(t)
                if p or p is None and (p := self.piece(t)):
                    run.append(p)
                    continue
            if run:
                if len(run) > 1:
                    out.add(" ".join(run))
                run = []
        if len(run) > 1:
            out.add(" ".join(run))
        return out

    def words(self, text: str) -> set[str]:
        text = text.lower()
        pieces = {w for run in self.piece_runs(text.split()) for w in self.decode(run).split()}
        return {w for t in set(text.split()) for w in self.token_words(t)} | set(self.run_words(text)) | pieces


def _spelled(path) -> str:
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


class Features:
    """Words and stems of a restored text, of those wanted (None: all); what a token gives is kept in a cache of bounded size.

    A run of pieces is decoded only if it may give something wanted. Of letters alone, all that it can give is its letters without some
    spaces and doubled letters, so with both left out on both sides, what is wanted must be within it. So is a token: of letters alone, it
    gives one word, which begins with what is wanted, doubled letters left out on both sides.
    """

    def __init__(self, decoder: Decoder, wanted=None, most: int = 600_000):
        self.decoder, self.wanted, self.most, self.cache, self.runs = decoder, wanted, most, {}, {}
        self.near = None if wanted is None else re.compile("|".join(sorted({re.escape(_SAME.sub(r"\1", f.rstrip("$"))) for f in wanted})) or r"(?!)")
        short = lambda words: frozenset(_SAME.sub(r"\1", w) for w in words)
        self.stems, self.whole = (None, None) if wanted is None else (short(f for f in wanted if not f.endswith("$")), short(f[:-1] for f in wanted if f.endswith("$")))

    def of_token(self, token: str) -> tuple:
        t = token if token.isalpha() else bare(token)
        if self.wanted is not None and t.isalpha():
            if not _DOUBLED.search(t):
                return tuple(f for f in (t + "$", *[t[:n] for n in STEMS if len(t) > n]) if f in self.wanted)
            s = _SAME.sub(r"\1", t)
            if s not in self.whole and not any(s[:n] in self.stems for n in range(1, max(STEMS) + 1)):
                return ()
        return self.of_words(self.decoder.token_words(token))

    def of_run(self, run: str) -> tuple:
        letters = run.replace(" ", "")
        if len(letters) * 2 - 1 == len(run):  # single characters are run_words' matter
            return ()
        if self.near is not None and letters.isalpha() and not self.near.search(_SAME.sub(r"\1", letters)):
            return ()
        return self.of_words(self.decoder.decode(run).split())

    def of_words(self, words) -> tuple:
        f = features(words)
        return tuple(f if self.wanted is None else f & self.wanted)

    def __call__(self, text: str) -> set[str]:
        text = text.lower()
        ordered, cache, out = text.split(), self.cache, set()
        tokens = set(ordered)
        if len(cache) + len(self.runs) > self.most:
            cache.clear()
            self.runs.clear()
        known = cache.get
        for t in tokens:
            if (f := known(t)) is None:
                f = cache[t] = self.of_token(t)
            if f:
                out.update(f)
        if words := self.decoder.run_words(text):
            out.update(self.of_words(words))
        for run in self.decoder.piece_runs(ordered):
            if (f := self.runs.get(run)) is None:
                f = self.runs[run] = self.of_run(run)
            out.update(f)
        return out


def features(words) -> set[str]:
    out = {w + "$" for w in words}
    for n in STEMS:
        out |= {w[:n] for w in words if len(w) > n}
    return out


def not_held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF != 0


def _features(shared):
    def run(batches):
        find = Features(Decoder(shared.value))
        for whole in batches:
            for b in row_slices(whole, "text"):
                rows = [sorted(find(t or "")) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.string()))], names=["toxic", "features"])
    return run


def fit(rows: list[tuple[int, list[int]]], n: int, strength: float = 4e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; rows: label, features present."""
    y = np.array([r[0] for r in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([c for r in rows for c in r[1]], np.int64)
    w, v, base, t = np.zeros(n), np.zeros(n), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 1.0
    each = max(1.0, np.bincount(doc, minlength=1).max(initial=1))
    rate = 4.0 / each
    for _ in range(rounds):
        z = base + np.bincount(doc, weights=v[col], minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        step = v - rate * np.bincount(col, weights=g[doc], minlength=n) * 25
        new = np.sign(step) * np.maximum(np.abs(step) - rate * strength * 25, 0)
        new = np.maximum(new, 0)  # only what speaks for toxicity
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
        base -= rate * g.sum()
    return w, base


def train(docs: DataFrame, labels: DataFrame, letter: np.ndarray) -> dict:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(letter)
    sample = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled_")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.withColumn("doc_id", F.col("labelled_")).filter(not_held_out()).drop("doc_id").orderBy(F.xxhash64("labelled_"), "labelled_").limit(SAMPLE)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_")).select("toxic", "text")
    rows, _ = materialize(chosen.mapInArrow(_features(shared), "toxic int, features array<string>"), "labelled")
    stats = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    n_bad, n = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not n_bad or n_bad == n:
        return {"weights": {}, "base": -30.0 if not n_bad else 30.0} if n else {"weights": {}, "base": -math.inf}
    lift = (F.col("bad") + 0.5) / n_bad / ((F.col("good") + 0.5) / (n - n_bad))
    top = stats.filter((F.col("bad") >= LEAST_DOCS) & (lift > LIFT)).orderBy(F.desc(F.col("bad") * F.log(lift)), "f").limit(FEATURES).select("f")
    names = sorted(r[0] for r in top.collect())
    index = {f: i for i, f in enumerate(names)}
    wanted = spark.sparkContext.broadcast(frozenset(names))

    def pick(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("toxic"),
                pa.array([[f for f in fs if f in wanted.value] for fs in b.column("features").to_pylist()], pa.list_(pa.string()))],
                names=["toxic", "features"])

    # sorted, as sums of floats depend on their order
    data = sorted((r[0], sorted(index[f] for f in r[1])) for r in rows.mapInArrow(pick, "toxic int, features array<string>").toLocalIterator())
    w, _ = fit(data, len(names))
    chosen = np.flatnonzero(w > 0.05)
    place = {int(c): i for i, c in enumerate(chosen)}
    w, base = fit([(y, [place[c] for c in cs if c in place]) for y, cs in data], len(chosen), REFIT, 1500)  # the penalty has chosen; now it only shrinks
    return {"weights": {names[c]: float(x) for c, x in zip(chosen, w) if x > 0}, "base": float(base)}


def _score(shared):
    def run(batches):
        letter, model = shared.value
        weights, base = model["weights"], model["base"]
        find = Features(Decoder(letter), frozenset(weights))
        for whole in batches:
            for b in row_slices(whole, "text"):
                out = []
                for t in b.column("text").to_pylist():
                    z = base + math.fsum(weights[f] for f in find(t or ""))
                    out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    letter = letter_model(docs)
    model = train(docs, labels, letter)
    shared = docs.sparkSession.sparkContext.broadcast((letter, model))
    out = docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")
    return out.select("doc_id", (~not_held_out()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
