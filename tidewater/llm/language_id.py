"""Language identification by rank-order profiles (out-of-place distance).

A text's letters are lower-cased, every run of other characters is one gap, and its 1- to ORDER-grams are counted over the whole
text. A language's profile is its PROFILE most frequent n-grams over all training documents; a document's is its own PROFILE most
frequent ones. The distance sums, over the document's n-grams, how far each is out of its place in the language's profile, PROFILE
for those that aren't in it. The nearest language is predicted; ties go to the first in alphabetical order.

Counts are summed within Arrow batches, then by Spark per (language, n-gram); a language's top n-grams are picked by a ranked
window with its group limit below the shuffle. What reaches the driver and the executors is PROFILE rows for each language.

Defined cases: a null text, or one without a letter, is `und` with score 0; without training rows all are `und`; equal rows get
equal results; empty input gives no rows; other columns are not returned.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import crc32_sql, row_slices, sheltered, small_batches

ORDER, PROFILE, HELD_OUT = 3, 400, 2
#: Languages that a model may have: bounds what is sent to the executors, PROFILE * MOST_LANGUAGES rows.
MOST_LANGUAGES = 2_000
MOST_HELD, PIECE = 500_000, 1 << 20
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str) -> np.ndarray:
    """All n-grams as 64-bit keys of up to three code points; empty if there is no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = letters()[c]
    c = np.where(ok, c, 0).astype(np.uint64)
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # the first of a run of others is a gap; a leading run goes
    c = c[keep]
    if not c.any():
        return c[:0]
    c = np.concatenate((c[:0] if c[0] == 0 else np.zeros(1, np.uint64), c, np.zeros(1, np.uint64) if c[-1] else c[:0]))
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    single = c[c > 0]
    mark = np.uint64(1 << 63)
    three = three[(three >> np.uint64(21)) & np.uint64((1 << 21) - 1) > 0] | mark  # never across a gap
    return np.concatenate((single, two | np.uint64(1 << 62), three))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def top(keys: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent, most frequent first; ties by key."""
    return most_frequent(*counted(keys), n)


def most_frequent(k: np.ndarray, c: np.ndarray, n: int = PROFILE) -> np.ndarray:
    if len(k) > 4 * n:  # all that can be among the first n
        some = c >= np.partition(c, len(c) - n)[len(c) - n]
        k, c = k[some], c[some]
    return k[np.argsort(-c, kind="stable")[:n]]


def pieces(text: str):
    """A text in parts of about PIECE characters that end at a blank or a line's end, where no n-gram of letters goes on."""
    pos = 0
    while pos < len(text):
        stop = pos + PIECE
        if stop < len(text):
            cut = max(text.rfind(" ", pos + 1, stop), text.rfind("\n", pos + 1, stop))
            if cut < 0:
                after = [x for x in (text.find(" ", stop), text.find("\n", stop)) if x >= 0]
                cut = min(after) if after else len(text)
            stop = cut
        yield text[pos:stop]
        pos = stop


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and their counts, by parts: a very long text's n-grams are never held all at once."""
    out = None
    for part in pieces(text):
        c = counted(grams(part))
        out = c if out is None else _merged(out, c)
    return counted(grams("")) if out is None else out


def _merged(a: tuple, b: tuple) -> tuple:
    """Sums of two sorted count tables."""
    keys, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate((a[1], b[1])), minlength=len(keys)).astype(np.int64)


def _added(by: dict, lang, parts: list[np.ndarray]) -> tuple:
    c = counted(np.concatenate(parts))
    return _merged(by[lang], c) if lang in by else c


def _rows(by: dict):
    for lang, (k, n) in by.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def _count(batches):
    """Counts by language, summed within the partition; they leave early when there are MOST_HELD of them."""
    by: dict[str, tuple] = {}
    for whole in batches:
        for b in row_slices(whole, "text", 1 << 20):
            new: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                for part in pieces(text):
                    new.setdefault(lang, []).append(grams(part))
                    if len(part) < len(text):  # of a long text, a part at a time
                        by[lang] = _added(by, lang, new.pop(lang))
            for lang, parts in new.items():
                by[lang] = _added(by, lang, parts)
            if sum(len(k) for k, _ in by.values()) > MOST_HELD:
                yield from _rows(by)
                by = {}
    yield from _rows(by)


def held_out(part: int = 4, of: int = HELD_OUT):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % part == of


def train(docs: DataFrame) -> dict:
    """Profiles of all languages in the rows given: lang -> its n-grams, most frequent first."""
    small_batches(docs.sparkSession)
    counts = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= PROFILE)
    out: dict[str, list] = {}
    for lang, gram, rank in ranked.select("lang", "gram", "rank").orderBy("lang", "rank").limit(PROFILE * MOST_LANGUAGES + 1).toLocalIterator():
        out.setdefault(lang, []).append(gram)
    if len(out) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


class Model:
    def __init__(self, profiles: dict):
        self.names = sorted(profiles)
        self.keys = np.unique(np.concatenate([profiles[x] for x in self.names])) if self.names else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.names), len(self.keys)), -1, np.int32)
        for i, x in enumerate(self.names):
            self.rank[i, np.searchsorted(self.keys, profiles[x])] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = most_frequent(*counts_of(text)) if text else self.keys[:0]
        if not len(own) or not len(self.keys):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        known = self.keys[at] == own
        rank = np.where(known, self.rank[:, at], -1)
        far = np.where(rank >= 0, np.abs(rank - np.arange(len(own), dtype=np.int32)), PROFILE).sum(axis=1)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (PROFILE * len(own)))


def _predict(shared):
    def run(batches):
        model = Model(shared.value)
        for whole in batches:
            for b in row_slices(whole, "text"):
                found = [model.predict(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([x for x, _ in found], pa.string()),
                    pa.array([y for _, y in found], pa.float64())], names=["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, profiles: dict) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame) -> DataFrame:
    profiles = train(docs.filter(~held_out()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is found; those predicted `und` go. Rows are judged one by one, within the scan."""
    profiles = train(docs.filter(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows, own = sheltered(docs)
    text = own["text"]

    def keep(batches):
        model = Model(shared.value)
        for whole in batches:
            for b in row_slices(whole, text):
                yield b.filter(pa.array([model.predict(t)[0] != "und" for t in b.column(text).to_pylist()], pa.bool_()))

    return rows.mapInArrow(keep, rows.schema).toDF(*docs.columns)


#: Letters as \\p{L}, a gap as a space. Ties: grams of a document by length and letters, those of a language by the keys' signed order.
SQL = rf"""
WITH d AS (SELECT doc_id, lang, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 4 = {HELD_OUT} AS held_out, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) AS t FROM documents),
l AS (SELECT doc_id, lang, held_out, string_split(' ' || t || ' ', '') AS c FROM d WHERE t <> ''),
p AS (SELECT doc_id, lang, held_out, c, unnest(range(1, len(c) + 1)) AS j FROM l),
g AS (SELECT doc_id, lang, held_out, unnest([CASE WHEN c[j] <> ' ' THEN c[j] END, CASE WHEN j < len(c) THEN c[j] || c[j + 1] END, CASE WHEN j < len(c) - 1 AND c[j + 1] <> ' ' THEN c[j] || c[j + 1] || c[j + 2] END]) AS gram FROM p),
n AS (SELECT doc_id, lang, held_out, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY ALL),
o AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) AS r FROM n QUALIFY r <= {PROFILE}),
m AS (SELECT lang, gram, sum(n) AS n FROM n WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
q AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, CASE length(gram) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, gram) AS r FROM m QUALIFY r <= {PROFILE}),
x AS (SELECT doc_id, lang, sum(coalesce(abs(q.r - o.r), {PROFILE})) AS far, count(*) AS own FROM o CROSS JOIN (SELECT DISTINCT lang FROM q) LEFT JOIN q USING (lang, gram) GROUP BY ALL),
b AS (SELECT doc_id, arg_min(lang, (far, lang)) AS lang_pred, min(far) AS far, any_value(own) AS own FROM x GROUP BY doc_id)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(1 - CAST(far AS DOUBLE) / ({PROFILE} * own), 0) AS score FROM d LEFT JOIN b USING (doc_id)
"""
