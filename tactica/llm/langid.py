"""Operator 2: language identification by nearest centroid.

A text is the vector of its hashed character 1- to 3-grams (letters lower-cased,
everything else a word end), weighted ``log(1 + count) * idf`` and scaled to
length one. Each language has several centroids, clustered by cosine from a
bounded sample of labelled documents. A text gets the language of the centroid
with the largest cosine, which is its score; it is rejected if it has no
letters or lies further from all centroids than documents of that language and
length do. How far those lie is measured on sample rows that taught nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tactica.llm.common import slices, with_columns, written

UNKNOWN = "und"
BITS = 12
DIMS = 1 << BITS
#: Labelled documents that the centroids are learned from, at most, for each language and in all.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 600, 12_000
CENTROIDS = 4
#: A centroid stands for so many rows at least.
LEAST = 12
#: Every language is learned; a model of more than this many would be too large to broadcast, and is refused.
MAX_LANGUAGES = 8192
#: Of the sample one row in so many teaches nothing; the floors of the cosines are measured on it.
MEASURED = 3
#: Numbers of letters that floors are measured for, on the first so many letters of a text (the last: on whole
#: longer texts); between them a floor goes with the logarithm of the letters.
LENGTHS = (1, 4, 16, 64, 256, 1024)
#: A text is rejected below MARGIN times the quantile LOW of the cosines measured for its language and length, and
#: never from SHARE of their median on (a small sample may hold none of the odd but clean texts).
LOW, MARGIN, SHARE = 0.02, 0.85, 0.38
#: Measured rows from which a language has a median, and a quantile, of its own.
OWN_MEDIAN, OWN_LOW = 20, 100

_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """The lower-cased letter of each code point up to 0xFFFF, 0 for all that is no letter."""
    global _fold
    if _fold is None:
        table = np.zeros(0x10000, np.uint32)
        for c in range(0x10000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def _letters(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    fold = _folding()
    if len(points) and points.max() >= 0x10000:
        out = fold[np.minimum(points, 0xFFFF)]
        for c in np.unique(points[points >= 0x10000]).tolist():
            out[points == c] = c if chr(c).isalpha() else 0
        return out
    return fold[points]


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (a row each) and numbers of letters. Long texts go in windows."""
    out = np.zeros((len(texts), DIMS), np.float32)
    letters = np.zeros(len(texts), np.int64)
    gap = np.zeros(2, np.uint32)
    codes, owner = [], []
    for i, text in enumerate(texts):
        if text:
            x = _letters(text)
            letters[i] = np.count_nonzero(x)
            codes += [gap, x]
            owner.append((i, len(x) + 2))
    if not owner:
        return out, letters
    codes = np.concatenate([*codes, gap])
    rows = np.repeat([i for i, _ in owner], [n for _, n in owner]).astype(np.int64) * DIMS
    flat = out.reshape(-1)
    window = 1 << 18
    for at in range(0, len(rows), window):
        r = rows[at:at + window]
        a, b, c = (codes[at + j:at + j + len(r)] for j in range(3))
        lo, hi = int(r[0]), int(r[-1]) + DIMS
        two = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))
        for keep, key in ((a != 0, a * np.uint32(0xC2B2AE3D)),
                          ((a != 0) | (b != 0), two * np.uint32(0x27D4EB2F)),
                          (b != 0, (two ^ (c * np.uint32(0x165667B1))) * np.uint32(0xD6E8FEB9))):
            slot = r[keep] - lo + (key[keep] >> np.uint32(32 - BITS))
            flat[lo:hi] += np.bincount(slot, minlength=hi - lo)[:hi - lo].astype(np.float32)
    return out, letters


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to ``k`` centroids of unit vectors by cosine, each of LEAST rows or more (one, if there are fewer rows).

    Starts are drawn by k-means++. A centroid of fewer rows starts again at a
    row of the largest cluster; one that stays small is left out at the end.
    """
    rng = np.random.default_rng(1)
    k = max(1, min(k, len(x) // LEAST))
    chosen = [int(rng.integers(len(x)))]
    while len(chosen) < k:
        far = np.maximum(1 - (x @ x[chosen].T).max(1), 0).astype(float) + 1e-12
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sizes = np.bincount(own, minlength=k)
        largest = np.flatnonzero(own == sizes.argmax())
        c = unit(np.array([x[own == j].sum(0) if sizes[j] >= LEAST else x[rng.choice(largest)] for j in range(len(c))]))
    while True:
        own = (x @ c.T).argmax(1)
        sizes = np.bincount(own, minlength=len(c))
        if len(c) == 1 or sizes.min() >= LEAST:
            return unit(np.array([x[own == j].sum(0) for j in range(len(c))]))
        c = np.delete(c, sizes.argmin(), 0)


def starts(text: str) -> list[tuple[int, str]]:
    """(n, the text up to its n-th letter) for each of LENGTHS that the text has; for the last the whole text."""
    at = np.flatnonzero(_letters(text))
    return [(n, text if n == LENGTHS[-1] else text[:at[n - 1] + 1]) for n in LENGTHS if n <= len(at)]


def floors_of(languages: list[str], found: list[str], lengths: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The floor of each of ``languages`` for each of LENGTHS, from measured texts: language found, length, cosine.

    The low quantile is that of cosines over their language's median, of all
    languages together, so that no single row sets it; a language with many
    measured rows may have a lower one of its own.
    """
    found, floors = np.array(found), np.zeros((len(languages), len(LENGTHS)))
    for j, n in enumerate(LENGTHS):
        here = lengths == n
        if not here.any():
            # no text is as long
            floors[:, j] = floors[:, j - 1]
            continue
        names, index, sizes = np.unique(found[here], return_inverse=True, return_counts=True)
        x, all_ = cosines[here], float(np.median(cosines[here]))
        own = {l: x[index == i] for i, l in enumerate(names.tolist()) if sizes[i] >= OWN_MEDIAN}
        median = {l: float(np.median(v)) for l, v in own.items()}
        low = float(np.quantile(x / np.maximum([median.get(l, all_) for l in names[index].tolist()], 1e-9), LOW))
        for i, l in enumerate(languages):
            floors[i, j] = median.get(l, all_) * min(MARGIN * low, SHARE)
            if len(own.get(l, ())) >= OWN_LOW:
                floors[i, j] = min(floors[i, j], MARGIN * float(np.quantile(own[l], LOW)))
    return floors


class Model:
    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, floors: np.ndarray | None = None):
        self.idf, self.languages, self.centroids = idf, languages, centroids
        self.floors = np.zeros((len(languages), len(LENGTHS))) if floors is None else floors

    def nearest(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row of log counts, and its cosine."""
        cosine = unit(weights * self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        return best, np.clip(cosine[np.arange(len(weights)), best].astype(float), 0, 1)

    def floor(self, best: np.ndarray, letters: np.ndarray) -> np.ndarray:
        at = np.interp(np.log(np.maximum(letters, 1)), np.log(LENGTHS), np.arange(len(LENGTHS)))
        below = at.astype(int)
        above = np.minimum(below + 1, len(LENGTHS) - 1)
        return self.floors[best, below] + (at - below) * (self.floors[best, above] - self.floors[best, below])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        raw, letters = counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best, score = self.nearest(np.log1p(raw))
        known = letters > 0
        score[~known] = 0
        rejected = ~known | (score < self.floor(best, letters))
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], score, rejected


def fold_of(doc_id, folds: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def learn(labelled: DataFrame, seed: int = 1) -> Model:
    """A model from rows of (doc_id, text, lang): those with a null lang or no text teach nothing.

    Every language is learned; more than MAX_LANGUAGES fail. Of each a sample
    of about SAMPLE_PER_LANGUAGE rows is taken, by a hash of id and text (fewer
    if there are very many languages). Inverse
    document frequencies and centroids come from two thirds of it, the floors
    of the cosines from the rest; of a language with fewer than 3 * MEASURED
    rows each row serves both. No rows give a model that rejects every text.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = written(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if (n := sizes.count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; a model of at most {MAX_LANGUAGES} is broadcast")
    few = F.least(F.lit(SAMPLE_PER_LANGUAGE), F.greatest(F.lit(8), F.lit(SAMPLE_ROWS) / F.count("*").over(Window.partitionBy())))
    rates = sizes.select("lang", few.cast("int").alias("cap"), (F.lit(1.25e9) * few / F.col("n")).alias("rate"))
    mark = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000_000))
    # rows are thinned where they are read; the window sees little more than the sample
    picked = (labelled.select("doc_id", "lang", "text").join(F.broadcast(rates), "lang").where(mark <= F.col("rate"))
              .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(mark, F.xxhash64("text"))))
              .where(F.col("place") <= F.col("cap")))
    rest, few_rows = F.col("place") % MEASURED == 0, F.count("*").over(Window.partitionBy("lang")) < 3 * MEASURED
    picked = picked.select("lang", "text", (~rest | few_rows).alias("teaches"), (rest | few_rows).alias("measured"))

    def features(batches):
        for batch, texts in slices(batches, "text", 1 << 20):
            lang, _, teaches, measured = (c.to_pylist() for c in batch.columns)
            # a teaching text has length 0
            rows = [(l, 0, t) for l, t, yes in zip(lang, texts, teaches) if yes]
            rows += [(l, n, t) for l, text, yes in zip(lang, texts, measured) if yes for n, t in starts(text)]
            for at in range(0, len(rows), 256):
                raw, letters = counts([t for _, _, t in rows[at:at + 256]])
                kept = [(l, n, x.astype("<f4").tobytes()) for (l, n, _), x, k in zip(rows[at:at + 256], np.log1p(raw), letters) if k]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], k) for i, k in enumerate(
                    (pa.string(), pa.int32(), pa.binary()))], ["lang", "length", "vector"])

    rows = written(picked.mapInArrow(features, "lang string, length int, vector binary"), "langid")
    sample = rows.where("length = 0").select("lang", "vector")

    def seen(batches):
        n, df = 0, np.zeros(DIMS)
        for batch in batches:
            for x in batch.column(0):
                df += np.frombuffer(x.as_buffer(), "<f4") > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()])], ["n", "df"])

    # a partial sum for each partition of the bounded sample
    sums = sample.select("vector").mapInArrow(seen, "n long, df binary").collect()
    n = sum(r["n"] for r in sums)
    if not n:
        return Model(np.ones(DIMS, np.float32), [], np.zeros((0, DIMS), np.float32))
    df = sum(np.frombuffer(bytes(r["df"])) for r in sums)
    idf = np.array([math.log((1 + n) / (1 + x)) + 1 for x in df], np.float32)

    def centroids(rows: pa.Table) -> pa.Table:
        x = np.array([np.frombuffer(v.as_buffer(), "<f4") for v in rows.column("vector").combine_chunks()])
        x = unit(x[np.lexsort(x[:, :8].T)] * idf)
        c = cluster(x, CENTROIDS)
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * len(c)),
                         "centroid": pa.array([v.astype("<f4").tobytes() for v in c], pa.binary())})

    made = sample.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary").collect()
    made = sorted(made, key=lambda r: (r["lang"], bytes(r["centroid"])))
    model = Model(idf, [r["lang"] for r in made], np.array([np.frombuffer(bytes(r["centroid"]), "<f4") for r in made]))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def distances(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                best, score = shared.value.nearest(np.array([np.frombuffer(v.as_buffer(), "<f4") for v in part.column(1)]))
                yield pa.RecordBatch.from_arrays([pa.array([shared.value.languages[b] for b in best]), part.column(0), pa.array(score)],
                                                 ["lang", "length", "score"])

    # a few numbers for each measured row of the bounded sample
    seen = rows.where("length > 0").select("length", "vector").mapInArrow(distances, "lang string, length int, score double").collect()
    model.floors = floors_of(model.languages, [r["lang"] for r in seen], np.array([r["length"] for r in seen]),
                             np.array([r["score"] for r in seen]))
    return model


def classify(df: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add lang_pred, score (the largest cosine, 0 to 1) and rejected to every row, over whole texts.

    A null text or one without letters is ``und`` with score 0, and rejected.
    Equal texts get equal results. With ``prefix`` the new names begin with it;
    columns of the same names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = [prefix + n for n in ("lang_pred", "score", "rejected")]
    fields = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in fields] + new
    kinds = [T.StructField(n, t, False) for n, t in zip(new, (T.StringType(), T.DoubleType(), T.BooleanType()))]

    def run(batches):
        for large, _ in slices(batches, text_col):
            for at in range(0, large.num_rows, 128):
                batch = large.slice(at, 128)
                lang, score, rejected = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
                yield with_columns(batch, names, dict(zip(new, (pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)))))

    return df.mapInArrow(run, T.StructType(fields + kinds))


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may teach: crc32 of the id as text, modulo 4, is not 2 (rows without id teach nothing)."""
    return docs.where(fold_of("doc_id", 4) != 2)
