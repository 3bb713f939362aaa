"""Operator 9: a quality classifier of random Fourier features, ridge regression and isotonic calibration.

Each text gives a few dozen statistics. Random Fourier features of the scaled
statistics approximate a Gaussian kernel; ridge regression on them is fitted
from normal equations that are summed within partitions and then over them.
An isotonic curve, fitted on labelled rows that the regression has not seen,
turns its value into the share of good documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactica.llm.common import slices, with_columns, written

#: Labelled rows that the model is fitted on, at most about: two thirds for the regression, the rest for the curve.
SAMPLE_ROWS = 24_000
FEATURES = 512
WIDTH = 4.0  # of the kernel, in standard deviations of a statistic, times the root of their number
RIDGE = 1e-3
BINS = 2000

_UPPER, _LOWER, _DIGIT = (np.array([chr(b) in s for b in range(256)]) for s in (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
_HIGH = np.arange(256) >= 128
_OTHER = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_SIGNS = b".,!?;:|#$%&*@/<>{}[]()=+-_\"'~^\\`"


def statistics(text: str | None) -> list[float]:
    """Numbers about a whole text; those of an empty or null text are all 0."""
    if not text:
        return [0.0] * N_STATISTICS
    data = text.encode("utf-8", "replace")
    n = len(data)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    top = counts.most_common(2)
    lines = text.split("\n")
    repeated = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    share = bytes_ / n
    p = share[share > 0]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    full = [x for x in lines if x.strip()]
    return [
        math.log1p(n), math.log1p(m), math.log1p(len(full)),
        *(float(share[k].sum()) for k in (_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _OTHER)),
        *(math.sqrt(share[b]) for b in _SIGNS),
        float(-(p * np.log(p)).sum()),
        float(lengths.mean()), float(lengths.std()), math.log1p(int(lengths.max())),
        len(counts) / m, math.log1p(len(counts)) / math.log1p(m),
        top[0][1] / m if top else 0.0, top[1][1] / m if len(top) > 1 else 0.0,
        repeated / m, pairs / m,
        len(set(full)) / max(1, len(full)), m / max(1, len(full)),
        float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        len(zlib.compress(data, 1)) / n,
    ]


N_STATISTICS = 9 + len(_SIGNS) + 15


class Model:
    """Scaling, random features, weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 3):
        self.mean, self.scale = mean, scale
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.turn = rng.standard_normal((d, FEATURES)) / (WIDTH * math.sqrt(d) / 2)
        self.phase = rng.uniform(0, 2 * math.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.curve = np.zeros(1), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.turn + self.phase) * math.sqrt(2 / FEATURES), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.curve), 0, 1)


def isotonic(value: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve nearest to shares ``good / weight`` at ascending ``value``: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for v, g, w in zip(value, good, weight):
        blocks.append([v * w, g, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a, b = blocks[-2], blocks.pop()
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2] + b[2]]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """A model from the documents (doc_id, text) that ``labels`` (doc_id and ``label`` 0 or 1) marks.

    Rows with null id or label teach nothing; of several labels of one id the
    largest counts. At most about SAMPLE_ROWS ids are taken, by a hash; they
    are sent to the documents by broadcast, so no text is shuffled. None if no
    labelled document is found.
    """
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
              .agg(F.max(label).cast("double").alias("__label")))
    n = marked.count()
    spot = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000))
    picked = marked.where(spot < min(1_000_000, math.ceil(1e6 * SAMPLE_ROWS / max(1, n)))).limit(2 * SAMPLE_ROWS)
    taught = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    part = (F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(3)) == 0).cast("int")

    def measure(batches):
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["y", "held", "x"])

    table = written(taught.select(F.col("__label").alias("y"), part.alias("held"), "text")
                    .mapInArrow(measure, "y double, held int, x array<double>"), "quality")
    fitted = table.where("held = 0")

    def matrix(batch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)

    def moments(batches):
        total = np.zeros((3, N_STATISTICS))
        for batch in batches:
            if batch.num_rows:
                _, x = matrix(batch)
                total += np.array([np.full(N_STATISTICS, len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    sums = sum(np.frombuffer(bytes(r["sums"])).reshape(3, -1) for r in
               fitted.select("y", "x").mapInArrow(moments, "sums binary").collect()) if n else 0
    if not n or not sums[0][0]:
        return None
    mean = sums[1] / sums[0]
    scale = np.sqrt(np.maximum(sums[2] / sums[0] - mean ** 2, 1e-12)) + 1e-3
    model = Model(mean, scale)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def equations(batches):
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                y, x = matrix(batch)
                z = shared.value.features(x)
                a += z.T @ z
                b += z.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(FEATURES + 1)), pa.array([np.append(r, s).tobytes() for r, s in zip(a, b)], pa.binary())], ["row", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in rows.column("sums").combine_chunks())
        return pa.table({"row": rows.column("row")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    # one row of the equations to a group: as many rows as there are partitions; the result has a fixed size
    system = (fitted.select("y", "x").mapInArrow(equations, "row long, sums binary").groupBy("row")
              .applyInArrow(added, "row long, sums binary").collect())
    full = np.array([np.frombuffer(bytes(r["sums"])) for r in sorted(system, key=lambda r: r["row"])])
    a, b = full[:, :-1], full[:, -1]
    model.weights = np.linalg.solve(a + RIDGE * sums[0][0] / FEATURES * np.eye(len(a)), b)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def values(batches):
        for batch in batches:
            if batch.num_rows:
                y, x = matrix(batch)
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(np.round(shared.value.raw(x) * BINS).astype(np.int64))], ["y", "bin"])

    bins = (table.where("held = 1").select("y", "x").mapInArrow(values, "y double, bin long").groupBy("bin")
            .agg(F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("bin").collect())
    if bins:
        model.at, model.curve = isotonic(*(np.array([r[c] for r in bins], float) for c in ("bin", "good", "n")))
        model.at = model.at / BINS
    return model


def classify(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3, prefix: str = "") -> DataFrame:
    """Add score (0 to 1, higher: good likelier) and predicted (1 if score >= ``threshold``, else 0).

    Null and empty texts are scored as texts whose statistics are all 0. Without
    a model every score is 0.5. Equal texts get equal scores. With ``prefix`` the
    new names begin with it; columns of the same names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = [prefix + n for n in ("score", "predicted")]
    fields = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in fields] + new

    def run(batches):
        for batch, texts in slices(batches, text_col):
            m = shared.value
            x = np.array([statistics(t) for t in texts]) if m else None
            score = m.score(x) if m else np.full(len(texts), 0.5)
            yield with_columns(batch, names, {new[0]: pa.array(score), new[1]: pa.array((score >= threshold).astype(np.int32))})

    return df.mapInArrow(run, T.StructType(fields + [T.StructField(new[0], T.DoubleType(), False), T.StructField(new[1], T.IntegerType(), False)]))


def training_rows(labels: DataFrame) -> DataFrame:
    """The labels that may teach: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
