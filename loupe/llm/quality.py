"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised and mapped to cosines of random projections, which
approximates a Gaussian kernel; every partition sums its part of the normal equations,
the ridge weights follow from one small solve, and pool-adjacent-violators on held-out
labels turns the scores into probabilities.

The model is fitted on at most `fit_rows` labelled documents (a hash sample of the
labels); scoring covers every document and shuffles nothing.

Defined results: a null text counts as the empty text; null labels are left out; of
several labels of one document the lowest counts; repeated rows are scored alike, and those labelled
count in the fit as often as they occur; null doc_ids are scored; very long texts are read whole; equal scores
are one point of the calibration, and a score at the threshold stays;
with no labels, or labels of one class only, every document has score 1.0 and stays; an
empty table gives an empty result; only doc_id and text are read, so further columns are
of no concern, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnp as X
from .exchange import written

FIT_ROWS = 20_000
FEATURES = 256
BANDWIDTH = 4.0
RIDGE = 1e-2
THRESHOLD = 0.5
SEED = 20_240_229

STATISTICS = (
    "bytes", "tokens", "token_bytes", "token_spread", "distinct", "top_token", "upper", "digits", "symbols", "stops",
    "lines", "non_ascii", "spaces", "distinct_lines",
)

#: Class of each byte: 0 other, 1 upper case, 2 digit, 3 symbol, 4 stop, 5 blank, 6 non-ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = 3
_CLASS[X._IS_WORD] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:"]] = 4
_CLASS[[9, 32]] = 5
_CLASS[128:] = 6


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for a, b in X.slices(texts):
        out[a:b] = _statistics(texts.slice(a, b - a))
    return out


def _statistics(texts: pa.Array) -> np.ndarray:
    t = X.Tokens(texts)
    raw, off = X.buffers(texts)
    n = t.rows
    size = np.maximum(np.diff(off), 1).astype(float)
    owner = np.repeat(np.arange(n, dtype=np.int32) * 8, np.diff(off))
    kinds = np.bincount(owner + _CLASS[raw], minlength=8 * n).reshape(n, 8)
    count = np.diff(t.offsets)
    tokens = np.maximum(count, 1).astype(float)
    length = (t.end - t.start).astype(float)
    s1 = np.concatenate([[0], np.cumsum(length)])
    s2 = np.concatenate([[0], np.cumsum(length * length)])
    mean = (s1[t.offsets[1:]] - s1[t.offsets[:-1]]) / tokens
    spread = np.sqrt(np.maximum((s2[t.offsets[1:]] - s2[t.offsets[:-1]]) / tokens - mean**2, 0))
    distinct, top = _distinct(t.hash, t.row_of_token(), n)
    lines = raw == 10
    start = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], np.flatnonzero(lines) + 1]))
    start = start[start < len(raw)]
    if len(start):
        end = np.append(start[1:], len(raw))
        row = np.searchsorted(off, start, side="right") - 1
        own, _ = _distinct(X.span_hash(raw, start, end - (raw[end - 1] == 10)), row, n)
        per = np.bincount(row, minlength=n)
    else:
        own = per = np.zeros(n)
    return np.column_stack(
        [
            np.log1p(np.diff(off)),
            np.log1p(count),
            mean,
            spread,
            distinct / tokens,
            top / tokens,
            *(kinds[:, 1:5] / size[:, None]).T,
            np.log1p(per / tokens * 100),
            *(kinds[:, [6, 5]] / size[:, None]).T,
            own / np.maximum(per, 1),
        ]
    )


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: number of distinct hashes, count of the most frequent one."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = np.sort((row.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits))
    first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    many = np.diff(np.append(first, len(key)))
    owner = (key[first] >> (np.uint64(64) - bits)).astype(np.int64)
    top = np.zeros(n)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    top[owner[begin]] = np.maximum.reduceat(many, begin)
    return np.bincount(owner, minlength=n).astype(float), top


class Model:
    """Standardisation, projection, ridge weights and calibration steps."""

    def __init__(self, mean, scale, features: int, bandwidth: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean, float), np.asarray(scale, float)
        self.projection = rng.normal(0, 1 / bandwidth, (len(self.mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps = np.array([0.0]), np.array([1.0])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([f, np.ones(len(f))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        at, value = self.steps
        return value[np.clip(np.searchsorted(at, raw, side="right") - 1, 0, len(value) - 1)]


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (left ends, values) of a nondecreasing step function; equal scores are one point."""
    at, inverse, weight = np.unique(score, return_inverse=True, return_counts=True)
    mean = np.bincount(inverse, weights=label) / weight
    blocks: list[list[float]] = []
    for x, m, w in zip(at, mean, weight):
        blocks.append([x, m, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            _, m1, w1 = blocks.pop()
            x0, m0, w0 = blocks[-1]
            blocks[-1] = [x0, (m0 * w0 + m1 * w1) / (w0 + w1), w0 + w1]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of each labelled document."""
    return (
        labels.select(F.col("doc_id"), F.col(column).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )


def sampled_labels(labels: DataFrame, column: str, fit_rows: int) -> DataFrame:
    """At most about fit_rows labelled documents, chosen by a hash of doc_id."""
    known = known_labels(labels, column)
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
    return known


def fit(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES,
    bandwidth: float = BANDWIDTH, ridge: float = RIDGE, seed: int = SEED,
) -> Model | None:
    """The model, or None if the labels don't have both classes."""
    # The sample has at most fit_rows ids, so its size doesn't follow the corpus.
    sample = F.broadcast(sampled_labels(labels, "quality", fit_rows))
    names = [f"s{i}" for i in range(len(STATISTICS))]
    stats = F.arrow_udf(_stats_column, "array<double>")
    table = written(
        docs.select("doc_id", "text")
        .join(sample, "doc_id")
        .select("label", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)).alias("fold"), stats("text").alias("s"))
        .select("label", "fold", *[F.col("s")[i].alias(n) for i, n in enumerate(names)])
        .repartition(8),
        "quality-sample",
    )
    row = table.agg(
        F.count_if(F.col("label") > 0).alias("good"), F.count_if(F.col("label") <= 0).alias("bad"),
        *[F.avg(n).alias(f"m{n}") for n in names], *[F.stddev_pop(n).alias(f"d{n}") for n in names],
    ).first()
    if not row["good"] or not row["bad"]:
        return None
    model = Model([row[f"m{n}"] for n in names], [row[f"d{n}"] or 1.0 for n in names], features, bandwidth, seed)

    def sums(batches):
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            a = np.column_stack([np.asarray(c, dtype=float) for c in b.columns])
            f = model.features(a[:, 1:])
            total += f.T @ np.column_stack([f, a[:, 0] > 0])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # One matrix of fixed size for each of at most 8 partitions.
    parts = table.where("fold > 0").select("label", *names).mapInArrow(sums, "sums binary").collect()
    total = sum(np.frombuffer(p["sums"]).reshape(features + 1, features + 2) for p in parts)
    penalty = ridge * max(total[-1, -2], 1) / features * np.eye(features + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    held = table.where("fold = 0").select("label", *names).toPandas().to_numpy(dtype=float)
    if len(held):
        model.steps = isotonic(model.raw(held[:, 1:]), (held[:, 0] > 0).astype(float))
    return model


def _stats_column(texts: pa.Array) -> pa.Array:
    s = statistics(X.as_array(texts))
    flat = pa.array(s.ravel(), pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), flat)


def scores(model: Model | None, text: Column) -> Column:
    """struct(raw, score) of each text."""
    if model is None:
        return F.struct(F.lit(1.0).alias("raw"), F.lit(1.0).alias("score"))

    def column(texts: pa.Array) -> pa.Array:
        raw = model.raw(statistics(X.as_array(texts)))
        return pa.StructArray.from_arrays([pa.array(raw), pa.array(model.calibrated(raw))], ["raw", "score"])

    return F.arrow_udf(column, "struct<raw: double, score: double>")(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, raw, score, keep) for every row of docs."""
    model = fit(docs, labels, **options)
    scored = docs.select("doc_id", scores(model, F.col("text")).alias("q"))
    return scored.select("doc_id", "q.raw", "q.score", (F.col("q.score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs whose calibrated score reaches the threshold."""
    model = fit(docs, labels, **options)
    return docs.where(scores(model, F.col("text"))["score"] >= threshold)
