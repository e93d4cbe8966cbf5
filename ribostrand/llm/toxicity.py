"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the presence of its hashed character n-grams (of the
lower-cased text, white space as spaces). Each feature is scaled by the naive
Bayes log-count ratio of the two classes, and a logistic regression is fitted on
the scaled features. Scoring reads whole texts; training reads a bounded sample
of the labelled rows: per class the ``most_per_class`` rows of the smallest hash
of the key. Class weights restore the shares of all labelled training rows, so
scores stay probabilities.

Not all n-grams are features: the ``most_features`` buckets of 2**BITS whose
log-count ratio is furthest from 0 in units of its standard error are (feature
selection, not a bound on data; with all of them the classifier is worse, since
most ratios are noise). 2048 had the best area under the curve of 1024, 2048,
4096 and 8192 on a fourth of the training rows held back for that choice.

Edge cases: null and empty texts get the score of the intercept; rows with a
null label, labels without a document and documents without a label teach
nothing and count nowhere; of several labels of a key the larger counts; of
equally strong features those with the smaller bucket are taken; with fewer
than two classes to learn from, every score is the smoothed share of toxic
training rows; repeated rows are scored each; a null key is never held out; very
long texts are read in overlapping windows; an empty table gives an empty
result; extra columns are ignored (and kept, whatever their names, with ``keep``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import flat_string, slices
from .common import fresh, texts, with_fields

ORDERS = (3, 4, 5, 6)
BITS = 20
MOST_PER_CLASS = 4000
MOST_FEATURES = 2048
PENALTY = 1.0
SLICE = 1 << 20
WINDOW = 1 << 20


def _chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(number of the text of each piece, pieces) of at most about WINDOW characters; pieces of a longer text overlap by less than an n-gram."""
    rows, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), WINDOW):
            piece = text[at : at + WINDOW + max(ORDERS) - 1]
            if pieces and size + len(piece) > WINDOW:
                yield np.array(rows), pieces
                rows, pieces, size = [], [], 0
            rows.append(i)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield np.array(rows), pieces


def _grams(pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: the bucket at every character, with the ends of the pieces; the bucket 0 stands for none."""
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
    data = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
    data = np.where(data <= 32, np.uint32(32), data)
    h = data
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) ^ data[n - 1 :]
        if n not in ORDERS:
            continue
        bucket = (h * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        bucket[bucket == 0] = 1
        over = (offsets[1:, None] - np.arange(1, n)[None, :]).ravel()
        bucket[over[(over >= 0) & (over < len(bucket))]] = 0
        yield bucket, offsets


def _lower(column: pa.Array) -> list[str]:
    return pc.utf8_lower(column).to_pylist()


def _present(lowered: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each wanted feature present; wanted: feature number + 1 by bucket, 0 if none."""
    found, features = [], int(wanted.max()) + 1 if len(wanted) else 1
    for rows, pieces in _chunks(lowered):
        for bucket, offsets in _grams(pieces):
            feature = wanted[bucket]
            at = np.flatnonzero(feature)
            row = rows[np.searchsorted(offsets, at, "right") - 1]
            found.append(np.unique(row * features + feature[at]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // features, pairs % features - 1


def _distinct(text: str) -> np.ndarray:
    """The buckets of one lower-cased text."""
    found = [np.unique(bucket) for _, pieces in _chunks([text]) for bucket, _ in _grams(pieces)]
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *found]))


@dataclass
class Model:
    """wanted: feature number + 1 by bucket; weight: of each feature, its log-count ratio included."""

    wanted: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        z = np.full(len(column), self.bias)
        if len(self.weight):
            row, feature = _present(_lower(column), self.wanted)
            z += np.bincount(row, self.weight[feature], len(column))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimise(f, x: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a halving line search; f gives value and gradient."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = slope.copy(), []
        for s, y, r in reversed(past):
            kept.append(a := r * (s @ d))
            d -= a * y
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            d += (a - r * (y @ d)) * s
        down, step = slope @ d, 1.0 if past else 1 / max(1.0, float(np.abs(slope).max()))
        while True:
            new, new_slope = f(x - step * d)
            if new <= value - 1e-4 * step * down or step < 1e-10:
                break
            step /= 2
        s, y = -step * d, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - new <= 1e-6 * max(1.0, abs(value))
        x, value, slope = x + s, new, new_slope
        if done:
            break
    return x


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_per_class: int = MOST_PER_CLASS, most_features: int = MOST_FEATURES) -> Model:
    """Fit on labels (all of them may teach). The sample holds at most 2 * most_per_class rows."""
    ids = documents.select(F.col(key).cast("long").alias("doc_id"))
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y")).where("y in (0, 1)").join(ids, "doc_id", "left_semi")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    negatives, positives = counts.get(0, 0), counts.get(1, 0)
    share = (positives + 0.1) / (positives + negatives + 1)
    nothing = Model(np.zeros(1 << BITS, np.int32), np.zeros(0), float(np.log(share / (1 - share))))
    if not negatives or not positives:
        return nothing
    halves = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class) for c in (0, 1)]
    sample = F.broadcast(halves[0].unionByName(halves[1]))  # at most 2 * most_per_class rows of two numbers
    train = texts(documents, key, text).join(sample, "doc_id").select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        seen = np.zeros(2, np.int64)
        for batch in batches:
            for one, y in zip(_lower(flat_string(batch.column(0))), batch.column(1).to_pylist(), strict=True):
                sums[y, _distinct(one)] += 1
                seen[y] += 1
        sums[:, 0] = seen
        at = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["bucket", "n0", "n1"])

    sums = train.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = sums.where("bucket = 0").collect()
    if not totals or not totals[0]["n0"] or not totals[0]["n1"]:
        return nothing
    t0, t1 = totals[0]["n0"], totals[0]["n1"]
    ratio = F.log((F.col("n1") + 0.5) / (t1 + 1.0)) - F.log((F.col("n0") + 0.5) / (t0 + 1.0))
    strength = F.abs(ratio) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = sums.where("bucket > 0 and n0 + n1 >= 3").select("bucket", ratio.alias("ratio"), strength.alias("strength")).orderBy(F.desc("strength"), "bucket").limit(most_features).toPandas()
    wanted, ratios = np.zeros(1 << BITS, np.int32), best["ratio"].to_numpy()
    wanted[best["bucket"].to_numpy()] = np.arange(1, len(best) + 1)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, y = flat_string(batch.column(0)), batch.column(1)
            for a, b in slices(column, SLICE):
                row, feature = _present(_lower(column.slice(a, b - a)), wanted)
                cuts = np.searchsorted(row, np.arange(1, b - a))
                yield pa.RecordBatch.from_arrays([y.slice(a, b - a), pa.array([x.astype("<u4").tobytes() for x in np.split(feature, cuts)], pa.binary())], ["y", "features"])

    rows = train.mapInArrow(present, "y int, features binary").collect()
    y = np.array([r["y"] for r in rows])
    cols = [np.frombuffer(r["features"], "<u4") for r in rows]
    row, col = np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols).astype(np.int64)
    weight = np.where(y == 1, positives / max(1, (y == 1).sum()), negatives / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        scaled = x[:-1] * ratios
        z = np.bincount(row, scaled[col], len(y)) + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        value = float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * PENALTY * (x[:-1] @ x[:-1]))
        error = weight * (p - y)
        slope = np.bincount(col, error[row], len(ratios)) * ratios + PENALTY * x[:-1]
        return value, np.append(slope, error.sum())

    x = minimise(loss, np.append(np.zeros(len(ratios)), nothing.bias))
    return Model(wanted, x[:-1] * ratios, float(x[-1]))


def held_out(key: str = "doc_id") -> Column:
    """The rows that no label is learned from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3, keep: str | None = None) -> DataFrame:
    """key, score and predicted (1 if score >= threshold) of each row; keep: all its columns and the score alone, under that name."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a table of 2**BITS numbers and at most most_features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            column = flat_string(batch.column(len(batch.columns) - 1))
            for a, b in slices(column, SLICE):
                s = own.scores(column.slice(a, b - a))
                if keep:
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s)], names=[*names, keep])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    if keep:
        names = documents.columns
        schema = with_fields(documents, f"`{keep}` double")
        return documents.withColumn(fresh(documents, "_text"), F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(run, schema)
    return texts(documents, key, text).mapInArrow(run, "doc_id long, score double, predicted int").withColumnRenamed("doc_id", key)


def toxicity(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """key, held_out, score, predicted; learns only from labels of rows that are not held out."""
    model = fit(documents, labels.where(~held_out(key)), key, text, label)
    return score(documents, model, key, text, threshold).select(key, held_out(key).alias("held_out"), "score", "predicted")
