"""Ordinal quality model: one weight vector over hashed words, ordered thresholds between the grades.

P(grade <= k) = sigmoid(threshold_k - w . x), where x marks which hashed words a text holds. Words are taken twice: as
written between spaces and without punctuation. Prediction covers every row.

The model is fitted on a bounded sample: about ``TRAIN_DOCS`` rated documents by least hash of doc_id (all if there are
fewer), and of these so many that their features take ``TRAIN_BYTES`` at most. Words in fewer than one of ``RARE`` sampled
documents (and in fewer than two) have no weight.

Defined results: null and empty texts score as a text without words; very long texts are scored whole; repeated rows get
equal results; documents rated more than once count with their least grade, ratings without a document or grade teach
nothing; without ratings, or with one grade only, nothing is known: null grade and probability, all kept; ties in the order
of training rows do not matter; an empty table gives no row; other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import discard, folder, stored

TRAIN_DOCS, TRAIN_BYTES, RARE = 12_000, 64 << 20, 600
BITS, STEPS, L2 = 18, 200, 3e-5
CUT = 0.5
MILLION = 1_000_000


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row, feature) without repeats, in order of rows."""
    for first, last, data, offsets in words.slices(texts):
        both = []
        for gaps, salt in ((words.SPACES, 0), (words.PUNCTUATED, 1)):
            start, end, text = words.split(data, offsets, gaps)
            value = words.mix(words.hashes(data, start, end) + np.uint64(salt)) >> np.uint64(64 - BITS)
            both.append((text.astype(np.uint64) << np.uint64(BITS)) | value)
        both = np.unique(np.concatenate(both))
        yield first, last, (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, row, feature in features(batch.column(0)):
            cut = np.searchsorted(row, np.arange(last - first + 1))
            held = pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.record_batch([batch.column(1)[first:last], batch.column(2)[first:last], held], ["grade", "place", "features"])


class Model:
    """Fitted by Adam on all sampled rows at once."""

    def __init__(self, grades: np.ndarray, held: list[np.ndarray]):
        """held: the different features of each row, as 32-bit numbers."""
        self.levels = np.unique(grades)
        y = np.searchsorted(self.levels, grades)
        count = np.bincount(np.concatenate(held), minlength=1 << BITS) if held else np.zeros(1 << BITS, np.int64)
        names = np.flatnonzero(count >= max(2, len(y) / RARE))
        place = np.full(1 << BITS, -1, np.int32)
        place[names] = np.arange(len(names))
        column = [place[x][place[x] >= 0] for x in held]
        size = np.array([len(x) for x in column], np.int64)
        column = np.concatenate(column) if held else np.zeros(0, np.int32)
        some, heads = np.flatnonzero(size), (np.cumsum(size) - size)[size > 0]
        by_name = np.repeat(np.arange(len(size), dtype=np.int32), size)[np.argsort(column, kind="stable")]
        name_heads = np.cumsum(count[names]) - count[names]
        k = len(self.levels)
        share = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
        cuts = np.log(share / (1 - share)) if k > 1 else np.zeros(0)
        x = np.concatenate([cuts[:1], np.log(np.maximum(1e-3, np.diff(cuts))), np.zeros(len(names))])
        first = second = 0.0
        for step in range(1, STEPS + 1 if k > 1 else 1):
            cuts, w = np.cumsum(np.append(x[:1], np.exp(x[1 : k - 1]))), x[k - 1 :]
            z = np.zeros(len(y))
            if len(some):
                z[some] = np.add.reduceat(w.astype(np.float32)[column], heads)
            edge = np.concatenate([[-np.inf], cuts, [np.inf]])
            hi, lo = (1 / (1 + np.exp(-np.clip(edge[y + j] - z, -30, 30))) for j in (1, 0))
            p = np.maximum(hi - lo, 1e-12)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            dz = (dhi - dlo) / len(y)  # of the mean negative log-likelihood
            dcuts = (np.bincount(y, -dhi, k)[:-1] + np.bincount(y, dlo, k)[1:]) / len(y)
            tail = np.cumsum(dcuts[::-1])[::-1]
            dw = np.add.reduceat(dz.astype(np.float32)[by_name], name_heads) if len(names) else np.zeros(0)
            gradient = np.concatenate([tail[:1], tail[1:] * np.exp(x[1 : k - 1]), dw + L2 * w])
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            x = x - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.cuts = np.cumsum(np.append(x[:1], np.exp(x[1 : k - 1]))) if k > 1 else np.zeros(0)
        self.weights = np.zeros(1 << BITS, np.float32)
        self.weights[names] = x[k - 1 :] if k > 1 else 0

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of the highest grade."""
        grade, tail = np.zeros(len(texts)), np.zeros(len(texts))
        for first, last, row, feature in features(texts):
            z = np.bincount(row, self.weights[feature], last - first)
            above = 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -30, 30)))
            grade[first:last] = self.levels[0] + above @ np.diff(self.levels)
            tail[first:last] = above[:, -1]
        return grade, tail


def fit(docs: DataFrame, ratings: DataFrame) -> Model | None:
    """docs: doc_id, text; ratings: doc_id, grade. The features of the sample are measured before the driver gets them."""
    spark = docs.sparkSession
    ratings = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    n = ratings.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MILLION))
    if n > TRAIN_DOCS:
        ratings, docs = (df.where(place < TRAIN_DOCS * MILLION // n) for df in (ratings, docs))
    work = folder(spark, "rated")
    rows = docs.join(ratings, "doc_id").select("text", "grade", place.alias("place")).mapInArrow(_featured, "grade int, place long, features binary")
    rows = stored(rows, "features", work)
    size = rows.agg(F.sum(F.octet_length("features"))).first()[0] or 0
    if size > TRAIN_BYTES:
        limit = rows.agg(F.max("place")).first()[0]
        rows = rows.where(F.col("place") <= limit * TRAIN_BYTES // size)
    held = rows.select("grade", "features").toArrow()
    discard(spark, work)
    grades, features = held.column(0).to_numpy().astype(np.int64), held.column(1).to_pylist()
    if len(np.unique(grades)) < 2:
        return None
    order = sorted(range(len(features)), key=lambda i: (grades[i], features[i]))
    return Model(grades[order], [np.frombuffer(features[i], np.int32) for i in order])


def grade(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, expected_grade, p_top, kept): kept where the highest grade has a probability of at least ``CUT``."""
    docs = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, ratings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model.value is None:
                columns = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(np.ones(n, bool))]
            else:
                expected, tail = model.value.predict(batch.column(1))
                columns = [pa.array(np.round(expected, 6)), pa.array(np.round(tail, 6)), pa.array(tail >= CUT)]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "expected_grade", "p_top", "kept"])

    return docs.mapInArrow(run, "doc_id long, expected_grade double, p_top double, kept boolean")
