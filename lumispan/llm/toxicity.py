"""Severity of toxic language by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta[k] - w.x): one weight vector for all thresholds, which stay in order. x has a 1 for each word of a
text and each prefix of 4 to 6 letters of a longer word, as far as they are among the features that speak for or against
toxicity. The result is the expected grade, the median one, and whether a grade above 0 is likelier than not.

A model learns from at most ``most_labels`` labelled documents (bounded, by a hash of their ids). Where a document has
several labels, the gravest holds. Null or empty text has no features; without labels every severity is 0. Grades that no
label has get no probability. Repeated rows get equal results.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import small_slices, with_columns, worker_cache

BUCKETS = 1 << 20
MOST_LABELS = 20_000
FEATURES = 4096
SUPPORT = 0.005  # a feature is in this share of the toxic documents, or of the others, at least
RIDGE = 1e-6
CERTAIN = 4.0  # standard deviations between its counts and those of an indifferent one
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Buckets of a lower-case word and of its prefixes."""
    names = ["=" + word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    place: np.ndarray  # (features,) sorted buckets
    weight: np.ndarray  # (features,)
    theta: np.ndarray  # (grades - 1,)

    def grade_odds(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades) probabilities."""
        below = 1 / (1 + np.exp(-np.clip(self.theta[None, :] - score[:, None], -500, 500)))
        edge = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(edge, axis=1)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, ridge: float = RIDGE, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative logit model by L-BFGS.

    ``rows`` and ``columns`` are the places of the ones of a sparse matrix of ``len(grades)`` rows.
    """
    n, top = len(grades), int(grades.max(initial=0))
    if not n or not top:
        return np.zeros(width), np.full(max(top, 1), 30.0)
    share = np.array([np.clip((grades <= k).mean(), 1e-6, 1 - 1e-6) for k in range(top)])
    theta = np.log(share / (1 - share))
    lo, hi = np.maximum(grades - 1, 0), np.minimum(grades, top - 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        # thresholds are the first one and the logarithms of the steps to the next ones, which keeps them in order
        w, step = z[:width], np.exp(np.clip(z[width + 1 :], -20, 20))
        theta = z[width] + np.concatenate([[0], np.cumsum(step)])
        score = np.bincount(rows, w[columns], n)
        a = np.where(grades > 0, sigmoid(theta[lo] - score), 0.0)
        b = np.where(grades < top, sigmoid(theta[hi] - score), 1.0)
        p = np.maximum(b - a, 1e-15)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        by_theta = (np.bincount(lo, da * (grades > 0), top) - np.bincount(hi, db * (grades < top), top)) / n
        tail = np.cumsum(by_theta[::-1])[::-1]
        by_weight = np.bincount(columns, ((db - da) / n)[rows], width) + ridge * w
        return float(-np.log(p).mean() + ridge / 2 * (w @ w)), np.concatenate([by_weight, [tail[0]], tail[1:] * step])

    z = np.concatenate([np.zeros(width), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
    value, g = loss(z)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), alpha in zip(past, reversed(alphas), strict=True):
            d = d + (alpha - r * (y @ d)) * s
        slope, size = g @ d, 1.0
        if slope >= -1e-12:
            break
        while size > 1e-8:
            new, after = loss(z + size * d)
            if new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * d, after - g
        if s @ y > 1e-14:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
        z, g, value = z + s, after, new
    return z[:width], z[width] + np.concatenate([[0], np.cumsum(np.exp(np.clip(z[width + 1 :], -20, 20)))])


def fit(docs: DataFrame, labels: DataFrame, grade: Column, most_labels: int = MOST_LABELS, most_features: int = FEATURES) -> Model:
    """Learn from ``docs`` (doc_id, text) and the ``grade`` (0 and up) of each row of ``labels`` (doc_id, ...)."""
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL AND grade >= 0")
    one = graded.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = text.join(F.broadcast(one), "doc_id").select("text", "grade")  # ``one`` has at most ``most_labels`` rows

    def count(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for t, g in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist(), strict=True):
                seen[int(g > 0), list({f for w in words(t) for f in features(w)})] += 1
        at = np.flatnonzero(seen.any(axis=0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["f", "clean", "toxic"])

    totals = {int(r.bad): r.n for r in sample.groupBy((F.col("grade") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(1, 30.0))
    counted = sample.mapInArrow(count, "f int, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where((F.col("t") >= max(3, SUPPORT * toxic)) | (F.col("c") >= max(3, SUPPORT * clean)))
    spread = F.sqrt((F.col("c") + F.col("t") + 1.0) * (clean + 1.0) * (toxic + 1.0)) / (clean + toxic + 2.0)
    gap = F.abs(F.col("t") - (F.col("c") + F.col("t")) * F.lit(toxic / (clean + toxic)))
    chosen = counted.where(gap >= CERTAIN * spread).orderBy(F.desc(gap / spread), "f").limit(most_features).select("f").toPandas().sort_values("f")
    place = chosen["f"].to_numpy(np.int64)

    def keep(batches):
        look = {int(f): i for i, f in enumerate(place)}
        for batch in batches:
            found = [sorted({look[f] for w in words(t) for f in features(w) if f in look}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade").cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["grade", "at"])

    rows = sample.mapInArrow(keep, "grade int, at array<int>").toPandas()
    grades = rows["grade"].to_numpy(np.int64)
    sizes = np.array([len(x) for x in rows["at"]], np.int64)
    columns = np.concatenate([np.asarray(x, np.int64) for x in rows["at"]]) if sizes.sum() else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(grades)), sizes)
    weight, theta = fit_ordinal(at, columns, grades, len(place))
    return Model(place, weight, theta)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the expected severity, the median grade and whether a grade above 0 is likelier than not."""

    def columns(batches):
        look = {int(f): float(w) for f, w in zip(model.place, model.weight, strict=True)}
        known: dict[str, tuple] = worker_cache("toxicity", id(model), dict)
        known.clear()  # of another task's model
        for batch in batches:
            for some in small_slices(batch, "text", 1 << 20):
                scores = []
                if len(known) > 150_000:
                    known.clear()
                for t in some.column("text").to_pylist():
                    hit: set[int] = set()
                    for w in words(t):
                        fs = known.get(w)
                        if fs is None:
                            fs = known[w] = tuple(f for f in features(w) if f in look)
                        if fs:
                            hit.update(fs)
                    scores.append(sum(look[f] for f in sorted(hit)))
                odds = model.grade_odds(np.array(scores, np.float64))
                yield some, [pa.array(odds @ np.arange(odds.shape[1])), pa.array((np.cumsum(odds, axis=1) >= 0.5 - 1e-12).argmax(axis=1), pa.int32()), pa.array(odds[:, 0] < 0.5 - 1e-12)]

    return with_columns(docs, "severity double, grade int, toxic boolean", columns)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels`` (doc_id, toxic 0 or 1): these say no more than toxic or not, so there are two grades and one threshold."""
    toxic = F.col("toxic").cast("int")
    return fit(docs, labels, F.when(toxic > 0, 1).when(toxic.isNotNull(), 0))


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade and toxic of each document; the model learns from ``labels``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(rows, learn(rows, labels)).select("doc_id", "severity", "grade", "toxic")
