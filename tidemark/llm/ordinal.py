"""Graded quality by a cumulative-link model: one score of hashed text, and ordered thresholds between the grades.

A text's features are its words (A-Z lower-cased), the last bytes of its words as written, and for each word whether it
repeats the one before, hashed to one space of weights; its score is the mean of its features' weights. The chance of a grade above a threshold is the logistic function
of the score less the threshold. All thresholds share the weights. The model is fitted in one task to a bounded sample of
rated texts; scoring reads every text once, without a shuffle.

Defined results: null and empty texts have the score 0. With one grade among the ratings it has the probability 1;
without ratings the results are null and every document is kept. Rows without id are scored like others. Repeated rows
get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import hash_sample
from tidemark.llm.text import batches, texts, tidy

#: Most rated texts that the model is fitted to, by the order of a hash of the id; most grades.
SAMPLE, GRADES = 20_000, 64
#: Size of the hashed space, bytes of an ending.
SPACE, LAST_BYTES = 1 << 17, 3
#: Steps of the fit over the whole sample, their size, and the ridge penalty.
STEPS, RATE, RIDGE = 100, 1.5, 1e-6
#: Texts that the fit works on at a time.
BLOCK = 1_000
#: Selection keeps documents that reach the wanted grade with at least this probability.
LEAST_CHANCE = 0.5

_ENDING = 0x5BD1E995  # seed that tells endings from words
_FRESH, _AGAIN = zlib.crc32(b" fresh"), zlib.crc32(b" again")  # no word has a blank


def features(text: bytes) -> np.ndarray:
    """Places of a text's features in the hashed space: for each word its own, its ending's and its repetition's."""
    found = text.split()
    n = len(found)
    out = np.empty(3 * n, np.uint32)
    out[:n] = np.fromiter(map(zlib.crc32, text.lower().split()), np.uint32, n)
    out[n : 2 * n] = np.fromiter((zlib.crc32(w[-LAST_BYTES:], _ENDING) for w in found), np.uint32, n)
    out[2 * n :] = _FRESH
    out[2 * n + 1 :][out[1:n] == out[: max(0, n - 1)]] = _AGAIN
    return (out % np.uint32(SPACE)).astype(np.int32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _thresholds(free: np.ndarray) -> np.ndarray:
    """Ascending thresholds of free parameters: the first, and logarithms of the steps to the next."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


class Ratings:
    """Rated texts, ready for the fit: for each text its distinct places and how often each occurs."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, grades: int) -> None:
        self.n, self.grade, self.grades = len(docs), grade, grades
        self.blocks = []  # of some texts the places, their shares of the text, the texts' numbers, where each begins
        for at in range(0, len(docs), BLOCK):
            some = [i for i in range(at, min(at + BLOCK, len(docs))) if len(docs[i][0])]
            if some:
                lengths = np.array([len(docs[i][0]) for i in some])
                share = np.concatenate([docs[i][1] / docs[i][1].sum() for i in some])
                places = np.concatenate([docs[i][0] for i in some])
                self.blocks.append((places, share, np.array(some), np.cumsum(lengths) - lengths, lengths))

    def loss(self, weights: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean negative logarithm of the grades' probabilities with the ridge penalty, and its gradients."""
        theta, grade, grades = _thresholds(free), self.grade, self.grades
        score = np.zeros(self.n)
        for places, share, some, begin, _ in self.blocks:
            score[some] = np.add.reduceat(weights[places] * share, begin)
        upper = np.append(theta, np.inf)[grade]  # the grade's own bounds
        lower = np.insert(theta, 0, -np.inf)[grade]
        a = np.where(np.isinf(upper), 0.0, _logistic(score - np.where(np.isinf(upper), 0, upper)))
        b = np.where(np.isinf(lower), 1.0, _logistic(score - np.where(np.isinf(lower), 0, lower)))
        p = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        gradient = RIDGE * weights
        for places, share, some, _, lengths in self.blocks:
            gradient += np.bincount(places, np.repeat((da - db)[some], lengths) * share, SPACE) / self.n
        dtheta = np.bincount(np.minimum(grade, grades - 2), np.where(grade < grades - 1, -da, 0), grades - 1)
        dtheta += np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, db, 0), grades - 1)
        dfree = np.cumsum(dtheta[::-1])[::-1] / self.n
        dfree[1:] *= np.exp(free[1:])
        return float(-np.log(p).mean() + RIDGE / 2 * weights @ weights), gradient, dfree


def fit_ordinal(rated: Ratings, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for texts' features and their grades from 0 on, by AdaGrad over all texts."""
    above = np.array([(rated.grade > k).mean() for k in range(rated.grades - 1)])
    start = -np.log(np.clip(above, 1e-4, 1 - 1e-4) / (1 - np.clip(above, 1e-4, 1 - 1e-4)))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    weights, squares, free_squares = np.zeros(SPACE), np.full(SPACE, 1e-12), np.full(len(free), 1e-12)
    for _ in range(steps):
        _, gradient, dfree = rated.loss(weights, free)
        squares += gradient**2
        free_squares += dfree**2
        weights -= RATE * gradient / np.sqrt(squares)
        free -= 0.1 * dfree / np.sqrt(free_squares)
    return weights, _thresholds(free)


class Model:
    """The grades, ascending, the weights and the thresholds between the grades."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.grades, self.weights, self.thresholds = grades, weights.astype(np.float32), thresholds

    def chances(self, score: np.ndarray) -> np.ndarray:
        """For each score the probability of each grade."""
        above = _logistic(score[:, None] - self.thresholds) if len(self.grades) > 1 else np.zeros((len(score), 0))
        edge = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], 1)
        return edge[:, :-1] - edge[:, 1:]

    def score(self, docs: DataFrame, wanted: int) -> DataFrame:
        """``doc_id``, ``expected_grade``, ``tail_probability`` (of the grade ``wanted`` or a higher one) and ``kept``."""
        schema = "doc_id long, expected_grade double, tail_probability double, kept boolean"
        if not self.grades:
            none = F.lit(None).cast("double")
            return docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("expected_grade"), none.alias("tail_probability"), F.lit(True).alias("kept"))
        values, tail = np.array(self.grades, float), np.array([g >= wanted for g in self.grades])

        def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(it, 1000):
                found = [features(t) for t in texts(batch.column(1))]
                score = np.array([float(self.weights[f].mean()) if len(f) else 0.0 for f in found])
                p = self.chances(score)
                reach = p[:, tail].sum(1)
                columns = [batch.column(0).cast(pa.int64()), pa.array(p @ values), pa.array(reach), pa.array(reach >= LEAST_CHANCE)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail_probability", "kept"])

        return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)

    def select(self, docs: DataFrame, wanted: int) -> DataFrame:
        """The rows of ``docs`` that reach the wanted grade with at least ``LEAST_CHANCE``, as they are."""
        kept = self.score(docs.select("doc_id", "text"), wanted).filter(~F.col("kept")).select("doc_id")
        return docs.join(kept, "doc_id", "left_anti")


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the rated documents (``ratings``: ``doc_id`` and a whole ``grade``; of several the highest counts)."""
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("long").alias("grade"))
    chosen = hash_sample(rated, "doc_id", sample)
    grades = sorted(r["grade"] for r in chosen.select("grade").distinct().limit(GRADES + 1).collect())
    if len(grades) > GRADES:
        raise ValueError(f"more than {GRADES} grades")
    if len(grades) < 2:
        return Model(grades, np.zeros(SPACE), np.zeros(0))
    rank = {g: i for i, g in enumerate(grades)}

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1000):
            found = [np.unique(features(t), return_counts=True) for t in texts(batch.column(1))]
            ends = pa.array(np.cumsum([0, *(len(f) for f, _ in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in zip(*found, strict=True)]
            grade = pa.array([rank[g] for g in batch.column(2).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, grade], ["doc_id", "places", "times", "grade"])

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, grade = [], []
        for batch in it:
            found += [(p.values.to_numpy(), t.values.to_numpy()) for p, t in zip(batch.column(0), batch.column(1), strict=True)]
            grade += batch.column(2).to_pylist()
        if found:
            weights, thresholds = fit_ordinal(Ratings(found, np.array(grade), len(grades)))
            yield pa.RecordBatch.from_arrays([pa.array([weights]), pa.array([thresholds])], ["weights", "thresholds"])

    # All tasks read and count features; one text of each id, however often it is repeated, goes to the one that fits.
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
    rows = rated.mapInArrow(tidy(count), "doc_id long, places array<int>, times array<int>, grade int")
    rows = rows.repartition(1).sortWithinPartitions("doc_id").drop("doc_id")
    got = rows.mapInArrow(tidy(run), "weights array<double>, thresholds array<double>").toArrow()
    if not got.num_rows:
        return Model([], np.zeros(SPACE), np.zeros(0))
    return Model(grades, np.array(got["weights"][0].as_py()), np.array(got["thresholds"][0].as_py()))
