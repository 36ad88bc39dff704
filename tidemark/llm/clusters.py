"""Lloyd's clustering of integer vectors, with each round's nearest centroids found by Exponion search.

A vector carries its centroid, an upper bound of its distance from it and a lower bound of its distance from every other.
When the centroids have moved, the bounds follow by the distances moved. A vector whose upper bound is below the lower one,
or below half the gap between its centroid and the next, keeps its centroid. Any other gets its exact distance u, and if
that doesn't settle it, only the centroids inside the ball of radius 2 u + gap around its own are scanned: both the nearest
and the second nearest lie there. Each centroid has its neighbours in a list sorted by distance, so a ball is a prefix of
that list; prefixes are widened to a power of two, so that vectors of one centroid are solved by few matrix products. The
radius is inclusive and bounds are compared with slack for rounding, so that every tie is scanned, in exact integers.

Each round writes the vectors with their bounds to the shared folder and removes the table of the round before, so that a
lost executor costs no earlier round. Each task adds up its vectors by centroid; what reaches the driver is a sum for each
centroid and component, whatever the number of vectors.

Vectors take part that have the wanted number of components, none of them null, non-finite, or beyond ``LARGEST`` once
scaled (beyond it a squared distance might not fit a long). Rows of equal id are vectors of their own; a vector without id
takes part but can't start a centroid. With fewer vectors than centroids there are as many centroids as vectors with ids;
without any there are no rows. Equal start vectors are centroids of their own, of which the later stay empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import remove, written_at
from tidemark.llm.text import tidy

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Largest component, scaled: 64 squares of twice that add up to less than 2**63.
LARGEST = 1 << 27
#: Relative and absolute slack of compared bounds, far above what doubles round off and far below 1.
_SLACK, _LEAST = 1e-9, 1e-6

_STATE = "vec_id long, v binary, cluster int, upper double, lower double, distance long"


def scaled_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``, the vector's components x as floor(scale * x), for the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST / scale))
    whole = x.isNotNull() & (F.size(x) == dimensions) & ~F.coalesce(bad, F.lit(True))
    return rows.filter(whole).select("vec_id", F.transform(x, lambda c: F.floor(c * float(scale))).alias("v"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact squared distance of each row of ``x`` from each of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) ** 2 * 4 * x.shape[1] < 2**53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


class Search:
    """One round's search: the centroids, the gaps between them, and how far each moved since the round before."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centres = centres
        gaps = np.sqrt(squares(centres, centres).astype(np.float64))
        self.neighbours = np.argsort(gaps, axis=1, kind="stable")
        self.away = np.take_along_axis(gaps, self.neighbours, 1)
        np.fill_diagonal(gaps, np.inf)
        self.gap = gaps.min(1)
        self.first = before is None
        self.moved = np.zeros(len(centres)) if before is None else np.sqrt(((centres - before) ** 2).sum(1).astype(np.float64))
        apart = np.tile(self.moved, (len(centres), 1))
        np.fill_diagonal(apart, 0)
        self.others_moved = apart.max(1)

    def step(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Each row's nearest centroid with new bounds, and the number of distances that were computed."""
        if self.first:
            own, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
            return (*self._scan(x, np.arange(len(x)), np.arange(len(self.centres)), own, upper, lower), len(x) * len(self.centres))
        own = own.copy()
        upper = (upper + self.moved[own]) * (1 + _SLACK)
        lower = lower - self.others_moved[own] * (1 + _SLACK)
        rows = np.flatnonzero(self._open(own, upper, lower))
        upper[rows] = np.sqrt(((x[rows] - self.centres[own[rows]]) ** 2).sum(1).astype(np.float64))
        work = len(rows)
        rows = rows[self._open(own[rows], upper[rows], lower[rows])]
        was, k = own[rows], len(self.centres)
        for c in np.unique(was):
            mine = rows[was == c]
            radius = (2 * upper[mine] + self.gap[c]) * (1 + _SLACK) + _LEAST
            inside = np.searchsorted(self.away[c], radius, "right")
            width = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(int), k)
            for w in np.unique(width):
                part = mine[width == w]
                self._scan(x, part, np.sort(self.neighbours[c, :w]), own, upper, lower)
                work += len(part) * int(w)
        return own, upper, lower, work

    def _open(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return upper * (1 + _SLACK) + _LEAST >= np.maximum(lower, self.gap[own] / 2)

    def _scan(self, x: np.ndarray, rows: np.ndarray, candidates: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple:
        """Settles ``rows`` among ``candidates``, which ascend, so that the first of equal distances is the smaller number."""
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            d = squares(x[part], self.centres[candidates])
            line, best = np.arange(len(part)), d.argmin(1)
            own[part] = candidates[best]
            upper[part] = np.sqrt(d[line, best].astype(np.float64))
            d[line, best] = np.iinfo(np.int64).max
            lower[part] = np.sqrt(d.min(1).astype(np.float64))  # of one centroid alone: beyond all distances
        return own, upper, lower

    def distances(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return ((x - self.centres[own]) ** 2).sum(1)


def _rows(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dimensions).astype(np.int64)


def _first_state(dimensions: int) -> Callable:
    def packed(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = batch["v"].flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(batch.num_rows, dimensions)
            none = np.zeros(len(x))
            columns = [batch["vec_id"], pa.array([r.tobytes() for r in x], pa.binary()), none.astype(np.int32), none, none, none.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vec_id", "v", "cluster", "upper", "lower", "distance"])

    return packed


def _round(search: Search, dimensions: int) -> Callable:
    def stepped(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _rows(batch["v"], dimensions)
            bounds = (batch[c].to_numpy() for c in ("upper", "lower"))
            own, upper, lower, _ = search.step(x, batch["cluster"].to_numpy().astype(np.int64), *bounds)
            columns = [batch["vec_id"], batch["v"], pa.array(own.astype(np.int32)), upper, lower, search.distances(x, own)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vec_id", "v", "cluster", "upper", "lower", "distance"])

    return stepped


def _sums(k: int, dimensions: int) -> Callable:
    def summed(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sum of each centroid and component, and its number of vectors as one more component."""
        total = np.zeros((k, dimensions + 1), np.int64)
        for batch in it:
            own = batch["cluster"].to_numpy()
            order = np.argsort(own, kind="stable")
            at = np.flatnonzero(np.diff(own[order], prepend=-1))
            if len(at):
                x = np.column_stack([_rows(batch["v"], dimensions), np.ones(len(own), np.int64)])
                total[own[order][at]] += np.add.reduceat(x[order], at)
        number, component = np.divmod(np.arange(total.size), dimensions + 1)
        some = np.repeat(total[:, -1] > 0, dimensions + 1)
        columns = {"cluster": number[some].astype(np.int32), "component": component[some].astype(np.int32), "part": total.ravel()[some]}
        yield pa.RecordBatch.from_pydict(columns)

    return summed


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Clusters vectors, as from ``scaled_vectors``; columns as ``op13`` returns them.

    Centroids start as the ``k`` vectors whose ids have the smallest SHA-256 of ``seed:id``, rows of equal id by vector.
    """
    spark = vectors.sparkSession
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = vectors.filter("vec_id is not null").orderBy(key, "v").limit(k).select("v").collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = np.array([r["v"] for r in starts], np.int64)
    k, before = len(centres), None
    state, path = written_at(vectors.mapInArrow(tidy(_first_state(dimensions)), _STATE))
    for number in range(rounds + 1):
        following = state.mapInArrow(tidy(_round(Search(centres, before), dimensions)), _STATE)
        state, fresh = written_at(following)
        remove(spark, path)
        path, before = fresh, centres
        if number < rounds:
            parts = state.mapInArrow(tidy(_sums(k, dimensions)), "cluster int, component int, part long")
            found = parts.groupBy("cluster", "component").agg(F.sum("part").alias("part")).toArrow()  # k * (dimensions + 1) rows
            sums = np.zeros((k, dimensions + 1), np.int64)
            sums[found["cluster"].to_numpy(), found["component"].to_numpy()] = found["part"].to_numpy()
            n = sums[:, -1:]
            centres = np.where(n > 0, sums[:, :-1] // np.maximum(n, 1), centres)
    inertia = {r["cluster"]: r["inertia"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    facts = [(c, own, sum(inertia.values()), digest[c]) for c, own in inertia.items()]  # one for each centroid with vectors
    facts = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return state.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
