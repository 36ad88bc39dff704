"""Exact top-k inner products by a Voronoi join.

Pivots come from k-means over a bounded sample of the rows; their number grows with the square root of the rows. Each row
belongs to its nearest pivot's group, and there to a ring by its distance from the pivot. One aggregate gives each ring's
size, least and largest distance, and largest norm. A query's k-th best score over the sample is a lower bound of its k-th
best over all rows; the triangle inequality gives an upper bound of its scores in a ring, and rings whose upper bound is
below the lower one are left out.

Queries, too, are grouped by their nearest pivot. Groups of neighbouring pivots make up blocks of bounded size, large
groups are split. A block needs the rings that one of its queries needs, and its queries, being near each other, need much
the same: a row is copied only to the blocks that need its ring. Rings are dealt to cells of bounded size; each pair of
cell and block that has work is one task-sized group, solved with a matrix product, and the k best of a query's cells are
its result. The sample decides only what can be pruned, never the result: vectors without clusters, whose distances are
all alike, prune nothing, and then every query meets every cell.

Vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with zeros.
Ties go to the smaller id. Rows of equal id are rows of their own, and none is a candidate for a query of its own id. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed, hash_sample, written
from tidemark.llm.text import tidy

#: Rows that k-means and a query's first bound are taken from: a bounded sample, by the order of a hash of the id.
SAMPLE = 4096
#: Pivots: half the square root of the rows, within these bounds; rounds of k-means; rings of a group.
LEAST_PIVOTS, MOST_PIVOTS, ROUNDS, RINGS = 8, 512, 8, 4
#: Most rows of a cell and most queries of a block.
CELL_ROWS, BLOCK_QUERIES = 20_000, 16_384
SCALE = 1024

_RESULT = "query_id long, vec_id long, score long"


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and the vector ``v`` with each component x as floor(scale * x), for the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    taking_part = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad
    return rows.filter(taking_part).select("vec_id", F.transform(x, lambda c: F.floor(c * float(scale))).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A list column as rows of integers, padded with zeros to at least ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` exactly: in doubles where no sum can leave their exact range, else in integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k highest scores, ties to the smaller column; ``own`` marks what is no candidate."""
    n = scores.shape[1]
    if float(np.abs(scores).max(initial=0)) * n < 2**62:
        order = scores * n - np.arange(n)  # unique, so that a partition without order among ties will do
    else:
        ranked = np.argsort(np.lexsort((-np.arange(n)[None, :].repeat(len(scores), 0), scores), axis=1), axis=1)
        order = ranked.astype(np.int64)
    order[own] = np.iinfo(np.int64).min
    top = np.argpartition(order, n - min(k, n), axis=1)[:, n - min(k, n) :]
    row = np.repeat(np.arange(len(scores)), top.shape[1])
    col = top.ravel()
    some = order[row, col] > np.iinfo(np.int64).min
    return row[some], col[some]


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` centres of the rows, by rounds of Lloyd's method from the first ``k`` distinct rows."""
    x = x.astype(np.float64)
    _, first = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(first)[:k]]
    for _ in range(ROUNDS):
        near = ((centres**2).sum(1) / 2 - x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, c, len(centres)) for c in x.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def upper_bounds(q: np.ndarray, centre: np.ndarray, least: np.ndarray, most: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """For each query and ring no less than the highest inner product with a row whose distance from the ring's centre
    is in [least, most] and whose length is ``norm`` at most."""
    size = np.sqrt((q**2).sum(1))[:, None]
    inner = q[:, : centre.shape[1]] @ centre.T
    away = np.sqrt(np.maximum(size**2 + (centre**2).sum(1) - 2 * inner, 0))
    gap = np.maximum(np.maximum(away - most, least - away), 0)  # no row of the ring is nearer to the query
    return np.minimum(np.minimum(inner + size * most, size * norm), (size**2 + norm**2 - gap**2) / 2)


def dealt_blocks(centres: np.ndarray, queries: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """The first block of each pivot's queries and the number of blocks that they are dealt to.

    Pivots are taken in a chain, each followed by the nearest that is left; those of few queries share a block.
    """
    first, parts, block, room = {}, {}, -1, 0
    left = sorted(queries)
    at = left[0] if left else None
    while left:
        left.remove(at)
        n = queries[at]
        if n > room:
            block, room = block + 1, BLOCK_QUERIES
        first[at], parts[at] = block, -(-n // BLOCK_QUERIES)
        if parts[at] > 1:
            block, room = block + parts[at] - 1, 0
        room -= n
        if left:
            at = left[int(((centres[left] - centres[at]) ** 2).sum(1).argmin())]
    return first, parts


class Routes:
    """What a join sends where: ``data`` (``vec_id``, ``v``, ``ring``, ``cell``, ``block``) and ``asked`` (``query_id``,
    ``q`` and the same keys). ``pairs`` and ``sent`` count the pairs of query and ring, and those not pruned."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int) -> None:
        n = vectors.count()
        sample = hash_sample(vectors, "vec_id", SAMPLE).toArrow()
        ids, rows = sample["vec_id"].to_numpy(), _matrix(sample["v"])
        centres = k_means(rows, min(MOST_PIVOTS, max(LEAST_PIVOTS, round(n**0.5 / 2))))
        width, half = rows.shape[1], (centres**2).sum(1) / 2

        def assign(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = 0  # deals rows to cells, even rows of one id
            for batch in it:
                x = _matrix(batch["v"], width).astype(np.float64)
                near = x[:, :width]
                group = (half - near @ centres.T).argmin(1)
                far = np.sqrt(((near - centres[group]) ** 2).sum(1) + (x[:, width:] ** 2).sum(1))
                columns = {"vec_id": batch["vec_id"], "v": batch["v"], "grp": group.astype(np.int32), "far": far}
                columns |= {"norm": np.sqrt((x**2).sum(1)), "turn": np.arange(seen, seen + len(x))}
                seen += len(x)
                yield pa.RecordBatch.from_pydict(columns)

        dealt = written(vectors.mapInArrow(tidy(assign), "vec_id long, v array<long>, grp int, far double, norm double, turn long"))
        radius = {r["grp"]: r["far"] for r in dealt.groupBy("grp").agg(F.max("far").alias("far")).collect()}
        widths = _of({g: max(r, 1e-9) / RINGS for g, r in radius.items()}, "double")
        within = F.least(F.floor(F.col("far") / widths[F.col("grp")]), F.lit(RINGS - 1)).cast("int")
        dealt = dealt.withColumn("ring", F.col("grp") * RINGS + within)
        summary = dealt.groupBy("ring").agg(
            F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most"), F.max("norm").alias("norm")
        )
        rings = summary.orderBy("ring").toArrow()  # at most RINGS for each pivot
        number, least, most, norm = (rings[c].to_numpy() for c in ("ring", "least", "most", "norm"))
        centre = centres[number // RINGS]

        def choose(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each query, with its pivot and the rings that can hold one of its best."""
            seen = 0
            for whole in it:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    q, own = _matrix(batch["v"], width), batch["vec_id"].to_numpy()
                    known = np.where(own[:, None] == ids, np.iinfo(np.int64).min, _product(q, rows))
                    lower = np.full(len(q), -np.inf)
                    if known.shape[1] >= k:
                        kth = np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k]
                        lower = np.where(kth == np.iinfo(np.int64).min, -np.inf, kth.astype(np.float64))
                    upper = upper_bounds(q.astype(np.float64), centre, least, most, norm)
                    open_ = upper * (1 + 1e-9 * np.sign(upper)) + 1e-3 >= lower[:, None]
                    ends = np.concatenate([[0], np.cumsum(open_.sum(1))]).astype(np.int32)
                    found = pa.ListArray.from_arrays(pa.array(ends), pa.array(number[np.nonzero(open_)[1]].astype(np.int32)))
                    near = (half - q[:, :width] @ centres.T).argmin(1).astype(np.int32)
                    columns = [batch["vec_id"], batch["v"], found, pa.array(near), pa.array(np.arange(seen, seen + len(q)))]
                    seen += len(q)
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "q", "rings", "grp", "turn"])

        schema = "query_id long, q array<long>, rings array<int>, grp int, turn long"
        chosen = checkpointed(queries.select("vec_id", "v").mapInArrow(tidy(choose), schema))
        total = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("rings")), F.lit(0)).alias("sent")).first()
        self.pairs, self.sent = total["n"] * len(number), total["sent"]
        held = {r["grp"]: r["count"] for r in chosen.groupBy("grp").count().collect()}  # a row for each pivot
        first, parts = dealt_blocks(centres, held) if held else ({0: 0}, {0: 1})
        block = _of(first, "int")[F.col("grp")] + F.pmod("turn", _of(parts, "int")[F.col("grp")]).cast("int")
        asked = chosen.select("query_id", "q", block.alias("block"), F.explode("rings").alias("ring"))
        cells = {int(g): max(1, -(-int(c) // CELL_ROWS)) for g, c in zip(number, rings["n"].to_numpy(), strict=True)}
        copies = _of(cells, "int")[F.col("ring")]
        self.asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), copies - 1)))
        wanted = checkpointed(self.asked.select("ring", "cell", "block").distinct())  # no key of both sides has more rows than a cell
        data = dealt.select("vec_id", "v", "ring", F.pmod("turn", copies).cast("int").alias("cell"))
        self.data = data.join(wanted, ["ring", "cell"]).select("vec_id", "v", "ring", "cell", "block")


def _of(numbers: dict[int, float], kind: str) -> Column:
    """A map column of numbers by their keys, a bounded number of them."""
    return F.map_from_arrays(F.lit(list(numbers)).cast("array<int>"), F.lit(list(numbers.values())).cast(f"array<{kind}>"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Each query's k highest inner products over all vectors of other ids: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Both inputs have columns ``vec_id`` and ``v``, as from ``whole_vectors``.
    """
    if vectors.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    routes = Routes(vectors.select("vec_id", "v"), queries, k)

    def solve(data: pa.Table, asked: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if data.num_rows and asked.num_rows:
            data = data.sort_by("vec_id")
            x, ids = _matrix(data["v"]), data["vec_id"].to_numpy()
            for at in range(0, asked.num_rows, 256):
                part = asked.slice(at, 256)
                names = part["query_id"].to_numpy()
                scores = _product(_matrix(part["q"]), x)
                row, col = _best(scores, names[:, None] == ids, k)
                found["query_id"].append(names[row])
                found["vec_id"].append(ids[col])
                found["score"].append(scores[row, col])
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in found.items()})

    keys = ["ring", "cell", "block"]
    local = routes.data.groupBy(*keys).cogroup(routes.asked.groupBy(*keys)).applyInArrow(solve, _RESULT)
    return best_rows(local, k)


def best_rows(scored: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
