"""Exponion rounds against plain assignment of all rows to all centroids."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance string"


def plain(rows, k, rounds, dimensions):
    """Expected (vec_id, cluster, distance) rows, and the final centroids, of (vec_id, scaled vector) rows."""
    ids = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    centres = [list(v) for _, v in ids[:k]]
    for n in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for _, v in rows]
        own = [d.index(min(d)) for d in far]
        if n < rounds:
            for c in range(len(centres)):
                mine = [v for (_, v), o in zip(rows, own) if o == c]
                if mine:
                    centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, o, d[o]) for (i, _), o, d in zip(rows, own, far)], centres


def test_search_keeps_what_a_full_scan_finds_and_computes_less():
    r = np.random.default_rng(4)
    groups = r.integers(-200, 200, (40, 8))
    x = (groups[r.integers(0, 40, 6000)] + r.integers(-6, 7, (6000, 8))).astype(np.int64)
    centres, before = x[r.permutation(6000)[:40]].copy(), None
    centres[7] = centres[3]  # equal centroids: the smaller number takes all
    own = upper = lower = None
    works = []
    for _ in range(6):
        search = clusters.Search(centres, before)
        own, upper, lower, work = search.step(x, own, upper, lower)
        d = clusters.squares(x, centres)
        assert (own == d.argmin(1)).all()
        exact = np.sqrt(np.sort(d, 1).astype(float))
        assert (upper >= exact[:, 0] - 1e-6).all() and (lower <= exact[:, 1] + 1e-6).all()
        works.append(work)
        sums = np.stack([x[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else centres[c] for c in range(40)])
        before, centres = centres, sums
    assert works[0] == 6000 * 40 and works[2] < works[0] / 3 and max(works[4:]) < works[0] / 40  # later rounds scan small balls only


def test_ties_at_the_radius_are_scanned():
    """Rows half-way between centroids on a grid: the smaller number wins whatever centroid the row had."""
    centres = np.array([[0, 0], [4, 0], [0, 4], [4, 4], [2, 2]])
    x = np.array([[2, 0], [2, 4], [0, 2], [4, 2], [3, 3], [1, 1], [2, 2]])
    want = clusters.squares(x, centres).argmin(1)
    for start in range(5):
        search = clusters.Search(centres, centres)
        own = np.full(len(x), start)
        upper = np.sqrt(((x - centres[start]) ** 2).sum(1).astype(float))
        assert (search.step(x, own, upper, np.zeros(len(x)))[0] == want).all()


def test_large_components_stay_exact():
    x = np.array([[clusters.LARGEST, -clusters.LARGEST] * 32, [clusters.LARGEST - 1] * 64], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in x] for u in x]
    assert clusters.squares(x, x).tolist() == want


@pytest.mark.parametrize("parts", [1, 5])
def test_clusters_equal_plain_rounds(spark, parts):
    """Repeated rows and ids, rows without ids, a vector that a third of the rows hold, and rows that take no part."""
    r = random.Random(9)
    rows = [(i, [r.choice([-0.5, 0.25, 0.0, 0.75]) + r.randrange(4) / 256 for _ in range(4)]) for i in range(120)]
    hot = [0.1, 0.2, 0.3, 0.4]
    rows += [(500 + i, hot) for i in range(60)] + [(7, rows[7][1]), (7, hot), (None, hot), (None, rows[3][1])]
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, []), (906, [1e300] * 4), (907, [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows + odd], SCHEMA).repartition(parts)
    got = clusters.cluster(clusters.scaled_vectors(df, 4), 9, 5, 4).collect()
    want, centres = plain([(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows], 9, 5, 4)
    order = lambda rows: sorted(rows, key=repr)
    assert order([(g.vec_id, g.cluster, g.distance) for g in got]) == order(want)
    assert {g.inertia for g in got} == {sum(d for *_, d in want)}
    for g in got:
        assert g.cluster_inertia == sum(d for _, c, d in want if c == g.cluster)
        assert g.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[g.cluster])).encode()).hexdigest()


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 1, "", ""), (2, [0.5, -0.5], 1, "", "")], SCHEMA)
    got = clusters.cluster(clusters.scaled_vectors(df, 2), 40, 5, 2).collect()
    assert sorted((g.vec_id, g.distance, g.inertia) for g in got) == [(1, 0, 0), (2, 0, 0)] and len({g.cluster for g in got}) == 2
    none = clusters.cluster(clusters.scaled_vectors(df.filter("vec_id > 5"), 2), 40, 5, 2)
    assert none.isEmpty() and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_earlier_rounds_are_removed(spark, monkeypatch):
    """One table of the vectors is left, whatever the number of rounds."""
    gone, made = [], []
    kept = clusters.written_at
    monkeypatch.setattr(clusters, "remove", lambda s, path: gone.append(path))
    monkeypatch.setattr(clusters, "written_at", lambda df: made.append(kept(df)) or made[-1])
    df = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id") / 50, F.col("id") % 7 / 7).alias("embedding"))
    assert clusters.cluster(clusters.scaled_vectors(df, 2), 4, 3, 2).count() == 50
    assert gone == [path for _, path in made[:-1]]
