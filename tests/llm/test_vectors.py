"""Centroid clustering and top-k products against plain versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsift.llm import clustering, products
from callsift.llm.clustering import VPTree, cluster_vectors
from callsift.llm.products import best_products, top_products

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHES = ("at", "dim", "chunk", "block", "row", "square", "cluster", "distance", "score", "rank", "point", "vec", "query")


@pytest.fixture
def table(spark):
    def build(rows):
        df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
        return df.withColumns({c: F.lit("?") for c in CLASHES})

    return build


def whole(vector, factor):
    return np.floor(np.array(vector, dtype=np.float32).astype(float) * factor).astype(np.int64)


def plain_clusters(rows, clusters=40, rounds=5, components=64):
    kept = [(i, whole(v, 256)) for i, v in rows if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), tuple(v.tolist())) for i, v in kept if i is not None)
    centroids = np.array([v for _, v in start[:clusters]])
    points = np.array([v for _, v in kept])
    for turn in range(rounds + 1):
        away = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        number = away.argmin(axis=1)
        if turn == rounds:
            break
        for c in range(len(centroids)):
            own = points[number == c]
            if len(own):
                centroids[c] = own.sum(axis=0) // len(own)
    distance = away[np.arange(len(points)), number]
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return sorted(
        (str(i), int(c), int(d), int(distance[number == c].sum()), int(distance.sum()), digests[c])
        for (i, _), c, d in zip(kept, number, distance, strict=True)
    )


def found_clusters(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_tree_finds_the_nearest_and_the_smallest_of_ties():
    random = np.random.default_rng(5)
    for size, dim, spread in ((1, 3, 5), (4, 2, 2), (40, 2, 3), (200, 3, 4), (150, 8, 1000), (300, 1, 10)):
        points = random.integers(-spread, spread + 1, (size, dim))
        queries = random.integers(-2 * spread, 2 * spread + 1, (500, dim))
        squares = ((queries[:, None, :] - points[None]) ** 2).sum(axis=2)
        number, best = VPTree(points).nearest(queries)
        assert (number == squares.argmin(axis=1)).all()
        assert (best == squares.min(axis=1)).all()


def test_tree_prunes():
    """Queries near far-apart clusters measure few of the points."""
    random = np.random.default_rng(1)
    points = random.integers(-100_000, 100_000, (400, 3))
    queries = points[random.integers(0, 400, 50)] + random.integers(-20, 21, (50, 3))
    seen = 0

    def count(rows, other, squared=clustering.squared):
        nonlocal seen
        seen += len(rows)
        return squared(rows, other)

    tree = VPTree(points)
    old, clustering.squared = clustering.squared, count
    try:
        tree.nearest(queries)
    finally:
        clustering.squared = old
    assert seen < 50 * 400 / 4


def test_clusters_equal_plain_version(table):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(0, 1, 64).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)] + [(5, rows[9][1]), (5, rows[9][1]), (-3, rows[9][1]), (None, rows[11][1])]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [1.0] * 63 + [float("nan")]), (2005, [float("inf")] + [0.0] * 63)]
    want = plain_clusters(rows)
    assert found_clusters(cluster_vectors(table(rows + odd).repartition(3))) == want
    assert found_clusters(cluster_vectors(table(rows[:6]))) == plain_clusters(rows[:6])
    assert cluster_vectors(table(odd)).count() == 0
    assert cluster_vectors(table([])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_components_are_bounded(table):
    rows = [(i, [3e38 * (-1) ** i] * 64) for i in range(4)] + [(9, [0.0] * 64)]
    found = {r.vec_id: r for r in cluster_vectors(table(rows), clusters=2).collect()}
    assert len(found) == 5 and all(r.distance >= 0 for r in found.values())


def plain_products(rows, top=20):
    kept = [(i, at, whole(v, 64)) for at, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for query, at, vector in kept:
        if query is None or query % 20:
            continue
        scores = [(-int(vector @ other), i is None, i or 0, i) for i, a, other in kept if a != at and len(other) == len(vector)]
        best = sorted(scores, key=lambda s: s[:3])[:top]
        out += [(query, rank, str(i), -score) for rank, (score, _, _, i) in enumerate(best, 1)]
    return sorted(out)


def found_products(df):
    return sorted((r.query_id, r["rank"], str(r.vec_id), r.score) for r in df.collect())


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(products, "CHUNK_CELLS", 600)
    monkeypatch.setattr(products, "QUERY_CELLS", 200)
    monkeypatch.setattr(products, "LEAST_ROWS", 20)
    monkeypatch.setattr(products, "BUCKET", 16)
    monkeypatch.setattr(products, "HELD", 500)


def test_products_equal_plain_version(table, small_tiles):
    random = np.random.default_rng(8)
    rows = [(i, (random.normal(0, 1, 6) * random.choice([0.1, 1, 9])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[20][1]) for i in range(130)] + [(40, rows[1][1]), (40, rows[1][1]), (None, rows[20][1])]
    rows += [(600, [0.0] * 6), (620, [0.0] * 6), (700, [1.0, 2.0]), (720, [0.5, -1.0]), (740, []), (760, [])]
    odd = [(800, None), (820, [1.0] * 5 + [None]), (840, [float("nan")] * 6), (860, [float("-inf")] * 6)]
    assert found_products(top_products(table(rows + odd).repartition(4))) == plain_products(rows)
    assert found_products(top_products(table(rows[:7]))) == plain_products(rows[:7])
    assert found_products(top_products(table(rows), top=3)) == plain_products(rows, top=3)
    assert top_products(table(odd)).count() == 0 and top_products(table([])).count() == 0


def test_other_queries_can_be_asked(table):
    rows = [(i, [float(i), 1.0]) for i in range(30)]
    asked = top_products(table(rows), queries=F.col("vec_id") == 3, top=2)
    assert found_products(asked) == [(3, 1, "29", 3 * 29 * 4096 + 4096), (3, 2, "28", 3 * 28 * 4096 + 4096)]


def test_both_prunings_lose_nothing():
    """Skewed lengths and close directions, so that both prunings and whole buckets left out occur."""
    random = np.random.default_rng(4)
    centre = random.normal(0, 100, 16)
    near = np.round((centre + random.normal(0, 12, (3000, 16))) * random.lognormal(0, 0.7, (3000, 1))).astype(np.int64)
    wide = np.round(random.normal(0, 30, (1500, 16))).astype(np.int64)
    points = np.concatenate([near, wide])
    queries = points[::37]
    used = []
    feasible, at = products._feasible, np.arange(len(points))

    def noted(local, *rest):
        pairs = feasible(local, *rest)
        used.append((len(local) * len(rest[-1]), len(pairs[0])))
        return pairs

    products._feasible = noted
    try:
        rows, places, found = best_products(queries, at[::37], np.full(len(queries), products._LOWEST), points, at, at, 20)
    finally:
        products._feasible = feasible
    scores = queries @ points.T
    scores[np.arange(len(queries)), at[::37]] = -(2**60)
    want = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    assert (places.reshape(-1, 20) == want).all()
    assert (found.reshape(-1, 20) == np.take_along_axis(scores, want, axis=1)).all()
    assert used and sum(kept for _, kept in used) < sum(every for every, _ in used)


def test_large_products_are_exact(table):
    random = np.random.default_rng(2)
    rows = [(i, (random.integers(-(2**22), 2**22, 6) / 4).astype(np.float32).tolist()) for i in range(120)]
    assert found_products(top_products(table(rows))) == plain_products(rows)
