"""Centroid clustering with a vantage-point tree over the centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.tables import stored
from callsift.llm.vectors import finite_vector, whole_components, whole_matrix

# Centroids, rounds, components of a vector, parts of 1 in whole numbers, seed of the starting hash.
CLUSTERS, ROUNDS, COMPONENTS, FACTOR, SEED = 40, 5, 64, 256, 2
# Centroids of a leaf, and entries of the table of open nodes of the vectors that are searched together.
LEAF, OPEN_ENTRIES = 4, 1 << 18
# Relative error that a bound on a distance may have; far above that of double precision.
SLACK = 1e-12


class VPTree:
    """A vantage-point tree over numbered integer points.

    An inner node holds one point, its vantage point; the others are halved by
    their distance from it, and each half is known by its least and largest
    distance.  Leaves hold up to :data:`LEAF` points.
    """

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.int64)
        self.members: list[np.ndarray] = []
        # Of inner nodes: both children and the distances of their points from the vantage point.
        self.children: list[tuple[int, int] | None] = []
        self.rings: list[tuple[tuple[float, float], tuple[float, float]] | None] = []
        self._add(np.arange(len(points)))

    def _add(self, numbers: np.ndarray) -> int:
        node = len(self.members)
        self.children.append(None)
        self.rings.append(None)
        if len(numbers) <= LEAF:
            self.members.append(numbers)
            return node
        own = self.points[numbers].astype(np.float64)
        at = int(((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax())
        vantage, rest = numbers[at], np.delete(numbers, at)
        self.members.append(numbers[at : at + 1])
        squares = squared(self.points[rest], self.points[vantage])
        order = np.argsort(squares, kind="stable")
        half = len(rest) // 2
        parts = order[:half], order[half:]
        self.rings[node] = tuple((float(np.sqrt(squares[p].min())), float(np.sqrt(squares[p].max()))) for p in parts)
        self.children[node] = tuple(self._add(rest[p]) for p in parts)
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest point of each query; of equal ones the smallest number.

        Each query has its own open nodes and takes the one of the least possible
        distance next.  It ends when that is beyond its best distance; nodes that
        could hold a point at exactly the best distance are still entered.
        """
        numbers, squares = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        step = max(1, OPEN_ENTRIES // len(self.members))
        for at in range(0, len(queries), step):
            numbers[at : at + step], squares[at : at + step] = self._search(queries[at : at + step])
        return numbers, squares

    def _search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.full((len(queries), len(self.members)), np.inf)
        bounds[:, 0] = 0.0
        best = np.full(len(queries), np.iinfo(np.int64).max)
        number = np.full(len(queries), len(self.points))
        rows = np.arange(len(queries))
        while len(rows):
            nodes = bounds[rows].argmin(axis=1)
            least = bounds[rows, nodes]
            going = least <= np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
            rows, nodes, least = rows[going], nodes[going], least[going]
            bounds[rows, nodes] = np.inf
            for node in np.unique(nodes):
                mine = rows[nodes == node]
                for member in self.members[node]:
                    found = squared(queries[mine], self.points[member])
                    closer = (found < best[mine]) | ((found == best[mine]) & (member < number[mine]))
                    best[mine[closer]], number[mine[closer]] = found[closer], member
                if self.children[node] is None:
                    continue
                away, above = np.sqrt(found.astype(np.float64)), least[nodes == node]
                for child, (low, high) in zip(self.children[node], self.rings[node], strict=True):
                    bound = np.maximum(away - high, low - away) - SLACK * (away + high)
                    bounds[mine, child] = np.maximum(bound, above)
        return number, best


def squared(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of rows of longs from one point."""
    away = points - other
    return np.einsum("ij,ij->i", away, away)


def _start(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of their ids; equal hashes by their components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.where("vec_id is not null").select(mark.alias("mark"), "point").orderBy("mark", "point").limit(clusters)
    return np.array([row["point"] for row in chosen.collect()], dtype=np.int64)


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floored mean of the vectors nearest to it; without vectors it stays.

    Tasks return one sum per centroid and component, whatever they read.
    """
    tree, components = VPTree(centroids), centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            points = whole_matrix(batch.column("point"), components)
            numbers, _ = tree.nearest(points)
            np.add.at(sums, numbers, points)
            counts += np.bincount(numbers, minlength=len(counts))
        used = np.flatnonzero(counts)
        columns = [np.repeat(used, components), np.tile(np.arange(components), len(used)), sums[used].ravel()]
        columns.append(np.repeat(counts[used], components))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "at", "total", "n"])

    partial = kept.select("point").mapInArrow(add, "cluster long, at long, total long, n long")
    wide = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    moved = centroids.copy()
    for row in partial.groupBy("cluster", "at").agg(wide, F.sum("n").alias("n")).collect():
        moved[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return moved


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    factor: int = FACTOR,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Lloyd's clustering of vectors in whole numbers, exact in every round.

    1. Vectors become ``floor(factor * x)`` and are written once.  The first
       centroids are those of the ``clusters`` smallest hashes ``seed:id``.
    2. Each round builds a vantage-point tree over the centroids and sends it to
       the tasks.  Every vector searches it best-first by branch and bound, with
       exact integer distances and ties to the smaller centroid; tasks return
       sums, and a centroid becomes the floored mean of its vectors.
    3. After ``rounds`` rounds the vectors are assigned once more.

    The driver and the broadcast tree hold ``clusters * components`` numbers.

    Returns one row per vector that takes part: ``vec_id, cluster, distance``
    (squared), ``cluster_inertia``, ``inertia`` (null where beyond a long) and
    ``centroid_sha256``.  Vectors that are null, of another length, or hold null
    or non-finite components take no part.  Repeated rows count each; a vector
    with a null id is assigned but never a first centroid.  With fewer vectors
    than ``clusters`` each is a first centroid; without any the result is empty.
    Components of a magnitude above 2^27 count as 2^27.  Other columns are
    ignored.
    """
    if clusters < 1 or rounds < 0 or not 1 <= components <= 64:
        raise ValueError("there must be a cluster, no negative rounds, and 1 to 64 components")
    named = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")
    )
    able = finite_vector(F.col("vec")) & (F.size("vec") == components)
    kept = stored(named.where(able).select("vec_id", whole_components(F.col("vec"), factor).alias("point")), "points")
    centroids = _start(kept, clusters, seed)
    fields = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return kept.sparkSession.createDataFrame(
            [], f"{fields}, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    for _ in range(rounds):
        centroids = _moved(kept, centroids)
    tree = VPTree(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, squares = tree.nearest(whole_matrix(batch.column("point"), components))
            columns = [batch.column("vec_id"), pa.array(numbers.astype(np.int32)), pa.array(squares)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    assigned = stored(kept.mapInArrow(assign, fields), "assigned")
    wide = F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")
    sums = {row["cluster"]: int(row["inertia"]) for row in assigned.groupBy("cluster").agg(wide).collect()}

    def long(value: int) -> int | None:
        return value if value < 1 << 63 else None

    rows = [
        (number, long(own), long(sum(sums.values())), _digest(centroids[number])) for number, own in sorted(sums.items())
    ]
    of_cluster = kept.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
