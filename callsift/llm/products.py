"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsift.llm.tables import map_groups, number_rows, stored
from callsift.llm.vectors import finite_vector, whole_components, whole_matrix
from callsift.plans.skew import join_many_to_one

# Results of a query, and parts of 1 in whole numbers.
TOP, FACTOR = 20, 64
# Components of the candidates and of the queries that meet in one task; rows at least.
CHUNK_CELLS, QUERY_CELLS, LEAST_ROWS = 1 << 19, 1 << 20, 256
# Candidates of a bucket of like length, and queries that are compared with it together.
BUCKET, TOGETHER = 512, 1024
# Local cosine threshold from which coordinates prune better than lengths, and coordinates looked at.
COORDINATE_FROM, FOCUS = 0.75, 4
# Candidate results of a task before they are cut to the best of each query.
HELD = 1 << 21
# Allowance for rounding in bounds; products themselves are exact.
SLACK = 1e-9

_LOWEST = np.iinfo(np.int64).min


class _Best:
    """The best products found for some queries; ``floor`` is what a product must reach."""

    def __init__(self, floor: np.ndarray, top: int, keys: np.ndarray):
        self.floor, self.top, self.keys = floor.copy(), top, keys
        self.scores = np.full((len(floor), top), _LOWEST)
        self.rows, self.places, self.found, self.held = [], [], [], 0

    def add(self, rows: np.ndarray, places: np.ndarray, found: np.ndarray) -> None:
        """Products of query rows with candidate places; raises the floors to the ``top``-th best."""
        if not len(rows):
            return
        self.rows.append(rows)
        self.places.append(places)
        self.found.append(found)
        self.held += len(rows)
        order = np.lexsort((-found, rows))
        own, scores = rows[order], found[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        inside = np.arange(len(own)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(own)]])))
        first = inside < self.top
        seen = own[starts]
        fresh = np.full((len(seen), self.top), _LOWEST)
        fresh[np.searchsorted(seen, own[first]), inside[first]] = scores[first]
        both = np.concatenate([self.scores[seen], fresh], axis=1)
        self.scores[seen] = np.partition(both, self.top, axis=1)[:, self.top :]
        self.floor[seen] = np.maximum(self.floor[seen], self.scores[seen].min(axis=1))
        if self.held > HELD:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is held, cut to the best of each query: by product, then smaller key."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, places, found = (np.concatenate(x) for x in (self.rows, self.places, self.found))
        good = found >= self.floor[rows]
        rows, places, found = rows[good], places[good], found[good]
        order = np.lexsort((places, self.keys[places], -found, rows))
        rows, places, found = rows[order], places[order], found[order]
        starts = np.searchsorted(rows, rows)
        first = np.arange(len(rows)) - starts < self.top
        rows, places, found = rows[first], places[first], found[first]
        self.rows, self.places, self.found, self.held = [rows], [places], [found], len(rows)
        return rows, places, found


def best_products(
    queries: np.ndarray, own: np.ndarray, floor: np.ndarray, points: np.ndarray, at: np.ndarray, keys: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, place in ``points``, product) of the ``top`` best products of each query.

    ``own`` and ``at`` number queries and points; a query does not meet the point
    of its own number.  Products below a query's ``floor`` are left out.  Of
    equal products the smaller of ``keys`` comes first.
    """
    length = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    points, length = points[order], length[order]
    at, keys = at[order], keys[order]
    reach = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    # By Cauchy and Schwarz no partial sum of a product is larger, so doubles are exact.
    if reach.max(initial=0.0) * length.max(initial=0.0) < 2.0**52:
        queries, points = queries.astype(np.float64), points.astype(np.float64)
    units = points / np.where(length > 0, length, 1.0)[:, None]
    out = []
    for first in range(0, len(queries), TOGETHER):
        part = slice(first, first + TOGETHER)
        best = _Best(floor[part], top, keys)
        _search(best, queries[part], reach[part], own[part], points, units, length, at)
        rows, places, found = best.cut()
        out.append((rows + first, order[places], found))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(best, queries, reach, own, points, units, length, at) -> None:
    """All buckets, the longest first, against all queries of a part."""
    focus = np.argsort(-np.abs(queries), axis=1, kind="stable")[:, :FOCUS]
    cosines = np.take_along_axis(queries, focus, axis=1) / np.where(reach > 0, reach, 1.0)[:, None]
    for low in range(0, len(points), BUCKET):
        bucket = slice(low, low + BUCKET)
        scale, wanted = reach * length[low], best.floor.astype(np.float64)
        # The cosine that a vector of the bucket's largest length needs to reach the floor.
        local = np.where(wanted <= 0, -1.0, np.inf)
        np.divide(wanted, scale, out=local, where=(scale > 0) & (wanted > 0))
        live = local <= 1 + SLACK
        if not live.any():
            return  # all later vectors are shorter
        by_coordinate = np.flatnonzero(live & (local >= COORDINATE_FROM))
        by_length = np.flatnonzero(live & (local < COORDINATE_FROM))
        if len(by_length):
            needed = np.where(wanted[by_length] > 0, wanted[by_length] / np.maximum(reach[by_length], 1e-300), 0.0)
            longest = int(np.searchsorted(-length[bucket], -needed.min() * (1 - SLACK), side="right"))
            products = (queries[by_length] @ points[low : low + longest].T).astype(np.int64)
            rows, places = np.nonzero(products >= best.floor[by_length][:, None])
            _keep(best, by_length[rows], places + low, products[rows, places], own, at)
        if len(by_coordinate):
            rows, places = _feasible(local[by_coordinate], cosines[by_coordinate], focus[by_coordinate], units[bucket])
            rows, places = by_coordinate[rows], places + low
            products = np.zeros(len(rows), dtype=np.int64)
            for some in range(0, len(rows), 1 << 15):
                pick = slice(some, some + (1 << 15))
                products[pick] = np.einsum("ij,ij->i", queries[rows[pick]], points[places[pick]])
            good = products >= best.floor[rows]
            _keep(best, rows[good], places[good], products[good], own, at)


def _feasible(local, cosines, focus, units) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs whose focus coordinates allow a cosine of ``local``.

    The angle between a vector and an axis differs from that between the query
    and the axis by at most the angle that the threshold allows.
    """
    allowed = np.arccos(np.clip(local, -1.0, 1.0))[:, None]
    angles = np.arccos(np.clip(cosines, -1.0, 1.0))
    lowest = np.cos(np.minimum(angles + allowed, np.pi)) - SLACK
    highest = np.cos(np.maximum(angles - allowed, 0.0)) + SLACK
    columns = units.T
    fits = np.ones((len(local), len(units)), dtype=bool)
    for k in range(focus.shape[1]):
        values = columns[focus[:, k]]
        fits &= (values >= lowest[:, k : k + 1]) & (values <= highest[:, k : k + 1])
    return np.nonzero(fits)


def _keep(best, rows, places, products, own, at) -> None:
    other = own[rows] != at[places]
    best.add(rows[other], places[other], products[other])


_FOUND = "query long, query_id long, at long, vec_id long, score long"
_TILE = ["dim", "block", "chunk"]


def _compared(queries: DataFrame, candidates: DataFrame, top: int) -> DataFrame:
    """The best products inside each tile, a block of queries against a chunk of candidates."""
    tiles = queries.select(*_TILE).distinct()
    asked = queries.select(*_TILE, F.lit(True).alias("asks"), "at", "vec_id", "vec", "floor")
    met = candidates.join(tiles, ["dim", "chunk"]).select(
        *_TILE, F.lit(False).alias("asks"), "at", "vec_id", "vec", F.lit(None).cast("long").alias("floor")
    )

    def compare(group: pa.RecordBatch) -> pa.RecordBatch | None:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        if not len(group) or asks.all() or not asks.any():
            return None
        vectors = whole_matrix(group.column("vec"), group.column("dim")[0].as_py())
        at, ids = group.column("at").to_numpy(), group.column("vec_id")
        keys = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        floor = group.column("floor").fill_null(_LOWEST).to_numpy()
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        rows, places, found = best_products(
            vectors[left], at[left], floor[left], vectors[right], at[right], keys[right], top
        )
        rows, places = left[rows], right[places]
        columns = [pa.array(at[rows]), ids.take(pa.array(rows)), pa.array(at[places]), ids.take(pa.array(places))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=[f.split()[0] for f in _FOUND.split(", ")])

    return map_groups(asked.unionByName(met), _TILE, compare, _FOUND)


def top_products(
    vectors: DataFrame,
    queries: Column | None = None,
    top: int = TOP,
    factor: int = FACTOR,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``top`` rows of the highest inner products with each query row, by norm-bucketed retrieval.

    ``queries`` is the condition that makes a row a query (an id divisible by 20
    unless given).  Components become ``floor(factor * x)``.

    1. All vectors are ordered by length, by sampled ranges, and cut into chunks
       of like length.
    2. Blocks of queries meet the chunk of the longest vectors.  A query's
       ``top``-th product is its floor from then on.
    3. A query meets a further chunk only if its floor can be reached there:
       floor <= its length x the chunk's largest length.
    4. In a tile the chunk is cut into buckets.  The floor over both lengths is
       the local cosine threshold of a query and a bucket: above 1 the bucket is
       left out; from :data:`COORDINATE_FROM` on vectors are pruned by the ranges
       that it allows for the query's largest coordinates, below by length.  What
       is left is verified by exact products, and the floors rise.
    5. The best of all tiles are merged.

    Blocks and chunks are bounded in components, so no task holds more than one
    block and one chunk, and equal vectors are spread over chunks like others.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``, fewer rows where there
    are fewer candidates.  Equal scores are ordered by smaller id, null ids last.
    Vectors that are null or hold null or non-finite components take no part;
    vectors are compared with those of their own length only, and those without
    components have products of 0.  A null id is a candidate but no query.
    Repeated rows are candidates and queries of their own.  Magnitudes above 2^27
    (less beyond 64 components) count as that.  Other columns are ignored; an
    empty table gives an empty result.
    """
    if top < 1:
        raise ValueError("a query needs at least one result")
    wanted = F.col(id_col) % 20 == 0 if queries is None else queries
    named = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.coalesce(wanted, F.lit(False)).alias("asks"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    )
    whole = named.where(finite_vector(F.col("vec"))).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", (F.col("asks") & F.col("vec_id").isNotNull()).alias("asks"),
        F.size("vec").alias("dim"), whole_components(F.col("vec"), factor).alias("vec"),
    )
    square = F.aggregate("vec", F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x)
    rows = stored(whole.withColumn("square", square), "vectors")
    width = F.greatest(F.col("dim"), F.lit(1))
    chunk_rows = F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(CHUNK_CELLS) / width))
    block_rows = F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(QUERY_CELLS) / width))
    placed = number_rows(rows, [F.asc("dim"), F.desc("square"), F.asc("row")], "at").withColumn(
        "chunk", F.floor(F.col("at") / chunk_rows)
    )
    longest = placed.groupBy("dim", "chunk").agg(F.max("square").alias("longest"))
    dims = placed.groupBy("dim").agg(
        F.min("chunk").alias("first"), F.max("chunk").alias("last"), F.count_if("asks").alias("queries")
    )
    asking = join_many_to_one(placed.where("asks").drop("chunk", "row"), dims, ["dim"], rows="queries")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("queries") / block_rows))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("at"), blocks))
    candidates = placed.select("dim", "chunk", "at", "vec_id", "vec")

    opening = asking.withColumn("chunk", F.col("first")).withColumn("floor", F.lit(None).cast("long"))
    first = stored(_compared(opening, candidates, top), "first-products")
    floors = first.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= top)
    later = asking.where("last > first").withColumn("chunk", F.explode(F.sequence(F.col("first") + 1, F.col("last"))))
    floored = later.join(floors.select(F.col("query").alias("at"), "floor"), "at", "left").join(longest, ["dim", "chunk"])
    bound = F.sqrt("square") * F.sqrt("longest") * F.lit(1 + SLACK) + F.lit(1.0)
    further = _compared(floored.where(F.col("floor").isNull() | (F.col("floor") <= bound)), candidates, top)

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "at")
    ranked = first.unionByName(further).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
