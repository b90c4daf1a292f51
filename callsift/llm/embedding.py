"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsift.llm.components import connected_components
from callsift.llm.tables import map_groups, stored
from callsift.plans.skew import join_many_to_one

THRESHOLD = 0.98
# Entries of a neighbour list and of the reverse list that joins it.
NEIGHBOURS = 10
# Random-hyperplane tables that give the first lists, rows of a leaf, and of a cell of a component.
TABLES, LEAF_ROWS, TILE_ROWS = 8, 48, 256
# Least size of a piece of a hot label or vector in joins; rows with vectors are heavy.
PIECE_ROWS = 250
# Radians by which cells may be farther apart than rounded angles allow.
SLACK = 1e-6
# Rounds of refinement: at least, at most, and the audited recall that ends them.
LEAST_ROUNDS, MOST_ROUNDS, RECALL = 2, 6, 0.995
# Points that an audit compares with all others, chosen by a hash: half with links found, half without.
AUDIT_POINTS = 256


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square over- or underflows."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Unit vectors of a batch of lists of one length, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(values.reshape(len(column), -1))


def _edges(a: np.ndarray, b: np.ndarray, sims: np.ndarray) -> pa.RecordBatch | None:
    if not len(a):
        return None
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sims)], names=["a", "b", "sim"])


_EDGE = "a long, b long, sim double"


def valid_vector(column: Column) -> Column:
    """Not null, not empty, every component finite, and not all zero."""
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _coded(points: DataFrame) -> DataFrame:
    """The signs of each point on the random hyperplanes of each table.

    A label of n points gets about log2(n / leaf) hyperplanes per table.
    """
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    bits = sizes.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / LEAF_ROWS))).cast("int"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                vectors, digits = _matrix(own.column("vec")), own.column("bits").to_numpy()
                for table in range(TABLES):
                    code = np.zeros(len(vectors), dtype=np.int64)
                    for digit in range(int(digits.max(initial=0))):
                        plane = np.random.default_rng([table, digit, int(dim)]).standard_normal(int(dim))
                        code |= ((vectors @ plane > 0) & (digits > digit)).astype(np.int64) << digit
                    columns = [own.column(c) for c in ("cid", "label", "dim")]
                    columns += [pa.array(np.full(len(code), table, np.int32)), pa.array(code)]
                    yield pa.RecordBatch.from_arrays(columns, names=["cid", "label", "dim", "tab", "code"])

    return stored(
        join_many_to_one(points, bits.select("label", "dim", "bits", "rows"), ["label", "dim"], rows="rows", piece_rows=PIECE_ROWS)
        .select("cid", "label", "dim", "bits", "vec")
        .mapInArrow(codes, "cid long, label string, dim int, tab int, code long"),
        "codes",
    )


_BUCKET = ["label", "dim", "tab", "code"]


def _dealt(coded: DataFrame, *turn: int) -> DataFrame:
    """Points with equal signs, in leaves of bounded size.

    Larger buckets are dealt into leaves by a hash that differs between the
    tables and turns, so the leaves of a dense cluster overlap.
    """
    leaves = coded.groupBy(*_BUCKET).agg(F.count("*").alias("size")).where("size > 1")
    own = F.xxhash64("cid", "tab", *[F.lit(t) for t in turn])
    leaf = F.pmod(own, F.ceil(F.col("size") / LEAF_ROWS)).cast("int")
    return join_many_to_one(coded, leaves, _BUCKET, rows="size").withColumn("leaf", leaf)


def _leaves(points: DataFrame, coded: DataFrame) -> DataFrame:
    """First edges: the nearest entries of each point in its leaves."""

    def compare(group: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, vectors = group.column("cid").to_numpy(), _matrix(group.column("vec"))
        sims = vectors @ vectors.T
        np.fill_diagonal(sims, -2)
        best = np.argsort(-sims, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(ids) - 1)]
        a = np.repeat(np.arange(len(ids)), best.shape[1])
        return _edges(ids[a], ids[best.ravel()], sims[a, best.ravel()])

    # Points join on (label, id) order-free: the id alone identifies them.
    full = _dealt(coded).join(points.select("cid", "vec"), "cid")
    return map_groups(full, [*_BUCKET, "leaf"], compare, _EDGE)


def _named(points: DataFrame, found: DataFrame) -> DataFrame:
    """``cid, label, dim, vec, component, linked``; a point without a link is its own component."""
    return points.join(found, points["cid"] == found["node"], "left").select(
        "cid", "label", "dim", "vec", F.coalesce("component", "cid").alias("component"), F.col("node").isNotNull().alias("linked")
    )


def _bridges(points: DataFrame, coded: DataFrame, found: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Links that leave a component: of each point in each leaf the nearest one.

    A list full of links to its own component has no room for them.
    """

    def compare(group: pa.RecordBatch) -> pa.RecordBatch | None:
        own = group.column("component").to_numpy()
        if (own == own[0]).all():
            return None
        ids, vectors = group.column("cid").to_numpy(), _matrix(group.column("vec"))
        sims = np.where(own[:, None] == own[None, :], -2, vectors @ vectors.T)
        best = sims.argmax(axis=1)
        a = np.flatnonzero(sims[np.arange(len(ids)), best] >= threshold)
        return _edges(ids[a], ids[best[a]], sims[a, best[a]])

    full = _dealt(coded, turn).join(_named(points, found).select("cid", "vec", "component"), "cid")
    return map_groups(full, [*_BUCKET, "leaf"], compare, _EDGE)


def _groups(points: DataFrame, coded: DataFrame, links: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Components of the links, joined by bridges until newly dealt leaves show none."""
    found = stored(connected_components(links), "groups")
    while True:
        bridges = stored(_bridges(points, coded, found, threshold, turn), "bridges")
        if bridges.isEmpty():
            return found
        edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = stored(connected_components(edges.unionByName(bridges.select("a", "b"))), "groups")
        turn += 1


def _best(edges: DataFrame, by: str = "a") -> DataFrame:
    """The :data:`NEIGHBOURS` nearest entries of each list; ties by a hash, so no point is preferred."""
    order = Window.partitionBy(by).orderBy(F.desc("sim"), F.xxhash64("a", "b"))
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEIGHBOURS).drop("rank")


def _refine(points: DataFrame, lists: DataFrame, fresh: DataFrame) -> DataFrame:
    """One round: the neighbours (forward and reverse) of each point are compared with each other.

    Only points whose list has a new entry are centres.  A pair is returned where
    it is better than the worst entry of one's list.
    """
    worst = lists.groupBy("a").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    floor = F.when(F.col("n") >= NEIGHBOURS, F.col("worst")).otherwise(-2.0)
    state = points.join(worst, points["cid"] == worst["a"], "left").select(
        "cid", "vec", F.coalesce(floor, F.lit(-2.0)).alias("floor")
    )
    forward = lists.select(F.col("a").alias("centre"), F.col("b").alias("cid"))
    reverse = _best(lists, "b").select(F.col("b").alias("centre"), F.col("a").alias("cid"))
    around = forward.unionByName(reverse).distinct()
    moved = fresh.select(F.col("a").alias("centre")).unionByName(fresh.select(F.col("b").alias("centre"))).distinct()
    around = around.join(moved, "centre", "left_semi")

    def compare(group: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, vectors = group.column("cid").to_numpy(), _matrix(group.column("vec"))
        sims = vectors @ vectors.T
        np.fill_diagonal(sims, -2)
        a, b = np.nonzero(sims > group.column("floor").to_numpy()[:, None])
        return _edges(ids[a], ids[b], sims[a, b])

    return map_groups(around.join(state, "cid"), ["centre"], compare, _EDGE)


def _audit(points: DataFrame, counted: DataFrame, threshold: float) -> float:
    """Share of the links of a bounded set of points that were counted, link by link.

    The points are compared with all others of their label.  Half of them have
    links and half have none; both halves count by the number of points they
    stand for.
    """
    named = points.join(counted, "cid", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    sums = named.agg(F.count_if(F.col("links") > 0), F.count("*")).first()
    chosen, weights = [], {}
    for kind, of in ((F.col("links") > 0, sums[0]), (F.col("links") == 0, sums[1] - sums[0])):
        half = named.where(kind).orderBy(F.xxhash64("cid"), "cid").limit(AUDIT_POINTS // 2)
        rows = half.select("cid", "label", "vec", "links").collect()
        weights |= {row["cid"]: of / len(rows) for row in rows}
        chosen += rows
    groups: dict[tuple[str, int], list] = {}
    for row in chosen:
        groups.setdefault((row["label"], len(row["vec"])), []).append((row["cid"], row["vec"]))
    ready = {}
    for key, rows in groups.items():
        ids, vectors = zip(*rows, strict=True)
        ready[key] = np.array(ids), unit_rows(np.array(vectors, dtype=np.float64))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            dims, cids, copies = (batch.column(c).to_numpy() for c in ("dim", "cid", "copies"))
            for key, (ids, matrix) in ready.items():
                own = np.flatnonzero((labels == key[0]) & (dims == key[1]))
                if len(own):
                    true = _matrix(batch.column("vec").take(pa.array(own))) @ matrix.T >= threshold
                    true &= cids[own][:, None] != ids[None, :]
                    columns = [pa.array(ids), pa.array(copies[own] @ true)]
                    yield pa.RecordBatch.from_arrays(columns, names=["cid", "true"])

    met = points.select("cid", "label", "dim", "vec", "copies").mapInArrow(compare, "cid long, true long")
    true = {r["cid"]: r["true"] for r in met.groupBy("cid").agg(F.sum("true").alias("true")).collect()}
    all_links = sum(weights[cid] * n for cid, n in true.items())
    return sum(weights[r["cid"]] * r["links"] for r in chosen) / all_links if all_links else 1.0


def _linked_copies(a: np.ndarray, b: np.ndarray, copies: np.ndarray, threshold: float, same: bool = False) -> np.ndarray:
    """For each row of ``a``, the copies of the rows of ``b`` it is linked to; ``same``: the sides are one."""
    links = a @ b.T >= threshold
    if same:
        np.fill_diagonal(links, False)
    return links @ copies


def _cells(large: DataFrame, points: DataFrame, coded: DataFrame, full: DataFrame) -> DataFrame:
    """``component, cell, cid, full, dense, centre, radius``: components in cells of at most about :data:`TILE_ROWS`.

    A cell holds points with equal signs on as many hyperplanes as the size of
    the component asks for.  Its number is its smallest point, whose row alone
    has the centre, the largest angle to it and whether any point is full.
    """
    bits = F.ceil(F.log2(F.col("members") / TILE_ROWS)).cast("int")
    code = F.col("code").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    signs = coded.where("tab = 0").select("cid", "code")
    sided = large.join(signs, "cid").select("component", "cid", code.alias("side"))
    sizes = sided.groupBy("component", "side").agg(F.count("*").alias("size"))
    dealt = join_many_to_one(sided, sizes, ["component", "side"], rows="size", piece_rows=PIECE_ROWS)
    leaf = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / TILE_ROWS)).cast("int")
    vectors = dealt.withColumn("leaf", leaf).join(points.select("cid", "vec"), "cid").join(full, "cid", "left")

    def enclose(group: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = group.column("cid").to_numpy(), _matrix(group.column("vec"))
        marked = group.column("full").is_valid()
        middle = rows.mean(axis=0)
        centre = unit_rows((middle if middle.any() else rows[0])[None, :])[0]
        radius = float(np.arccos(np.clip(rows @ centre, -1, 1)).max())
        first, n = int(ids.argmin()), len(ids)

        def once(value, kind: pa.DataType) -> pa.Array:
            return pa.array([value if at == first else None for at in range(n)], kind)

        columns = {
            "component": group.column("component"), "cell": pa.array(np.full(n, ids[first])), "cid": group.column("cid"),
            "full": marked, "dense": once(bool(pc.any(marked).as_py()), pa.bool_()),
            "centre": once(centre.tolist(), pa.list_(pa.float64())), "radius": once(radius, pa.float64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    schema = "component long, cell long, cid long, full boolean, dense boolean, centre array<double>, radius double"
    return stored(map_groups(vectors, ["component", "side", "leaf"], enclose, schema), "cells")


def _near_cells(cells: DataFrame, threshold: float) -> DataFrame:
    """``x, y, all_x, all_y``: pairs of cells of a component that may share links of a full point, each pair once.

    By the triangle inequality, linked points lie in cells whose centres are at
    most both radii and the angle of a link apart.  ``all_x`` tells whether all
    points of ``x`` are needed, or only the full ones.
    """
    centres = cells.where("centre is not null").select("component", "cell", "dense", "centre", "radius")
    sizes = centres.groupBy("component").agg(F.count("*").alias("cells"))
    blocks = sizes.withColumn("blocks", F.ceil(F.col("cells") / TILE_ROWS).cast("int"))
    named = join_many_to_one(centres, blocks, ["component"], rows="cells", piece_rows=PIECE_ROWS)
    own = named.withColumn("block", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int"))
    others = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block"]
    tiles = others.select("component", *sides, "cell", "dense", "centre", "radius")
    link = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK

    def near(group: pa.RecordBatch) -> pa.RecordBatch | None:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block, ids, radii = (group.column(c).to_numpy() for c in ("block", "cell", "radius"))
        dense, centres = group.column("dense").to_numpy(zero_copy_only=False), _matrix(group.column("centre"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        angles = np.arccos(np.clip(centres[left] @ centres[right].T, -1, 1))
        close = angles <= radii[left][:, None] + radii[right][None, :] + link
        close &= dense[left][:, None] | dense[right][None, :]
        if i == j:
            close &= np.tri(len(left), dtype=bool)
            np.fill_diagonal(close, dense[left])
        p, q = np.nonzero(close)
        if not len(p):
            return None
        x, y = left[p], right[q]
        columns = [pa.array(ids[x]), pa.array(ids[y]), pa.array(dense[y]), pa.array(dense[x])]
        return pa.RecordBatch.from_arrays(columns, names=["x", "y", "all_x", "all_y"])

    return map_groups(tiles, ["component", "i", "j"], near, "x long, y long, all_x boolean, all_y boolean")


def _full_counts(points: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """``cid, links`` of the full points: their lists, enlarged to all cells in reach, and counted."""
    pairs = stored(_near_cells(cells, threshold), "pairs")
    first = pairs.select("x", "y", F.col("x").alias("cell"), F.col("all_x").alias("every"))
    second = pairs.where("x <> y").select("x", "y", F.col("y").alias("cell"), F.col("all_y").alias("every"))
    wanted = first.unionByName(second).join(cells.select("cell", "cid", "full"), "cell").where("every or full")
    tiles = wanted.select("x", "y", "cell", "cid", "full").join(points.select("cid", "copies", "vec"), "cid")

    def count(group: pa.RecordBatch) -> pa.RecordBatch:
        cell, copies = group.column("cell").to_numpy(), group.column("copies").to_numpy()
        marked, vectors = group.column("full").to_numpy(zero_copy_only=False), _matrix(group.column("vec"))
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        left, right = np.flatnonzero(cell == x), np.flatnonzero(cell == y)
        totals = np.zeros(len(cell), dtype=np.int64)
        totals[left] = _linked_copies(vectors[left], vectors[right], copies[right], threshold, x == y)
        if x != y:
            totals[right] = _linked_copies(vectors[right], vectors[left], copies[left], threshold)
        asked = pa.array(np.flatnonzero(marked))
        return pa.RecordBatch.from_arrays([group.column("cid").take(asked), pa.array(totals[marked])], names=["cid", "links"])

    counted = map_groups(tiles, ["x", "y"], count, "cid long, links long")
    return counted.groupBy("cid").agg(F.sum("links").alias("links"))


def _link_counts(points: DataFrame, coded: DataFrame, lists: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """``cid, links``: vectors linked to each point with links, copies counted.

    A component of at most :data:`TILE_ROWS` points is one group and compared
    whole.  In larger ones, a point whose list holds an entry below the threshold
    has its links in its own list and those that name it.  A full list, of links
    only, is enlarged: see :func:`_full_counts`.
    """
    sizes = found.groupBy("component").agg(F.count("*").alias("members"))
    named = stored(
        join_many_to_one(found, sizes, ["component"], rows="members", piece_rows=PIECE_ROWS)
        .select(F.col("node").alias("cid"), "component", "members"),
        "members",
    )

    def count(group: pa.RecordBatch) -> pa.RecordBatch:
        rows = _matrix(group.column("vec"))
        links = _linked_copies(rows, rows, group.column("copies").to_numpy(), threshold, same=True)
        return pa.RecordBatch.from_arrays([group.column("cid"), pa.array(links)], names=["cid", "links"])

    small = named.where(F.col("members") <= TILE_ROWS).join(points.select("cid", "copies", "vec"), "cid")
    whole = map_groups(small.select("component", "cid", "copies", "vec"), ["component"], count, "cid long, links long")

    large = named.where(F.col("members") > TILE_ROWS)
    links = lists.where(F.col("sim") >= threshold).select("a", "b")
    full = links.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= NEIGHBOURS)
    full = full.select(F.col("a").alias("cid"), F.lit(True).alias("full"))
    either = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    open_points = large.select("cid").join(full, "cid", "left_anti")
    own = either.join(open_points, either["a"] == open_points["cid"]).select("cid", "b")
    listed = own.join(points.select(F.col("cid").alias("b"), "copies"), "b").groupBy("cid").agg(F.sum("copies").alias("links"))

    return whole.unionByName(listed).unionByName(_full_counts(points, _cells(large, points, coded, full), threshold))


def embedding_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``threshold``.

    1. Equal vectors of one label form a point with copies.
    2. Random-hyperplane leaves give each point a first neighbour list; NN-descent
       rounds compare neighbours of neighbours and keep the nearest
       :data:`NEIGHBOURS`.
    3. Edges at or above the threshold stay; their components are found.  Lists
       full of links hide links to other components: leaves dealt anew look only
       for these, until there are none.
    4. Links are taken from the lists.  A saturated list (of links only) is
       enlarged to the cells of its component that can hold a link, by the
       triangle inequality on angles, and counted there; so is every list of a
       component that fits one group.
    5. An audit compares :data:`AUDIT_POINTS` points with all others, link by
       link; below a recall of :data:`RECALL` another round follows.  A recall
       below it after :data:`MOST_ROUNDS` is an error.

    Labels are equal if they are equal as text.  Returns one row per input row: ``vec_id, n_links, component_id, kept``.
    Vectors that are null, empty, zero or hold null or non-finite components,
    null labels and null ids link with nothing (a null id has a null component
    and is kept).  Vectors of different length do not link.  Repeated rows are
    separate vectors and link with each other.  Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = stored(
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(label_col).cast("string").alias("label"),
            F.col(vector_col).cast("array<double>").alias("vec"),
        ).withColumn("fit", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid_vector(F.col("vec"))),
        "vectors",
    )
    able = rows.where("fit").drop("fit")
    points = stored(
        able.groupBy("label", "vec").agg(F.min("row").alias("cid"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("vec")),
        "points",
    )
    coded = _coded(points)
    lists = stored(_best(_leaves(points, coded).distinct()), "lists")
    fresh, done, found = lists, 0, None
    while True:
        if done >= LEAST_ROUNDS:
            links = lists.where(F.col("sim") >= threshold).select("a", "b")
            if found is not None:
                links = links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            found = _groups(points, coded, links, threshold, done)
            counted = stored(_link_counts(points, coded, lists, found, threshold), "counts")
            recall = _audit(points, counted, threshold)
            if recall >= RECALL:
                break
            if done >= MOST_ROUNDS:
                raise RuntimeError(f"recall {recall:.4f} of links is below {RECALL} after {done} rounds")
        better = _refine(points, lists, fresh).groupBy("a", "b").agg(F.max("sim").alias("sim"))
        both = lists.withColumn("old", F.lit(1)).unionByName(better.withColumn("old", F.lit(0)))
        merged = both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
        marked = stored(_best(merged), "lists")
        lists, fresh, done = marked.drop("old"), marked.where("old = 0"), done + 1

    # Points without a link stay out of the joins by component.
    grouped = points.join(found, points["cid"] == found["node"])
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_many_to_one(found, least, ["component"], rows="members", piece_rows=PIECE_ROWS).select(
        F.col("node").alias("cid"), "component_id"
    )
    decided = (
        points.select("label", "vec", "cid", "least", "copies")
        .join(named, "cid", "left").join(counted, "cid", "left")
        .select(
            "label", "vec", "copies",
            F.coalesce("component_id", "least").alias("component_id"),
            (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"),
        )
    )
    result = ["vec_id", "n_links", "component_id"]
    linked = join_many_to_one(able, decided, ["label", "vec"], rows="copies", piece_rows=PIECE_ROWS).select(*result)
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
