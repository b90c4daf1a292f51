"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.components import connected_components
from callsift.llm.tables import map_groups, stored
from callsift.llm.text import Words, gram_hashes, mix, text_blocks
from callsift.plans.skew import join_many_to_one

SHINGLE_WORDS = 5
# Links: percent * union <= 100 * intersection; the percentage unless another is given.
PERCENT = 85
# 2 ** BUCKET_BITS registers of 16 bits (6 leading-zero count, MANTISSA_BITS mantissa), in bands.
BUCKET_BITS, MANTISSA_BITS, BAND_ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND_ROWS
# Classes, and shingles, that one side of a tile has about.
TILE_CLASSES, TILE_SHINGLES = 256, 500_000
# Deviations of the estimate below the threshold at which a pair is still verified.
SIGMAS = 6.0
# Expected share of equal registers of disjoint sets of equal size, times 2 ** MANTISSA_BITS (fixed value).
COLLISIONS = 0.1699

_PROBES = np.array([np.random.default_rng(bucket).permutation(BUCKETS) for bucket in range(BUCKETS)])


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: empty without words."""
    for _, data, offsets in text_blocks(texts):
        words = Words(data, offsets, lower=True)
        hashes = words.hashes()
        grams = gram_hashes(hashes, SHINGLE_WORDS)
        for at in range(len(offsets) - 1):
            first, last = words.first[at], words.first[at + 1]
            count = last - first
            if count >= SHINGLE_WORDS:
                yield np.unique(grams[first : last - SHINGLE_WORDS + 1])
            else:
                yield gram_hashes(hashes[first:last], count) if count else np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set of hashes.

    The first bits of a hash choose the bucket; its register keeps the leading
    zeros of the smallest rest and the bits after the first one.  An empty
    bucket takes the register of the first filled bucket on its probe list, so
    small sets fill all bands.
    """
    registers = np.zeros(BUCKETS, dtype=np.uint16)
    if not len(hashes):
        return registers
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    starts = np.searchsorted(bucket, np.arange(BUCKETS))
    filled = np.bincount(bucket, minlength=BUCKETS) > 0
    rest = hashes[starts[filled]] << np.uint64(BUCKET_BITS)
    top = (rest >> np.uint64(11)).astype(np.float64)
    zeros = np.minimum(53 - np.frexp(top)[1], 53).astype(np.uint64)
    after = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    registers[filled] = (zeros << np.uint64(MANTISSA_BITS) | after).astype(np.uint16)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        donors = _PROBES[empty, np.argmax(filled[_PROBES[empty]], axis=1)]
        registers[empty] = registers[donors]
    return registers


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of all pairs of two lists of sketches, corrected for chance collisions."""
    equal = np.empty((len(a), len(b)))
    for at in range(len(a)):
        equal[at] = (a[at] == b).mean(axis=1)
    sizes = n_a[:, None] + n_b[None, :]
    chance = COLLISIONS / (1 << MANTISSA_BITS) * 4 * (n_a[:, None] / sizes) * (n_b[None, :] / sizes)
    return (equal - chance) / (1 - chance)


def possible(
    a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs need verification, their estimates).

    The sizes must allow the similarity, and the estimate may lie
    :data:`SIGMAS` standard deviations below the threshold; small sets fill few
    buckets, so their deviation is taken larger.
    """
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    guess = estimate(a, b, n_a, n_b)
    least = np.minimum(n_a[:, None], n_b[None, :])
    level = percent / 100
    drawn = BUCKETS * -np.expm1(-least / BUCKETS)
    floor = level - SIGMAS * np.sqrt(level * (1 - level) / np.maximum(drawn, 1))
    fits = 100 * least >= percent * np.maximum(n_a[:, None], n_b[None, :])
    return fits & (guess >= floor), guess


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, one, two, registers = [], [], [], []
        for hashes in shingle_sets(batch.column("text")):
            sizes.append(len(hashes))
            one.append(int(mix(hashes).sum(dtype=np.uint64).astype(np.int64)))
            two.append(int(mix(~hashes).sum(dtype=np.uint64).astype(np.int64)))
            registers.append(sketch(hashes).tobytes())
        columns = [pa.array(v, pa.int64()) for v in (sizes, one, two)]
        arrays = [batch.column("doc_id"), batch.column("mark"), *columns, pa.array(registers, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "n", "set1", "set2", "registers"])


def _sides(blocks: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides of a tile; a diagonal tile has the same rows on both."""
    return np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)


def _components(group: pa.RecordBatch) -> np.ndarray:
    """The component of each row of a tile: as found before, else its own id, or the hub where it is held by it."""
    if "component" in group.schema.names:
        return group.column("component").to_numpy()
    own = group.column("class_id").to_numpy()
    if "held" not in group.schema.names:
        return own
    return np.where(group.column("held").to_numpy(zero_copy_only=False), group.column("hub").to_numpy(), own)


def _survivors(group: pa.RecordBatch, percent: int) -> pa.RecordBatch | None:
    """The rows of a tile that have a possible partner of another component in it."""
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left, right = _sides(group.column("block").to_numpy(), i, j)
    registers = np.frombuffer(b"".join(group.column("registers").to_pylist()), dtype=np.uint16)
    registers, n = registers.reshape(-1, BUCKETS), group.column("n").to_numpy()
    of = _components(group)
    maybe, _ = possible(registers[left], registers[right], n[left], n[right], percent)
    maybe &= of[left][:, None] != of[right]
    keep = np.union1d(left[maybe.any(axis=1)], right[maybe.any(axis=0)])
    return group.take(pa.array(keep)).select(_TILE) if len(keep) else None


_TILE = ["hub", "i", "j", "block", "component", "class_id", "mark"]
_TILE_SCHEMA = "hub long, i int, j int, block int, component long, class_id long, mark long"


def _verified(group: pa.RecordBatch, percent: int) -> pa.RecordBatch | None:
    """The trees that the links of a tile make between components, checked on the full sets, as stars.

    Pairs come in decreasing order of their estimate; pairs that links found
    before connect are skipped, as they change no component.  Different texts of
    one id are verified each; rows of one component are connected from the
    start.  The centre of a star is its smallest component.
    """
    versions = np.stack([group.column(c).to_numpy() for c in ("class_id", "mark")], axis=1)
    _, once = np.unique(versions, axis=0, return_index=True)
    group = group.take(pa.array(once))
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left, right = _sides(group.column("block").to_numpy(), i, j)
    components, of = np.unique(_components(group), return_inverse=True)
    sets = list(shingle_sets(group.column("text")))
    registers, n = np.array([sketch(s) for s in sets]), np.array([len(s) for s in sets])
    maybe, guess = possible(registers[left], registers[right], n[left], n[right], percent)
    if i == j:
        maybe &= np.tri(len(left), k=-1, dtype=bool)
    maybe &= of[left][:, None] != of[right]
    rows, columns = np.nonzero(maybe)
    order = np.argsort(-guess[rows, columns], kind="stable")
    root, found = list(range(len(components))), False

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left[rows[order]].tolist(), right[columns[order]].tolist(), strict=True):
        p, q = find(int(of[a])), find(int(of[b]))
        if p != q and linked(sets[a], sets[b], percent):
            # Components are in ascending order, so the root of a tree is its smallest.
            root[max(p, q)], found = min(p, q), True
    if not found:
        return None
    centres = np.array([find(at) for at in range(len(components))])
    spokes = np.flatnonzero(centres != np.arange(len(components)))
    columns = [np.full(len(spokes), group.column("hub")[0].as_py(), np.int64), components[centres[spokes]], components[spokes]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hub", "a", "b"])


def _blocks(rows: Column, shingles: Column) -> Column:
    """Blocks that a side of a tile needs for so many classes and shingles, none for no class."""
    return F.ceil(F.greatest(rows / TILE_CLASSES, shingles / TILE_SHINGLES)).cast("int")


def _first_tiles(families: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every family in blocks, with its hub in each of them: a row per class, and one per block for the hub."""
    blocks = families.join(sizes, "class_id").groupBy("hub").agg(
        F.count("*").alias("members"), _blocks(F.count("*"), F.sum("n")).alias("blocks")
    )
    blocks = stored(blocks, "blocks")
    own = F.array(F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = join_many_to_one(families, blocks, ["hub"], rows="members")
    return dealt.withColumn("block", F.explode(F.when(F.col("class_id") == F.col("hub"), every).otherwise(own))).select(
        "hub", F.col("block").alias("i"), F.col("block").alias("j"), "block", F.col("class_id").alias("component"), "class_id", "blocks"
    )


def _rest_tiles(first: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Classes outside the largest component of their family, against the whole family, in tiles of two blocks.

    The members of that component are held: whichever links made it, inside or
    outside the family, they need no comparison with each other.
    """
    members = first.where("blocks > 1").select("hub", "class_id").distinct()
    component = F.coalesce("component", "class_id").alias("component")
    named = members.join(found, members["class_id"] == found["node"], "left").select("hub", "class_id", component)
    named = stored(named, "members")
    parts = named.groupBy("hub", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("hub").agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("best"))
    held = F.col("component") == F.col("best.component")
    marked = join_many_to_one(named, stored(largest, "largest"), ["hub"], rows="members").select(
        "hub", "class_id", "component", held.alias("held")
    )
    marked = stored(marked, "marked")

    def side(of: Column) -> Column:
        return _blocks(F.count_if(of), F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)))

    sides = marked.join(sizes, "class_id").groupBy("hub").agg(
        F.count("*").alias("members"), side(~F.col("held")).alias("rest"), side(F.col("held")).alias("kin")
    )
    dealt = join_many_to_one(marked, stored(sides.where("rest > 0"), "sides"), ["hub"], rows="members")
    hashed = F.xxhash64("class_id")
    block = F.when(F.col("held"), F.col("rest") + F.pmod(hashed, F.col("kin"))).otherwise(F.pmod(hashed, F.col("rest"))).cast("int")
    last = F.when(F.col("held"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("kin") - 1)
    others = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return others.select(
        "hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "component", "class_id"
    )


def _tile_links(tiles: DataFrame, cards: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``hub, a, b``: the links of tiles.  Only classes with a possible partner get their text."""
    keys = ["hub", "i", "j"]
    survivors = stored(
        map_groups(tiles.join(cards, "class_id"), keys, partial(_survivors, percent=percent), _TILE_SCHEMA), "survivors"
    )
    # The same join at every size: what is left of the classes grows with the data.
    read = survivors.hint("merge").join(texts, ["class_id", "mark"]).select(*_TILE, "text")
    return stored(map_groups(read, keys, partial(_verified, percent=percent), "hub long, a long, b long"), "links")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard similarity of ``percent`` or more.

    1. One pass makes a HyperMinHash sketch of each document's full set; equal
       sets form a class, which goes on as one row.
    2. Bands of four compressed registers put classes into buckets.  All buckets
       whose most-copied class is the same hub become one family.
    3. A family is dealt into blocks, each with the hub.  In a block the
       collision-corrected estimates of all pairs sort out what cannot be a
       link, by registers alone; what is left gets its text, for the check on
       the full sets.  No task gets a whole family and no pair is written out.
    4. Each tile returns the stars of its trees, and these make components
       across all families.  Classes of one component are not compared again.
       Only those outside the largest component of their family meet the whole
       family, in tiles of two blocks, by the same two checks.
    5. The links that this finds between components join them; components are
       joined back to the classes' documents.

    A link of the least similarity misses all 32 bands with a chance below
    1e-10 at 85 percent and below 1e-7 at 80.  Hashes of 64 bits stand for shingles; the sets themselves are exact.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``.
    Words are lower-cased in A-Z.  Texts of one to four words have one shingle,
    their whole sequence; null texts and texts without words have none and link
    with nothing.  Rows with a null id link with nothing, have a null component
    and are kept.  Rows that repeat an id share its component and are all kept
    or all dropped.  Other columns are ignored; an empty table gives an empty
    result.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
        F.col(text_col).cast("string").alias("text"),
    )
    schema = "doc_id long, mark long, n long, set1 long, set2 long, registers binary"
    rows = stored(texts.mapInArrow(_sketches, schema), "sketches")
    able = rows.where("n > 0 and doc_id is not null")
    first = F.struct("doc_id", "mark", "registers")
    classes = stored(
        able.groupBy("set1", "set2", "n").agg(F.count("*").alias("copies"), F.min(first).alias("first"))
        .select("set1", "set2", "n", "copies", F.col("first.doc_id").alias("class_id"), "first.mark", "first.registers"),
        "classes",
    )

    band = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda at: F.xxhash64(at, F.substring("registers", at * (2 * BAND_ROWS) + 1, F.lit(2 * BAND_ROWS))),
    )
    bands = classes.select("class_id", "copies", F.explode(band).alias("key"))
    best = F.max(F.struct("copies", (-F.col("class_id")).alias("negative"))).alias("best")
    buckets = bands.groupBy("key").agg(F.count("*").alias("size"), best).where("size > 1")
    hubs = buckets.select("key", (-F.col("best.negative")).alias("hub"))
    families = stored(bands.select("key", "class_id").join(hubs, "key").select("hub", "class_id").distinct(), "families")

    cards, sizes = classes.select("class_id", "mark", "n", "registers"), classes.select("class_id", "n")
    wanted = texts.withColumnRenamed("doc_id", "class_id")
    first = stored(_first_tiles(families, sizes), "tiles")
    to_hubs = _tile_links(first.drop("blocks"), cards, wanted, percent)
    found = connected_components(to_hubs)
    others = _tile_links(_rest_tiles(first, found, sizes), cards, wanted, percent)
    joined = connected_components(others).select(F.col("node").alias("component"), F.col("component").alias("least"))

    part = classes.join(found, classes["class_id"] == found["node"], "left").withColumn(
        "component", F.coalesce("component", "class_id")
    )
    named = part.join(joined, "component", "left").select(
        "set1", "set2", "n", "copies", F.coalesce("least", "component").alias("component_id")
    )
    named = stored(named, "named")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    result = ["doc_id", F.col("n").alias("n_shingles")]
    grouped = join_many_to_one(able.select("doc_id", "set1", "set2", "n"), named, ["set1", "set2", "n"], rows="copies")
    alone = rows.where("n = 0 or doc_id is null")
    return grouped.select(*result, "component_id", kept).unionByName(
        alone.select(*result, F.col("doc_id").alias("component_id")).withColumn("kept", F.lit(True))
    )


def keep_one_per_component(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    percent: int = PERCENT,
) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns.

    ``row_col`` names a column of numbers that tell all rows apart.  With it,
    rows that repeat an id and rows with a null id are documents like all
    others, and exactly one row of each component stays: the one with the
    smallest id, then of the smallest number; a null id stays only where no
    other is.
    """
    if row_col is None:
        found = near_duplicates(docs, id_col, text_col, percent).where(~F.col("kept"))
        return docs.join(found.select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
    found = near_duplicates(docs, row_col, text_col, percent).select(F.col("doc_id").alias("row"), "component_id")
    ids = docs.select(F.col(row_col).cast("long").alias("row"), F.col(id_col).cast("long").alias("id"))
    named = stored(found.join(ids, "row"), "components")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).getField("row").alias("first")
    shared = stored(named.groupBy("component_id").agg(F.count("*").alias("members"), first).where("members > 1"), "shared")
    dropped = join_many_to_one(named, shared, ["component_id"], rows="members").where("row <> first")
    return docs.join(dropped.select(F.col("row").alias(row_col)), row_col, "left_anti")
