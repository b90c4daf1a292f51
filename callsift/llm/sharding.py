"""Sharding by vector bin packing: bytes, tokens and rows balanced together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsift.llm.tables import WORD, stored, whole_text

# Bytes that a stored row needs besides its text (fixed value of the contract).
ROW_OVERHEAD = 16
# Rows that one sorted piece of a shard has about, when slots are numbered.
SLOT_ROWS = 2048

_DIMENSIONS = ("size", "tokens", "rows")
# Bytes lead, since the law is theirs.
WEIGHTS = (3.0, 1.0, 1.0)


def place(items: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Shard of each item (one row of sizes per dimension), by dot product.

    Items come in decreasing order of their largest share; each goes where the
    dot product of its shares with what is left of the shard's capacity is
    highest, to the first such shard on a tie.  ``weights`` are the dimensions'
    parts in the product.  Shards without room for the item in the first
    dimension are passed over, as long as one has room; else the one with most
    room there takes it.
    """
    totals = items.sum(axis=0, dtype=float)
    shares = items / np.where(totals > 0, totals, 1)
    order = np.lexsort((*(-items[:, d] for d in range(items.shape[1])), -shares.max(axis=1)))
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(items), dtype=np.int64)
    for at in order:
        room = left[:, 0]
        fits = room >= shares[at, 0]
        fitness = np.where(fits, left @ (shares[at] * weights), -np.inf) if fits.any() else room
        best = int(np.argmax(fitness))
        chosen[at] = best
        left[best] -= shares[at]
    return chosen


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    bundles_per_shard: int = 256,
    heavy_per_shard: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Distribute documents over shards of nearly equal bytes, tokens and rows.

    Equal texts form a group and share a shard, unless the group is larger than
    half an average shard in some dimension: then it is cut into pieces of that
    size.  A group with more than ``1 / heavy_per_shard`` of an average shard is
    an item of its own; all others are bundled by a hash of their text into
    ``shards * bundles_per_shard`` items.  So there are fewer than
    ``shards * (bundles_per_shard + 3 * heavy_per_shard + 6)`` items whatever the
    size of the data (18,160 by default): three numbers of each go to the driver,
    which places them one after the other.  The law is ``bytes``.

    Returns one row per input row: ``doc_id, size, text_crc32, law, shard, slot,
    grown_shard`` (always null under this law).  Null counts as the empty text
    (checksum 0).  Slots are numbered by id within pieces of a shard; rows that
    repeat an id or have none are separate rows, numbered in the order read.  Other columns are ignored.
    An empty table gives an empty result.
    """
    text = whole_text(text_col)
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.unhex(F.md5(text)).alias("group"),
        ),
        "shard-rows",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    totals = rows.agg(*sums).first()
    groups = rows.groupBy("group").agg(*sums)
    # In average shards; at most 3 * shards * heavy_per_shard groups exceed 1 / heavy_per_shard.
    share = F.greatest(*[F.col(d) * shards / F.lit(float(totals[d] or 1)) for d in _DIMENSIONS])
    heavy = groups.where(share * heavy_per_shard > 1).select("group", F.ceil(2 * share).alias("pieces"))

    bundle = F.pmod(F.xxhash64("group"), F.lit(shards * bundles_per_shard))
    piece = F.pmod(F.xxhash64("row"), F.col("pieces"))
    itemised = rows.join(F.broadcast(heavy), "group", "left").withColumn(
        "item", F.when(F.col("pieces").isNull(), F.struct(F.lit(None).cast("binary").alias("g"), bundle.alias("n")))
        .otherwise(F.struct(F.col("group").alias("g"), piece.alias("n")))
    )
    items = itemised.groupBy("item").agg(*sums).toPandas().sort_values(
        "item", key=lambda s: s.map(lambda r: (r["g"] or b"", r["n"]))
    )
    spark = docs.sparkSession
    placed = place(items[list(_DIMENSIONS)].to_numpy(dtype=float), shards) if len(items) else []
    schema = "g binary, n long, shard int"
    table = [(i["g"], i["n"], int(s)) for i, s in zip(items["item"], placed, strict=True)]
    plan = spark.createDataFrame(table, schema)
    same = itemised["item"]["g"].eqNullSafe(plan["g"]) & (itemised["item"]["n"] == plan["n"])
    sharded = itemised.join(F.broadcast(plan), same).select("row", "id", "size", "crc", "shard")

    pieces = max(1, -(-(totals["rows"] or 0) // (shards * SLOT_ROWS)))
    cut = sharded.withColumn("cut", F.pmod(F.xxhash64("row"), F.lit(pieces)))
    counts = cut.groupBy("shard", "cut").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "cut", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")).alias("start")
    )
    within = Window.partitionBy("shard", "cut").orderBy("id", "row")
    numbered = cut.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "cut"]).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
