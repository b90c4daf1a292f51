"""Joins for keys of which one may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A piece of a hot key has about 1/PIECES of all rows, and not fewer than PIECE_ROWS.
PIECES = 10_000
PIECE_ROWS = 20_000


def content_hash(df: DataFrame) -> Column:
    """A hash of the whole row; maps enter as sorted entries."""
    parts = [
        F.sort_array(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    return F.xxhash64(*parts)


def join_many_to_one(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    rows: str | None = None,
    how: str = "inner",
    piece_rows: int | None = None,
) -> DataFrame:
    """Inner or left join of ``many`` rows to the single ``one`` row of their key; nulls match.

    A key with more rows than a piece may have is hot.  Its ``many`` rows are
    split into as many pieces as its count asks for, by a hash of the row and of
    the input partition (so copies of one row are spread too), and its ``one`` row
    is repeated for each piece.  All other keys join once.  ``rows`` names the
    column of ``one`` with the number of ``many`` rows per key; without it the
    rows are counted.  ``piece_rows`` is the least size of a piece, for rows that
    are heavy (:data:`PIECE_ROWS` unless given).  The broadcast set of hot keys has fewer than
    :data:`PIECES` entries whatever the size of the data.
    """
    if rows is None:
        sizes, rows_col = many.groupBy(*keys).agg(F.count("*").alias("_n")), "_n"
    else:
        sizes, rows_col = one, rows
    if how not in ("inner", "left"):
        raise ValueError("the join is inner or left")
    piece_rows = PIECE_ROWS if piece_rows is None else piece_rows
    total = sizes.agg(F.sum(rows_col)).scalar()
    pieces = F.ceil(F.col(rows_col) / F.greatest(total / F.lit(PIECES), F.lit(piece_rows))).cast("int")
    hot = sizes.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], pieces.alias("_pieces")).where("_pieces > 1")

    def mark(df: DataFrame) -> DataFrame:
        same = [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys]
        return df.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{k}" for k in keys])

    marked = mark(many)
    split = F.pmod(F.xxhash64(content_hash(many), F.spark_partition_id()), F.col("_pieces")).cast("int")
    left = marked.withColumn("_salt", F.when(F.col("_pieces").isNotNull(), split).otherwise(0)).drop("_pieces")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    right = mark(one).withColumn("_one_salt", F.explode(copies)).drop("_pieces")
    right = right.withColumnsRenamed({k: f"_one_{k}" for k in keys})
    matching = [left[k].eqNullSafe(right[f"_one_{k}"]) for k in keys]
    matching.append(left["_salt"] == right["_one_salt"])
    return left.join(right, matching, how).drop("_salt", "_one_salt", *[f"_one_{k}" for k in keys])
