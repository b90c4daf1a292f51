"""Notes on requests: a table (record_id, idx, note, author)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.plans.ordering import with_group_position
from callsift.plans.scratch import materialize
from callsift.plans.skew import join_many_to_one

# Fixed value.
DEFAULT_AUTHOR = "user"


def annotate_existing(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """The new notes whose request is in the log, with the default author filled in."""
    if "author" not in notes.columns:
        notes = notes.withColumn("author", F.lit(None).cast("string"))
    ids = requests.select(F.col("id").alias("record_id"))
    known = ids.join(annotated_ids(notes), "record_id", "left_semi").distinct()
    return join_many_to_one(notes, known, ["record_id"]).withColumn(
        "author", F.coalesce("author", F.lit(DEFAULT_AUTHOR))
    )


def annotations_listing(requests: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every request with its notes; requests without any appear once with nulls."""
    heads = requests.select(F.col("id").alias("record_id"), "method", "path")
    noted = join_many_to_one(
        annotations.select("record_id", "idx", "note", "author"), heads, ["record_id"]
    ).select("record_id", "method", "path", "idx", "note", "author")
    bare = heads.join(annotated_ids(annotations), "record_id", "left_anti")
    return noted.unionByName(bare, allowMissingColumns=True)


def annotated_ids(annotations: DataFrame) -> DataFrame:
    return annotations.select("record_id").distinct()


def remove_annotations(annotations: DataFrame, removals: DataFrame) -> DataFrame:
    """Drop the notes at the given (record_id, idx) positions; later ones move up.

    Positions count from 0 within the record; positions that do not exist are
    ignored.
    """
    placed = with_group_position(annotations, ["record_id"], ["idx"], "_place")
    gone = removals.select("record_id", F.col("idx").cast("bigint").alias("_place")).distinct()
    left = materialize(placed.join(gone, ["record_id", "_place"], "left_anti").drop("_place"))
    return with_group_position(left, ["record_id"], ["idx"], "_idx").drop("idx").withColumnRenamed(
        "_idx", "idx"
    )
