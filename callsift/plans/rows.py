"""Turning arrays into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_structs(
    df: DataFrame, keep: Sequence[Column | str], array: Column | str, position: str | None = None
) -> DataFrame:
    """One row per array element: the ``keep`` columns and the fields of the element.

    A plain explode makes Spark pre-filter on the size of the array, which
    computes the array, Python calls included, a second time.  The outer form
    does not; its rows for empty arrays are dropped afterwards.
    """
    items = F.col(array) if isinstance(array, str) else array
    exploded = df.select(*keep, F.posexplode_outer(items).alias("_position", "_item"))
    named = [F.col("_position").alias(position)] if position else []
    kept = [c for c in exploded.columns if c not in ("_position", "_item")]
    return exploded.where(F.col("_item").isNotNull()).select(*kept, *named, "_item.*")
