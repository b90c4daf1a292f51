"""Input order, and row numbers that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsift.plans.skew import content_hash, join_many_to_one

# Rows per block when a global neighbour is looked up inside blocks.
BLOCK_ROWS = 100_000
# Session setting for what the row index keeps while it counts rows.
INDEX_CACHE = "pandas_on_Spark.compute.default_index_cache"
# Largest row count that is taken with a top-k (merged in one task).
TOP_K_ROWS = 10_000


def input_order(df: DataFrame, order_cols: Sequence[str] | None = None) -> list[str]:
    """Columns that stand for the position in the log: ``seq``, then ``timestamp`` and ``id``.

    A captured log has a ``seq`` column of nulls, so it is ordered by time and
    id.  Among rows equal in all of them, first and last are arbitrary.
    """
    if order_cols:
        return list(order_cols)
    return [c for c in ("seq", "timestamp", "id") if c in df.columns]


def time_order(df: DataFrame, order_cols: Sequence[str] | None = None) -> list[str]:
    """Chronological order, ties in input order."""
    ties = [c for c in input_order(df, order_cols) if c != "timestamp"]
    return ["timestamp", *ties]


def with_row_index(df: DataFrame, order: Sequence[Column | str], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of every row in the given total order.

    The global sort range-partitions on sampled keys, so equal-sized ranges go
    to the tasks however the keys are spread; the index is then attached inside
    the JVM from the row counts of the ranges.  No window over all rows.
    Counting the ranges re-reads the shuffle; it does not cache the sorted rows
    unless the session asks for that.  The session's setting is left as it was.
    """
    conf = df.sparkSession.conf
    given = conf.get(INDEX_CACHE, None)
    if given is None:
        conf.set(INDEX_CACHE, '"NONE"')
    try:
        return df.orderBy(*order).pandas_api().to_spark(index_col=name)
    finally:
        if given is None:
            conf.unset(INDEX_CACHE)


def rows_between(df: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    """Rows at the positions ``start`` to ``stop - 1`` of an order, with their position as ``_at``.

    Positions are found on the order columns alone; then a comparison with the
    first and the last key picks whole rows, and only these are ranked.
    """
    key = F.struct(*order)
    narrow = df.select(*order)
    wanted = with_row_index(narrow, order, "_at").where((F.col("_at") >= start) & (F.col("_at") < stop))
    ends = wanted.agg(F.struct(F.min(key).alias("low"), F.max(key).alias("high")).alias("ends")).scalar()
    before = narrow.where(key < ends["low"]).agg(F.count("*")).scalar()
    near = df.where((key >= ends["low"]) & (key <= ends["high"]))
    placed = with_row_index(near, order, "_near").withColumn("_at", F.col("_near") + before).drop("_near")
    return placed.where((F.col("_at") >= start) & (F.col("_at") < stop))


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of an order: a top-k when small, else an index range."""
    if n <= TOP_K_ROWS:
        return df.orderBy(*order).limit(n)
    return with_row_index(df, order, "_at").where(F.col("_at") < n).drop("_at")


def with_group_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """0-based position of each row inside its group, safe for a group of any size.

    Rows sorted by keys and order hold every group in one contiguous range, so
    the position is the global index minus the smallest index of the group.
    """
    indexed = with_row_index(df, [*keys, *order], "_at")
    starts = indexed.groupBy(*keys).agg(F.min("_at").alias("_start"), F.count("*").alias("_rows"))
    return (
        join_many_to_one(indexed, starts, keys, rows="_rows")
        .withColumn(name, F.col("_at") - F.col("_start"))
        .drop("_at", "_start", "_rows")
    )


def with_previous(df: DataFrame, column: str, order: Sequence[str], name: str) -> DataFrame:
    """Add the value ``column`` has in the preceding row of the given order.

    The lag runs inside blocks of :data:`BLOCK_ROWS` rows.  The last row of each
    block is copied to the front of the next one, where it only serves as the
    predecessor and is dropped again.
    """
    at, block = F.col("_at"), F.col("_block")
    own = F.floor(at / BLOCK_ROWS)
    last = at % BLOCK_ROWS == BLOCK_ROWS - 1
    blocks = with_row_index(df, order, "_at").withColumn(
        "_block", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    before = F.lag(column).over(Window.partitionBy("_block").orderBy("_at"))
    return blocks.withColumn(name, before).where(block == own).drop("_at", "_block")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One whole row per key: the first in the order.

    Rank-equals-one over a partitioned window lets Spark keep only the best row
    of each key before the shuffle, so a hot key sends one row per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def first_per_key_marked(df: DataFrame, keys: Sequence[str], wanted: str, name: str) -> DataFrame:
    """Add whether a row is among the ``wanted`` (a column) first of its key, for rows that rank alike.

    Rows are numbered per key and input partition first; only those that could
    be among the first then compete, so the rows of a hot key stay spread over
    as many groups as there are input partitions.
    """
    parts = df.withColumn("_hash", content_hash(df)).withColumn("_part", F.spark_partition_id())
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_hash"))
    led = parts.withColumn("_local", local).withColumn(
        "_heat", F.when(F.col("_local") <= F.col(wanted), -1).otherwise(F.col("_part"))
    )
    final = F.row_number().over(Window.partitionBy(*keys, "_heat").orderBy("_hash", "_part"))
    first = (F.col("_heat") == -1) & (F.col("_final") <= F.col(wanted))
    return led.withColumn("_final", final).withColumn(name, first).drop("_hash", "_part", "_local", "_heat", "_final")


def all_but_one(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows except one of each key, the one with the smallest content hash per part.

    Rows are numbered per key and input partition first; then only the leading
    row of each partition competes to be the one left out.  So the rows of a hot
    key stay spread over as many groups as there are input partitions.  Ordering
    by content makes a re-run task choose alike; equal rows are interchangeable.
    """
    parts = df.withColumn("_hash", content_hash(df)).withColumn("_part", F.spark_partition_id())
    local = Window.partitionBy(*keys, "_part").orderBy("_hash")
    led = parts.withColumn("_local", F.row_number().over(local)).withColumn(
        "_heat", F.when(F.col("_local") == 1, -1).otherwise(F.col("_part"))
    )
    final = Window.partitionBy(*keys, "_heat").orderBy("_hash", "_part")
    chosen = (F.col("_heat") == -1) & (F.col("_final") == 1)
    numbered = led.withColumn("_final", F.row_number().over(final))
    return numbered.where(~chosen).drop("_hash", "_part", "_local", "_heat", "_final")
