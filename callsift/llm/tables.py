"""Intermediate tables, and lookups whose key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.plans.scratch import scratch_path

# White space of the contracts: U+0020 and U+0009 to U+000D (fixed values).
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


# Where :func:`stored` notes the tables it writes, innermost last; see :func:`noting_tables`.
_notes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def noting_tables(notes: list[tuple[SparkSession, str]]) -> Iterator[None]:
    """Note the tables that are written inside in ``notes``, for :func:`delete_tables`."""
    _notes.append(notes)
    try:
        yield
    finally:
        _notes.pop()


def delete_tables(notes: list[tuple[SparkSession, str]]) -> None:
    """Delete the noted tables; call it when the results made from them are written."""
    while notes:
        spark, path = notes.pop()
        if spark.sparkContext._jsc is None:  # a stopped session
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage without a second computation, and a lost executor costs
    nothing: later stages read the files again.
    """
    path = scratch_path(df.sparkSession, label)
    if _notes:
        _notes[-1].append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(text_col: str) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def map_groups(
    df: DataFrame, keys: list[str], function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``function`` to the rows of each group, which must be bounded and have no null key.

    The rows are shuffled by the keys and sorted; one pass over each sorted
    partition cuts it into groups, without a Python call's overhead per group in
    Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            changed = np.zeros(batch.num_rows - 1, dtype=bool)
            for key in keys:
                column = batch.column(key)
                changed |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
            for first, last in zip(starts, starts[1:], strict=False):
                if (made := function(batch.slice(first, last - first))) is not None:
                    yield made
            held = batch.slice(starts[-1])
        if held is not None and (made := function(held)) is not None:
            yield made

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based position of each row in ``order``, whose last column must tell all rows apart.

    Sampled ranges of the order are sorted and written with their position in
    the range; only the sizes of the ranges (one number per shuffle partition)
    go to the driver and come back as offsets.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("__callsift_at", F.monotonically_increasing_id()), "ranges")
    # The identifier holds the partition above 33 bits of the position inside it.
    part, inside = F.shiftright("__callsift_at", 33), F.col("__callsift_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["part"], total))
        total += row["n"]
    offsets = df.sparkSession.createDataFrame(starts, "__callsift_part long, __callsift_start long")
    joined = placed.join(F.broadcast(offsets), part == F.col("__callsift_part"))
    return joined.withColumn(name, F.col("__callsift_start") + inside).drop(
        "__callsift_at", "__callsift_part", "__callsift_start"
    )
