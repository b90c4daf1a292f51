"""Writing rewritten logs, with the counts of what changed taken from the same pass."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class ChangeCounts:
    total: int
    changed: int
    unchanged: int


_FIELDS = "total long, changed long, unchanged long"


def write_rewritten(df: DataFrame, flag: str, path: str, format: str = "parquet", keep_flag: bool = False) -> ChangeCounts:
    """Write a flagged transform's rows to a new path and count the changed ones while writing.

    ``flag`` is the transform's column that tells whether a row changed (null: it
    did not); it is left out of the files unless asked for.  The input is read
    once.  A task that is tried again counts once.
    """
    changed, counted = F.coalesce(F.col(flag), F.lit(False)), Observation()
    seen = df.observe(
        counted,
        F.count(F.lit(1)).alias("total"),
        F.count_if(changed).alias("changed"),
        F.count_if(~changed).alias("unchanged"),
    )
    (seen if keep_flag else seen.drop(flag)).write.format(format).save(path)
    found = counted.get
    return ChangeCounts(found["total"], found["changed"], found["unchanged"])


def rewrite_stream(stream: DataFrame, flag: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a flagged transform of a stream below ``path``, with its counts batch by batch.

    Each micro-batch has a folder of its own, replaced as a whole when the batch
    is tried again, so nothing is written or counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, place = batch.sparkSession, f"{path}/batch_id={batch_id}"
        attempt = f"{path}-counts/batch_id={batch_id}"
        counted = Observation()
        changed = F.coalesce(F.col(flag), F.lit(False))
        seen = batch.observe(counted, F.count(F.lit(1)).alias("total"), F.count_if(changed).alias("changed"))
        seen.drop(flag).write.mode("overwrite").parquet(place)
        found = counted.get
        counts = ChangeCounts(found["total"], found["changed"], found["total"] - found["changed"])
        spark.createDataFrame([astuple(counts)], _FIELDS).coalesce(1).write.mode("overwrite").parquet(attempt)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    return writer.foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def rewritten_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: total, changed and unchanged rows of all batches of :func:`rewrite_stream`; no rewritten row is read."""
    noted = spark.read.schema(_FIELDS).parquet(f"{path}-counts")
    return noted.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("total", "changed", "unchanged")])
