"""Watching a log: every new request once, batches to a consumer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callsift.functions.keys import as_condition
from callsift.plans.errors import errors_as_null
from callsift.plans.ordering import first_rows, input_order
from callsift.sources.log import parse_lines


def stream_log(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A JSON Lines log directory as a stream.

    Only whole new files are seen; writers must add files, not extend them.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_lines(reader.text(path))


def new_records(
    stream: DataFrame, baseline_ids: DataFrame | None = None, watermark: str | None = None
) -> DataFrame:
    """Each request id once, ids of the baseline never.

    Without a watermark every id ever seen is kept as state (use the RocksDB
    state store), so nothing is lost or repeated.  A ``watermark`` such as
    ``"1 day"`` bounds the state for logs whose repeats and late requests come
    within that time; requests later than that are dropped.
    """
    if baseline_ids is not None:
        stream = stream.join(baseline_ids.select("id").distinct(), "id", "left_anti").select(
            *stream.columns
        )
    if watermark is None:
        return stream.dropDuplicates(["id"])
    timed = stream.withColumn("event_time", F.timestamp_micros((F.col("timestamp") * 1e6).cast("bigint")))
    return (
        timed.withWatermark("event_time", watermark)
        .dropDuplicatesWithinWatermark(["id"])
        .drop("event_time")
    )


def watch(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    skip_existing: bool = True,
    errors: list[str] | None = None,
    **trigger,
) -> StreamingQuery:
    """Start a query that hands each micro-batch of new requests to ``on_batch``.

    Given a list of ``errors``, an exception of ``on_batch`` is noted there and the
    watch goes on with the next batch; otherwise it ends the watch.

    With ``skip_existing`` the files present now only fill the seen-id state of
    the checkpoint: one run to the end without output, then the watch goes on
    from there.  That happens once per checkpoint; a restart continues.
    """
    fresh = new_records(stream)

    def ignore(batch: DataFrame, batch_id: int) -> None:
        batch.write.format("noop").mode("overwrite").save()

    if skip_existing and not _started_before(stream.sparkSession, checkpoint):
        _start(fresh, ignore, checkpoint, {"availableNow": True}).awaitTermination()

    def hand_on(batch: DataFrame, batch_id: int) -> None:
        try:
            on_batch(batch, batch_id)
        except Exception as error:
            if errors is None:
                raise
            errors.append(str(error))
            # The seen ids are only kept by a batch that was read to its end.
            ignore(batch, batch_id)

    return _start(fresh, hand_on, checkpoint, trigger or {"processingTime": "1 second"})


def _start(df: DataFrame, sink: Callable, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    return writer.foreachBatch(sink).trigger(**trigger).start()


def _started_before(spark: SparkSession, checkpoint: str) -> bool:
    """Whether the checkpoint has committed a batch already."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*")
    try:
        return not files.load(f"{checkpoint}/commits").select("path").isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


@dataclass
class BatchCounts:
    """What :func:`consume_batches` has handed on, earlier runs of the query included."""

    batches: int = 0
    records: int = 0
    filtered_out: int = 0
    errors: list[str] = field(default_factory=list)


class _Ledger:
    """Totals after each batch, one small file per batch beside the checkpoint.

    A batch that is tried again starts from the totals before it, so it counts
    once; a query that is started again goes on from the totals of its last batch.
    """

    KINDS = "batch_id long, batches long, records long, filtered_out long"

    def __init__(self, spark: SparkSession, checkpoint: str):
        self._spark, self._path = spark, f"{checkpoint.rstrip('/')}-ledger"
        self._last: tuple[int, tuple[int, int, int]] | None = None

    def before(self, batch_id: int) -> tuple[int, int, int]:
        """(batches, records, filtered out) of all batches before this one."""
        if self._last and self._last[0] == batch_id - 1:
            return self._last[1]
        try:
            # No row where the query has handed on nothing yet.
            noted = self._spark.read.schema(self.KINDS).option("recursiveFileLookup", True).parquet(self._path)
            rows = noted.where(F.col("batch_id") < batch_id).orderBy(F.desc("batch_id")).limit(1).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return tuple(rows[0][1:]) if rows else (0, 0, 0)

    def note(self, batch_id: int, totals: tuple[int, int, int]) -> None:
        row = self._spark.createDataFrame([(batch_id, *totals)], self.KINDS).coalesce(1)
        row.write.mode("overwrite").parquet(f"{self._path}/{batch_id}")
        self._last = batch_id, totals


def consume_batches(
    stream: DataFrame,
    consumer: Callable[[DataFrame, int], None],
    checkpoint: str,
    predicate: Column | str | None = None,
    max_records: int | None = None,
    counts: BatchCounts | None = None,
    keep_going: bool = False,
    **trigger,
) -> StreamingQuery:
    """Hand the requests that meet ``predicate`` to ``consumer``, batch by batch.

    ``max_records`` hands on that many, the first in input order, and none of the
    later batches.  ``counts`` is filled in after each batch that was handed on.
    Both hold over restarts: the totals after each batch are written beside the
    checkpoint, and a batch that is tried again counts once.  With
    ``keep_going`` an exception of the consumer is noted in ``counts`` and the
    query goes on; otherwise it ends the query, and the batch is not counted.
    The totals need one more count per batch, so they cost nothing where they are
    not asked for.
    """
    given = counts if counts is not None else BatchCounts()
    condition = as_condition(predicate)
    ledger = _Ledger(stream.sparkSession, checkpoint) if counts is not None or max_records is not None else None

    def hand_on(batch: DataFrame, batch_id: int) -> None:
        totals = None
        with errors_as_null(batch.sparkSession):
            accepted = batch.where(condition)
            judged = batch.select(condition.alias("_ok"))
        if ledger:
            batches, records, filtered_out = ledger.before(batch_id)
            given.batches, given.records, given.filtered_out = batches, records, filtered_out
            seen = judged.agg(F.count("*").alias("n"), F.count_if("_ok").alias("ok")).first()
            left = seen["ok"] if max_records is None else max_records - records
            if left <= 0:
                return
            if left < seen["ok"]:
                accepted = first_rows(accepted, input_order(accepted), left)
            totals = batches + 1, records + min(left, seen["ok"]), filtered_out + seen["n"] - seen["ok"]
        try:
            consumer(accepted, batch_id)
        except Exception as error:
            if not keep_going:
                raise
            given.errors.append(str(error))
        if ledger:
            ledger.note(batch_id, totals)
            given.batches, given.records, given.filtered_out = totals

    return _start(stream, hand_on, checkpoint, trigger or {"availableNow": True})
