"""Time-ordered analysis: gaps, throttling, rate limits, batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsift.functions.keys import as_condition
from callsift.plans.errors import contained
from callsift.plans.ordering import (
    first_per_key_marked,
    first_rows,
    input_order,
    time_order,
    with_group_position,
    with_previous,
    with_row_index,
)

# Largest rank for which Spark prunes a ranked window before the shuffle.
GROUP_LIMIT = 1000


def timeline_gaps(df: DataFrame, order_cols: Sequence[str] | None = None) -> DataFrame:
    """Add ``gap_before_ms``: time since the preceding request, null for the first."""
    previous = with_previous(df, "timestamp", time_order(df, order_cols), "_previous")
    gap = F.greatest(F.lit(0.0), (F.col("timestamp") - F.col("_previous")) * F.lit(1000.0))
    return previous.withColumn(
        "gap_before_ms", F.when(F.col("_previous").isNotNull(), gap)
    ).drop("_previous")


def timeline_span(df: DataFrame) -> DataFrame:
    """One row: requests and the milliseconds from the first to the last."""
    span = (F.max("timestamp") - F.min("timestamp")) * F.lit(1000.0)
    return df.agg(
        F.count("*").alias("requests"), F.coalesce(span, F.lit(0.0)).alias("total_span_ms")
    )


def _budget(max_rps: float, window_ms: float) -> int:
    if max_rps <= 0:
        raise ValueError("the request rate has to be positive")
    if window_ms <= 0:
        raise ValueError("the window length has to be positive")
    return max(1, math.floor(max_rps * window_ms / 1000.0))


def _window_number(window_ms: float) -> Column:
    """Number of the tumbling window; the cast truncates towards zero."""
    return (F.col("timestamp") * F.lit(1000.0) / F.lit(float(window_ms))).cast("bigint")


def _window_limits(windowed: DataFrame, order: Sequence[str], budget: int) -> DataFrame:
    """``_window, _last, _extra, _tied`` of the windows with at least ``budget`` requests.

    ``_last`` is the position of the last request within the budget, ``_extra``
    how many requests at that very position are within it, and ``_tied`` tells
    that there are more of them.  Only the window and the order columns are
    shuffled; up to Spark's limit of ranks at most ``budget + 1`` rows per window
    and task.
    """
    key = F.struct(*order)
    narrow = windowed.select("_window", *order)
    if budget < GROUP_LIMIT:
        window = Window.partitionBy("_window").orderBy(*order)
        top = narrow.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= budget + 1)
        # The rows of a window are together now: no further shuffle.
        ties = F.rank().over(window).alias("_first")
        marked = top.select("*", ties, F.lead(key).over(window).alias("_next")).where(F.col("_rank") == budget)
        return marked.select(
            "_window",
            key.alias("_last"),
            (budget + 1 - F.col("_first")).alias("_extra"),
            F.coalesce(F.col("_next") == key, F.lit(False)).alias("_tied"),
        )
    placed = with_group_position(narrow, ["_window"], order, "_place")
    lasts = placed.where(F.col("_place") == budget - 1).select("_window", key.alias("_last"))
    below, same = F.count_if(key < F.col("_last")), F.count_if(key == F.col("_last"))
    return (
        narrow.join(lasts.withColumnRenamed("_window", "_limited"), F.col("_window").eqNullSafe(F.col("_limited")))
        .groupBy("_window", "_last")
        .agg((budget - below).alias("_extra"), (below + same > budget).alias("_tied"))
    )


def throttle(
    df: DataFrame, max_rps: float, window_ms: float = 1000.0, order_cols: Sequence[str] | None = None
) -> DataFrame:
    """Add ``kept``: whether the request is within its window's budget.

    Each window keeps its first ``max(1, floor(max_rps * window_ms / 1000))``
    requests by time.  The last position within the budget is found for each
    crowded window, and every request is compared with it in a join by window,
    whose crowded partitions AQE splits.  Only requests at that very position of
    windows where too many share it are ranked.
    """
    budget, order = _budget(max_rps, window_ms), time_order(df, order_cols)
    here = F.struct(*order)
    windowed = df.withColumn("_window", _window_number(window_ms))
    limits = _window_limits(windowed, order, budget)
    # Requests without a time are a window of their own.
    limits = limits.withColumnRenamed("_window", "_limited")
    same = windowed["_window"].eqNullSafe(limits["_limited"])
    compared = windowed.join(limits.drop("_extra"), same, "left")
    open_ = F.coalesce(F.col("_tied") & (here == F.col("_last")), F.lit(False))
    kept = F.col("_last").isNull() | (here <= F.col("_last"))
    sure = compared.where(~open_).withColumn("kept", kept).drop("_window", "_limited", "_last", "_tied")
    crowded = windowed.join(limits.where("_tied"), same).where(here == F.col("_last"))
    ties = first_per_key_marked(crowded, ["_window"], "_extra", "kept")
    return sure.unionByName(ties.select(*[f"`{c}`" for c in sure.columns]))


def throttle_kept(
    df: DataFrame, max_rps: float, window_ms: float = 1000.0, order_cols: Sequence[str] | None = None
) -> DataFrame:
    """The requests :func:`throttle` keeps.

    A small budget is a rank limit that Spark applies before the shuffle, so a
    crowded window sends at most ``budget`` rows per map task.
    """
    budget = _budget(max_rps, window_ms)
    if budget > GROUP_LIMIT:
        return throttle(df, max_rps, window_ms, order_cols).where("kept").drop("kept")
    window = Window.partitionBy("_window").orderBy(*time_order(df, order_cols))
    return (
        df.withColumn("_window", _window_number(window_ms))
        .withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") <= budget)
        .drop("_window", "_rank")
    )


def throttle_counts(df: DataFrame, max_rps: float, window_ms: float = 1000.0) -> DataFrame:
    """One row: kept and dropped requests, from the size of each window alone."""
    budget = _budget(max_rps, window_ms)
    sizes = df.groupBy(_window_number(window_ms).alias("_window")).agg(F.count("*").alias("_n"))
    kept = F.least(F.col("_n"), F.lit(budget))
    return sizes.agg(
        F.coalesce(F.sum(kept), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.col("_n") - kept), F.lit(0)).alias("dropped"),
    )


def rate_limits(df: DataFrame, max_rps: float = 10.0) -> DataFrame:
    """Requests per second of each (upper-case method, path) over the span of the log.

    The span is the time from the first to the last request of all, 1 s when
    zero; ``exceeds_limit`` when the rate is above ``max_rps``.
    """
    span = df.agg(F.max("timestamp") - F.min("timestamp")).scalar()
    seconds = F.when(F.col("_span") > 0, F.col("_span")).otherwise(F.lit(1.0))
    return (
        df.groupBy(F.upper("method").alias("method"), "path")
        .agg(F.count("*").alias("requests"))
        .withColumn("_span", span)
        .withColumn("window_seconds", seconds)
        .withColumn("rps", F.col("requests") / F.col("window_seconds"))
        .withColumn("exceeds_limit", F.col("rps") > F.lit(float(max_rps)))
        .drop("_span")
    )


def rate_limit_violations(df: DataFrame, max_rps: float = 10.0) -> DataFrame:
    return rate_limits(df, max_rps).where("exceeds_limit")


def rate_limit_summary(df: DataFrame, max_rps: float = 10.0) -> DataFrame:
    """One row: span, limit, endpoints and endpoints above the limit."""
    return rate_limits(df, max_rps).agg(
        F.coalesce(F.max("window_seconds"), F.lit(0.0)).alias("window_seconds"),
        F.lit(float(max_rps)).alias("max_rps"),
        F.count("*").alias("total_endpoints"),
        F.count_if("exceeds_limit").alias("violation_count"),
    )


def _check_batches(batch_size: int, max_records: int | None) -> None:
    if batch_size < 1:
        raise ValueError("a batch needs at least one record")
    if max_records is not None and max_records < 0:
        raise ValueError("the number of records cannot be negative")


@contained
def batch_records(
    df: DataFrame,
    batch_size: int = 10,
    max_records: int | None = None,
    predicate: Column | str | None = None,
    order_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Rows that meet ``predicate`` in input order, with ``batch_id`` (from 0)."""
    _check_batches(batch_size, max_records)
    indexed = with_row_index(df.where(as_condition(predicate)), input_order(df, order_cols), "_at")
    if max_records is not None:
        indexed = indexed.where(F.col("_at") < max_records)
    return indexed.withColumn("batch_id", F.floor(F.col("_at") / batch_size)).drop("_at")


@contained
def batch_stats(
    df: DataFrame,
    batch_size: int = 10,
    max_records: int | None = None,
    predicate: Column | str | None = None,
    order_cols: Sequence[str] | None = None,
) -> DataFrame:
    """One row: batches, records and rows filtered out.

    Reading stops at the first matching row beyond ``max_records``, so rows
    filtered out after it are not counted.
    """
    _check_batches(batch_size, max_records)
    order = input_order(df, order_cols)
    marked = df.select(*order, as_condition(predicate).alias("_ok"))
    rejected = ~F.col("_ok")
    if max_records is None:
        accepted = F.count_if("_ok")
    else:
        accepted = F.least(F.count_if("_ok"), F.lit(max_records))
        # The position of the first row beyond the limit: the last of one more row than it has, if so many match.
        reached = first_rows(marked.where("_ok"), order, max_records + 1)
        stop = reached.agg(
            F.when(F.count("*") > max_records, F.max(F.struct(*order))).alias("_stop")
        ).scalar()
        marked = marked.withColumn("_stop", stop)
        rejected &= F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))
    return marked.agg(
        F.ceil(accepted / batch_size).alias("batches"),
        accepted.alias("records"),
        F.count_if(rejected).alias("filtered_out"),
    )
