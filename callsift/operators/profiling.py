"""Latency distribution: histogram and exact nearest-rank percentiles."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default histogram boundaries and percentiles.
BOUNDARIES_MS = (50, 100, 250, 500, 1000, 2500, 5000)
PERCENTILES = (50, 90, 99)

# Bins per e-fold of duration when narrowing down a percentile.
_BINS_PER_E = 4096
# Bin of NaN, after every other one.
_NAN_BIN = (1 << 63) - 1
# Figures of a group that travel with its wanted ranks.
_FOUND = ("requests", "min_ms", "max_ms", "_total")


def bucket_label(duration: Column, boundaries: Sequence[float] = BOUNDARIES_MS) -> Column:
    """``<b ms`` for the first boundary above the duration, else ``>=last ms``."""
    label = F.lit(f">={boundaries[-1]}ms")
    for bound in reversed(boundaries):
        label = F.when(duration < bound, F.lit(f"<{bound}ms")).otherwise(label)
    return label


def latency_histogram(df: DataFrame, boundaries: Sequence[float] = BOUNDARIES_MS) -> DataFrame:
    return (
        df.where(F.col("duration_ms").isNotNull())
        .groupBy(bucket_label(F.col("duration_ms"), boundaries).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def latency_profile(
    df: DataFrame,
    by: Sequence[str] = (),
    percentiles: Sequence[int] = PERCENTILES,
    approximate: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """Count, min, max, mean and percentiles of durations, overall or per ``by`` columns.

    Percentiles are exact (nearest rank): distinct values are counted and summed
    into logarithmic bins; the bin that holds a wanted rank is searched by parts,
    and the part value by value.  A part is 1/16,777,216 of an e-fold, so a task
    gets few values unless durations are finer than seven digits.  NaN counts as
    larger than every number, and infinity has a bin of its own below it.  ``approximate`` uses Spark's sketch of the given
    ``accuracy`` instead.
    """
    timed = df.where(F.col("duration_ms").isNotNull()).select(*by, F.col("duration_ms").alias("_v"))
    if approximate:
        return _approximate(timed, by, percentiles, accuracy)
    # Monotone in _v, so bins keep the order of the values; NaN comes after all of them.
    place = F.signum("_v") * F.log1p(F.abs("_v")) * _BINS_PER_E
    last, endless = F.isnan("_v"), F.abs("_v") == float("inf")
    ends = F.when(F.col("_v") > 0, F.lit(_NAN_BIN - 1)).otherwise(F.lit(-_NAN_BIN))
    binned = timed.select(
        *by,
        "_v",
        F.when(last, F.lit(_NAN_BIN)).when(endless, ends).otherwise(F.floor(place)).alias("_bin"),
        F.when(last | endless, F.lit(0)).otherwise(F.floor((place - F.floor(place)) * _BINS_PER_E)).alias("_part"),
    )
    # Both uses of the counts below need a bin, and the common filter lets them share one shuffle.
    values = (
        binned.where(F.col("_bin").isNotNull()).groupBy(*by, "_bin", "_part", "_v").agg(F.count("*").alias("_n"))
    )
    bins = values.groupBy(*by, "_bin").agg(
        F.sum("_n").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.sum(F.col("_v") * F.col("_n")).alias("_sum"),
    )
    everything = Window.partitionBy(*by)
    # Bins per group are bounded by the range of durations, not by the number of rows:
    # about 70,000 from 0 to 10 hours.
    totals = bins.select(
        *by,
        "_bin",
        "_n",
        F.sum("_n").over(everything).alias("requests"),
        F.min("_min").over(everything).alias("min_ms"),
        F.max("_max").over(everything).alias("max_ms"),
        F.sum("_sum").over(everything).alias("_total"),
    )
    wanted = F.explode(F.array(*[F.lit(p) for p in percentiles])).alias("_p")
    rank = F.greatest(F.ceil(F.col("_p") / F.lit(100.0) * F.col("requests")), F.lit(1))
    targets = _holding(totals.select("*", wanted).withColumn("_rank", rank), by, "_bin")
    # A bin may have very many different values: its parts are searched before them.
    parts = _inside(values, targets, by, ["_bin"])
    summed = parts.groupBy(*by, "_p", "_bin", "_part").agg(
        F.sum("_n").alias("_n"), *[F.first(c).alias(c) for c in ("_rank", *_FOUND)]
    )
    found = _inside(values, _holding(summed, by, "_part"), by, ["_bin", "_part"])
    found = _holding(found, by, "_v")
    none = F.lit(0.0)
    return found.groupBy(*by).agg(
        F.coalesce(F.max("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.max("min_ms"), none).alias("min_ms"),
        F.coalesce(F.max("max_ms"), none).alias("max_ms"),
        F.coalesce(F.max(F.col("_total") / F.col("requests")), none).alias("mean_ms"),
        *[
            F.coalesce(F.max(F.when(F.col("_p") == p, F.col("_v"))), none).alias(f"p{p}_ms")
            for p in percentiles
        ],
    )


def _holding(counted: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Of each group and percentile, the row in which the count ``_n`` reaches ``_rank``.

    ``_rank`` becomes the rank within that row.
    """
    upto = Window.partitionBy(*by, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", F.sum("_n").over(upto))
    before = F.col("_upto") - F.col("_n")
    here = placed.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > before))
    return here.withColumn("_rank", F.col("_rank") - before).drop("_upto")


def _inside(values: DataFrame, targets: DataFrame, by: Sequence[str], bins: Sequence[str]) -> DataFrame:
    """The counted values in the bins that hold a wanted rank."""
    keys = [*by, *bins]
    renamed = targets.select(
        *[F.col(k).alias(f"_t_{i}") for i, k in enumerate(keys)], "_p", "_rank", *_FOUND
    )
    same = [values[k].eqNullSafe(renamed[f"_t_{i}"]) for i, k in enumerate(keys)]
    return values.join(renamed, same).drop(*[f"_t_{i}" for i in range(len(keys))])


def _approximate(
    timed: DataFrame, by: Sequence[str], percentiles: Sequence[int], accuracy: int
) -> DataFrame:
    none = F.lit(0.0)
    return timed.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.coalesce(F.min("_v"), none).alias("min_ms"),
        F.coalesce(F.max("_v"), none).alias("max_ms"),
        F.coalesce(F.avg("_v"), none).alias("mean_ms"),
        *[
            F.coalesce(F.percentile_approx("_v", p / 100.0, accuracy), none).alias(f"p{p}_ms")
            for p in percentiles
        ],
    )


# Size of the sketches in a summary, unless a caller says otherwise.
SKETCH_K = 4096
_ENDLESS, _LARGEST = float("inf"), sys.float_info.max


def latency_summaries(df: DataFrame, by: Sequence[str] = ("method", "path"), k: int = SKETCH_K) -> DataFrame:
    """One mergeable row per group and day: count, minimum, maximum, sum and a KLL sketch of durations.

    Written once a day (``day`` counts from 1970), the rows serve any later
    interval through :func:`merged_profile` without the requests.  A sketch holds
    a bounded number of values, all of them up to about ``k``.  Null durations are left
    out; requests without a time stand under a null day.
    """
    day = F.floor(F.col("timestamp") / 86400).cast("long").alias("day")
    timed = df.where(F.col("duration_ms").isNotNull()).select(*by, day, F.col("duration_ms").alias("_v"))
    # Sketches leave out NaN, so it goes in as infinity, and infinity as the largest number.
    number = F.when(F.isnan("_v"), F.lit(_ENDLESS)).when(F.col("_v") == _ENDLESS, F.lit(_LARGEST)).otherwise(F.col("_v"))
    return timed.groupBy(*by, "day").agg(
        F.count("*").alias("requests"),
        F.min("_v").alias("min_ms"),
        F.max("_v").alias("max_ms"),
        F.sum("_v").alias("total_ms"),
        F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"),
    )


def rank_error(k: int = SKETCH_K) -> float:
    """Share of all values by which a wanted rank may be missed, with 99 % confidence (published fit for KLL sketches)."""
    return 2.296 / k**0.9021


def merged_profile(
    summaries: DataFrame,
    by: Sequence[str] = (),
    percentiles: Sequence[int] = PERCENTILES,
    first_day: int | None = None,
    last_day: int | None = None,
) -> DataFrame:
    """The latency profile of whole days from :func:`latency_summaries`, per ``by`` columns or overall.

    Only sketches are merged, so the cost follows groups and days, not requests.
    Count, minimum, maximum and mean are exact; percentiles (nearest rank, NaN
    above all numbers) are within :func:`rank_error`.  Without a bound all days
    count, requests without a time too.  Without any request there is no row.
    """
    if first_day is not None:
        summaries = summaries.where(F.col("day") >= first_day)
    if last_day is not None:
        summaries = summaries.where(F.col("day") <= last_day)
    merged = summaries.groupBy(*by).agg(
        F.sum("requests").alias("requests"),
        F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"),
        (F.sum("total_ms") / F.sum("requests")).alias("mean_ms"),
        F.kll_merge_agg_double("sketch").alias("_sketch"),
    )
    found = {}
    for p in percentiles:
        value = F.kll_sketch_get_quantile_double("_sketch", F.lit(p / 100))
        nan, endless = F.lit(float("nan")), F.lit(_ENDLESS)
        found[f"p{p}_ms"] = F.when(value == endless, nan).when(value == _LARGEST, endless).otherwise(value)
    return merged.where("requests > 0").withColumns(found).drop("_sketch")
