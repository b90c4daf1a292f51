"""Removing repeated requests, within one log and across merged logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.functions.keys import fingerprint
from callsift.plans.ordering import all_but_one, first_per_key, input_order
from callsift.plans.skew import join_many_to_one

# Fixed value: the columns that make two requests of merged logs the same.
MERGE_KEY = ("timestamp", "method", "path", "response_status")


def _short_fingerprint() -> Column:
    """The fingerprint as 32 bytes: half the shuffle of its hex text."""
    return F.unhex(fingerprint())


def dedup_unique(df: DataFrame, order_cols: Sequence[str] | None = None) -> DataFrame:
    """The first request of each fingerprint; time, status and response are ignored."""
    order = input_order(df, order_cols)
    return first_per_key(df.withColumn("_fp", _short_fingerprint()), ["_fp"], order).drop("_fp")


def dedup_duplicates(df: DataFrame, order_cols: Sequence[str] | None = None) -> DataFrame:
    """Every request but the first of its fingerprint; any number of copies is fine.

    Each request is compared with the first position of its group, found by one
    partial aggregate together with the number of rows at it.  Where several
    rows share that very position (copies of one record), exactly one stays.
    """
    order = input_order(df, order_cols)
    keyed = df.withColumn("_fp", _short_fingerprint())
    here = F.struct(*order)
    places = keyed.groupBy("_fp").agg(F.min(here).alias("_first"), F.count("*").alias("_rows"))
    groups = places.where(F.col("_rows") > 1)
    placed = join_many_to_one(keyed, groups, ["_fp"], rows="_rows")
    later = placed.where(here > F.col("_first"))
    # No row comes before the first; "not later" rather than "equal" leaves the join keys
    # as they are, so that both uses share one shuffle of the rows.
    extra = all_but_one(placed.where(~(here > F.col("_first"))), ["_fp"])
    return later.select(*df.columns).unionByName(extra.select(*df.columns))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Fingerprints with several requests, in long form: (fingerprint, group_size, id)."""
    members = df.select(_short_fingerprint().alias("_fp"), "id")
    sizes = members.groupBy("_fp").agg(F.count("*").alias("group_size"))
    grouped = join_many_to_one(members, sizes.where(F.col("group_size") > 1), ["_fp"], rows="group_size")
    return grouped.select(F.lower(F.hex("_fp")).alias("fingerprint"), "group_size", "id")


def merge(
    sources: Sequence[DataFrame], deduplicate: bool = True, order_cols: Sequence[str] | None = None
) -> DataFrame:
    """Union of the sources in order, with ``source_index``.

    ``deduplicate`` keeps the first request per timestamp, method, path and
    status (nulls are equal), earlier sources first.
    """
    if not sources:
        raise ValueError("at least one source is needed")
    merged = None
    for index, source in enumerate(sources):
        part = source.withColumn("source_index", F.lit(index))
        merged = part if merged is None else merged.unionByName(part)
    if not deduplicate:
        return merged
    return first_per_key(merged, MERGE_KEY, ["source_index", *input_order(merged, order_cols)])


def merge_stats(sources: Sequence[DataFrame], deduplicate: bool = True) -> DataFrame:
    """Per source: records read, records merged and duplicates skipped."""
    everything = merge(sources, deduplicate=False).select("source_index", *MERGE_KEY)
    records = everything.groupBy("source_index").agg(F.count("*").alias("records"))
    if deduplicate:
        firsts = everything.groupBy(*MERGE_KEY).agg(F.min("source_index").alias("source_index"))
        merged = firsts.groupBy("source_index").agg(F.count("*").alias("merged"))
    else:
        merged = records.withColumnRenamed("records", "merged")
    listed = everything.sparkSession.range(len(sources)).select(
        F.col("id").cast("int").alias("source_index")
    )
    counted = listed.join(records, "source_index", "left").join(merged, "source_index", "left")
    return counted.na.fill(0, ["records", "merged"]).withColumn(
        "duplicates_skipped", F.col("records") - F.col("merged")
    )


def merge_totals(sources: Sequence[DataFrame], deduplicate: bool = True) -> DataFrame:
    """One row: sources, merged records and duplicates skipped."""
    return merge_stats(sources, deduplicate).agg(
        F.count("*").alias("total_sources"),
        F.sum("merged").alias("total_merged"),
        F.sum("duplicates_skipped").alias("duplicates_skipped"),
    )
