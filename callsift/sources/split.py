"""Splitting a log into one directory per bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.operators.aggregates import split_buckets


def bucket_name(bucket: Column) -> Column:
    """Directory name of a bucket: ``/`` as ``_``, outer ``_`` dropped, ``root`` when empty."""
    flat = F.regexp_replace(F.replace(bucket, F.lit("/"), F.lit("_")), r"^_+|(?<!_)_+\z", "")
    return F.when(flat == "", F.lit("root")).otherwise(flat)


def write_split(df: DataFrame, key: str | Column, path: str, depth: int = 1) -> None:
    """Write every matched request below ``bucket_name=<name>``.

    Different buckets can share a name, so the exact bucket stays a column.  The
    rebalance gathers small buckets into few files and splits large ones.
    """
    bucketed = split_buckets(df, key, depth).where(F.col("bucket").isNotNull())
    named = bucketed.withColumn("bucket_name", bucket_name(F.col("bucket")))
    named.hint("rebalance", "bucket_name").write.mode("append").partitionBy("bucket_name").parquet(path)
