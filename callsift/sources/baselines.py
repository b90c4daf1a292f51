"""Endpoint baselines: the last request of each endpoint, stored so that comparing with it does not shuffle it again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.operators.compare import comparable_record, endpoint_changes, paired_records
from callsift.plans.ordering import input_order, last_per_key

# Files that a baseline has unless another number is given.
BUCKETS = 64


def _endpoint(method: str | Column) -> Column:
    """(method, path) as one text that is never null, since null-safe joins cannot use buckets."""
    return F.to_json(F.array(method, "path")).alias("endpoint")


def last_records(df: DataFrame, exact_method: bool = False, order_cols: Sequence[str] | None = None) -> DataFrame:
    """``endpoint, method, path, record`` of the last request of each endpoint.

    Methods count in upper case, or as written with ``exact_method``.  A null
    method or path is a value of its own.
    """
    method = F.col("method") if exact_method else F.upper("method")
    order = input_order(df, order_cols)
    keyed = df.select(
        _endpoint(method), method.alias("method"), "path", comparable_record().alias("record"),
        *[F.col(c).alias(f"_o_{c}") for c in order],
    )
    return last_per_key(keyed, ["endpoint"], [f"_o_{c}" for c in order]).drop(*[f"_o_{c}" for c in order])


def save_baseline(
    df: DataFrame,
    table: str,
    buckets: int = BUCKETS,
    exact_method: bool = False,
    order_cols: Sequence[str] | None = None,
) -> None:
    """Store the last request of each endpoint as a catalog table in ``buckets`` buckets of endpoints.

    One row per endpoint is left before the shuffle, so a busy endpoint makes no
    large bucket.  An existing table is replaced.
    """
    last = last_records(df, exact_method, order_cols).repartition(buckets, "endpoint")
    writer = last.write.mode("overwrite").format("parquet").option("compression", "zstd")
    writer.bucketBy(buckets, "endpoint").sortBy("endpoint").saveAsTable(table)


def _bucket_count(spark: SparkSession, table: str) -> int:
    described = spark.sql(f"DESCRIBE EXTENDED {table}").where(F.col("col_name") == "Num Buckets").first()
    if described is None:
        raise ValueError(f"{table} is no baseline: it has no buckets")
    return int(described["data_type"])


def _sides(spark: SparkSession, table: str, current: DataFrame, exact_method: bool, order_cols) -> tuple[DataFrame, DataFrame]:
    """The stored side as it lies, and the last requests of ``current`` dealt like it."""
    new = last_records(current, exact_method, order_cols).repartition(_bucket_count(spark, table), "endpoint")
    return spark.table(table), new


def compare_with_baseline(
    spark: SparkSession, table: str, current: DataFrame, order_cols: Sequence[str] | None = None
) -> DataFrame:
    """As :func:`~callsift.operators.compare.compare_sets` with a stored baseline of upper-case methods.

    Only the last requests of ``current`` are shuffled; the baseline is read in
    its buckets.
    """
    old, new = _sides(spark, table, current, False, order_cols)
    return paired_records(_joined(old, new))


def changes_since_baseline(
    spark: SparkSession, table: str, current: DataFrame, order_cols: Sequence[str] | None = None
) -> DataFrame:
    """As :func:`~callsift.operators.compare.snapshot_diff` with a stored baseline of methods as written.

    Of the baseline's records only the status is read.
    """
    old, new = _sides(spark, table, current, True, order_cols)
    status = F.col("record.response_status")
    narrow = [df.select("endpoint", "method", "path", status.alias("status"), F.lit(True).alias("is_in")) for df in (old, new)]
    pairs = narrow[0].alias("old").join(narrow[1].alias("new"), "endpoint", "full_outer")
    return endpoint_changes(
        pairs.select(
            F.coalesce("old.method", "new.method").alias("method"), F.coalesce("old.path", "new.path").alias("path"),
            F.col("old.status").alias("snapshot_status"), F.col("new.status").alias("current_status"),
            F.col("old.is_in").alias("_in_snapshot_status"), F.col("new.is_in").alias("_in_current_status"),
        )
    )


def _joined(old: DataFrame, new: DataFrame) -> DataFrame:
    pairs = old.alias("old").join(new.alias("new"), "endpoint", "full_outer")
    return pairs.select(
        F.coalesce("old.method", "new.method").alias("match_method"), F.coalesce("old.path", "new.path").alias("match_path"),
        F.col("old.record").alias("old"), F.col("new.record").alias("new"),
    )
