"""Archives: compressed Parquet copies of a log, and what a restore would add."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from callsift.plans.ordering import first_per_key, input_order
from callsift.sources.log import append_log, read_log


def archive(df: DataFrame, path: str) -> int:
    """Write all requests to a new archive; the count comes from the same pass."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.option("compression", "zstd").parquet(path)
    return seen.get["n"]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def archived_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids in the archive; only that column is read."""
    return spark.read.parquet(path).select("id")


def restore_new_records(
    archived: DataFrame, existing: DataFrame, order_cols: Sequence[str] | None = None
) -> DataFrame:
    """Archived requests whose id is not in the log yet, the first one per id."""
    firsts = first_per_key(archived, ["id"], input_order(archived, order_cols))
    return firsts.join(existing.select("id").distinct(), "id", "left_anti").select(*archived.columns)


def restore(
    spark: SparkSession, archive_path: str, log_path: str, format: str = "parquet", order_cols: Sequence[str] | None = None
) -> int:
    """Append the archived requests that the log does not have yet; how many, from the same pass.

    An absent log is created.  A second restore of the same archive adds nothing.
    """
    existing = read_log(spark, log_path, format, strict=False)
    seen = Observation()
    missing = restore_new_records(read_archive(spark, archive_path), existing, order_cols)
    append_log(missing.observe(seen, F.count(F.lit(1)).alias("n")), log_path, format)
    return seen.get["n"]
