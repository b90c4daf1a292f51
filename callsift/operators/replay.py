"""Analysis of replay results.

A results table has ``record_id, run, attempt, status, error, duration_ms``;
``status`` is null when there was no response.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.plans.skew import join_many_to_one

# Statuses that a retry policy treats as failed.
RETRY_STATUSES = (500, 502, 503, 504)


def replay_match(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Results with the recorded status and ``matched``: same status and no error."""
    recorded = requests.select(
        F.col("id").alias("record_id"), F.col("response_status").alias("recorded_status")
    )
    keyed = results.withColumn("record_id", F.col("record_id").cast("string"))
    same = F.col("status").eqNullSafe(F.col("recorded_status")) & F.col("error").isNull()
    return join_many_to_one(keyed, recorded, ["record_id"]).withColumn("matched", same)


def replay_summary(matched: DataFrame) -> DataFrame:
    """One row: total, matched, mismatched and errored results."""
    total, good = F.count("*"), F.count_if("matched")
    bad = F.count_if(F.col("error").isNotNull())
    return matched.agg(
        total.alias("total"),
        good.alias("matched"),
        (total - good - bad).alias("mismatched"),
        bad.alias("errored"),
    )


def pool_summary(results: DataFrame) -> DataFrame:
    """One row per results table: total, success, errors, average duration.

    Rows with an error are failures of the pool and have no duration; the
    average is over the other rows, a missing duration counting as 0.
    """
    answered = F.col("error").isNull()
    n = F.count_if(answered)
    spent = F.sum(F.when(answered, F.coalesce(F.col("duration_ms"), F.lit(0.0))))
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(answered & F.col("status").isNotNull()).alias("success"),
        F.count_if(~answered).alias("errors"),
        F.coalesce(F.try_divide(spent, n), F.lit(0.0)).alias("avg_duration_ms"),
    )


def pool_status_counts(results: DataFrame) -> DataFrame:
    """Answered results per status; a missing status is ``unknown``."""
    status = F.coalesce(F.col("status").cast("string"), F.lit("unknown")).alias("status")
    return results.where(F.col("error").isNull()).groupBy(status).agg(F.count("*").alias("n"))


def _succeeded(retry_statuses: Sequence[int]) -> Column:
    retryable = F.coalesce(F.col("final_status").isin(*retry_statuses), F.lit(False))
    return F.col("final_error").isNull() & ~retryable


def retry_outcomes(
    results: DataFrame, retry_statuses: Sequence[int] = RETRY_STATUSES
) -> DataFrame:
    """Per record: attempts, status and error of the last attempt, success."""
    last = F.struct("status", "error")
    return (
        results.groupBy("record_id")
        .agg(F.count("*").alias("attempts"), F.max_by(last, "attempt").alias("_last"))
        .select(
            "record_id",
            "attempts",
            F.col("_last.status").alias("final_status"),
            F.col("_last.error").alias("final_error"),
        )
        .withColumn("succeeded", _succeeded(retry_statuses))
    )


def retry_summary(outcomes: DataFrame) -> DataFrame:
    """One row: records, succeeded, failed and attempts in total."""
    return outcomes.agg(
        F.count("*").alias("total"),
        F.count_if("succeeded").alias("succeeded"),
        F.count_if(~F.col("succeeded")).alias("failed"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("total_attempts"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Per run: total, success (status below 400), failures and errors."""
    success = F.count_if(F.col("status") < 400)
    return results.groupBy("run").agg(
        F.count("*").alias("total"),
        success.alias("success_count"),
        (F.count("*") - success).alias("failure_count"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("error_count"),
    )


def run_status_counts(results: DataFrame) -> DataFrame:
    """Results per run and status; results without a status are left out."""
    return (
        results.where(F.col("status").isNotNull())
        .groupBy("run", "status")
        .agg(F.count("*").alias("n"))
    )
