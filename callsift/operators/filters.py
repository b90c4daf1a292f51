"""Selecting requests: lookups, conjunctive filters, deterministic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.functions.headers import header
from callsift.functions.keys import as_condition, sample_bucket
from callsift.plans.errors import contained
from callsift.plans.ordering import input_order


def filter_requests(
    df: DataFrame,
    method: str | None = None,
    path_prefix: str | None = None,
    status: int | None = None,
    min_duration_ms: float | None = None,
    max_duration_ms: float | None = None,
    host: str | None = None,
) -> DataFrame:
    """Rows that meet every given criterion; bounds are inclusive.

    An empty method, prefix or host sets no condition.  A null duration fails
    once a bound is set.  The host is the exact ``Host`` header.
    """
    if method:
        df = df.where(F.upper("method") == method.upper())
    if path_prefix:
        df = df.where(F.col("path").startswith(path_prefix))
    if status is not None:
        df = df.where(F.col("response_status") == status)
    if min_duration_ms is not None:
        df = df.where(F.col("duration_ms") >= float(min_duration_ms))
    if max_duration_ms is not None:
        df = df.where(F.col("duration_ms") <= float(max_duration_ms))
    if host:
        df = df.where(header(F.col("request_headers"), "Host") == host)
    return df


def find_by_id(df: DataFrame, request_id: str, order_cols: Sequence[str] | None = None) -> DataFrame:
    """The first row with that id, or none."""
    return df.where(F.col("id") == request_id).orderBy(*input_order(df, order_cols)).limit(1)


def find_by_tag(df: DataFrame, tag: str) -> DataFrame:
    return df.where(F.array_contains("tags", tag))


@contained
def hash_sample(
    df: DataFrame,
    rate: float,
    seed: int | None = None,
    predicate: Column | str | None = None,
) -> DataFrame:
    """Keep about ``rate`` of the rows by a hash of the id, then those meeting ``predicate``.

    The id alone decides, so a row is always kept or always dropped; ``seed`` is
    accepted for call compatibility and has no effect.
    """
    if not 0.0 <= rate <= 1.0:
        raise ValueError(f"a sampling rate lies from 0 to 1, not at {rate}")
    if rate == 0.0:
        return df.where(F.lit(False))
    if rate < 1.0:
        df = df.where(sample_bucket(F.col("id")) / F.lit(10_000.0) < F.lit(rate))
    return df if predicate is None else df.where(as_condition(predicate))
