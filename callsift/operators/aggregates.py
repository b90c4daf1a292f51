"""Grouped statistics.  All reduce before the shuffle (partial aggregation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.functions.headers import UNCORRELATED, correlation_id
from callsift.functions.keys import named_key, status_text
from callsift.plans.ordering import first_rows, input_order

ENDPOINT = ("method", "path")
# Column of a pivot for values that have none of their own.
OTHER = "other"


def _errors() -> Column:
    return F.count_if(F.col("response_status") >= 400)


def _count() -> Column:
    return F.count(F.lit(1))


def _first_seen(df: DataFrame, order_cols: Sequence[str] | None) -> Column:
    """The least value of each column of the input order, as a struct.

    The id, a text, is left out unless asked for: with it Spark would sort
    before aggregating.  Groups first seen at the same ``seq`` and time tie.
    """
    columns = [c for c in input_order(df, order_cols) if order_cols or c != "id"]
    return F.struct(*[F.min(c).alias(c) for c in columns]).alias("first_seen")


def endpoint_stats(df: DataFrame, order_cols: Sequence[str] | None = None) -> DataFrame:
    """Per (method, path): requests, durations, errors (status from 400), rates.

    The average divides by all requests, also those without a duration.
    ``first_seen`` tells the position of the first request, to break ties.
    """
    total = F.coalesce(F.sum("duration_ms"), F.lit(0.0))
    return df.groupBy(*ENDPOINT).agg(
        _count().alias("requests"),
        total.alias("total_duration_ms"),
        (total / _count()).alias("avg_duration_ms"),
        _errors().alias("errors"),
        (_errors() / _count()).alias("error_rate"),
        _first_seen(df, order_cols),
    )


def endpoint_top_n(
    df: DataFrame, n: int, sort: str = "count", order_cols: Sequence[str] | None = None
) -> DataFrame:
    """The ``n`` busiest (``count``) or slowest (``duration``) endpoints."""
    columns = {"count": "requests", "duration": "avg_duration_ms"}
    if sort not in columns:
        raise ValueError(f"sort must be one of {sorted(columns)}, got '{sort}'")
    if n < 0:
        raise ValueError(f"n must be >= 0, got {n}")
    stats = endpoint_stats(df, order_cols)
    return first_rows(stats, [F.col(columns[sort]).desc(), "first_seen", *ENDPOINT], n)


def endpoint_status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*ENDPOINT, "response_status").agg(_count().alias("n"))


def summary(df: DataFrame, order_cols: Sequence[str] | None = None) -> DataFrame:
    """One row: totals, average duration, slowest and fastest request, error rate.

    Among equal durations the slowest is the last one in input order and the
    fastest the first one.  An empty log gives zero counts and nulls.
    """
    position = F.struct("duration_ms", *input_order(df, order_cols))
    timed = F.when(F.col("duration_ms").isNotNull(), position)
    return df.agg(
        _count().alias("total"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.max_by("path", timed).alias("slowest_path"),
        F.max("duration_ms").alias("slowest_ms"),
        F.min_by("path", timed).alias("fastest_path"),
        F.min("duration_ms").alias("fastest_ms"),
        F.coalesce(F.try_divide(_errors(), _count()), F.lit(0.0)).alias("error_rate"),
    )


def method_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("method").agg(_count().alias("n"))


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(status_text().alias("status")).agg(_count().alias("n"))


def top_paths(df: DataFrame, n: int = 5, order_cols: Sequence[str] | None = None) -> DataFrame:
    """The ``n`` most frequent paths; the one seen first wins a tie."""
    counted = df.groupBy("path").agg(_count().alias("n"), _first_seen(df, order_cols))
    return first_rows(counted, [F.col("n").desc(), "first_seen", "path"], n).drop("first_seen")


# Paths that the summary of heavy_paths proposes, and that it follows at most; buckets of the paths it leaves out.
CANDIDATES, FOLLOWED, PATH_BUCKETS = 1_000, 50_000, 65_536


def heavy_paths(df: DataFrame, n: int = 5, order_cols: Sequence[str] | None = None) -> DataFrame:
    """As :func:`top_paths`, for logs with more paths than can be shuffled: the same rows.

    A frequent-items sketch per task, merged, proposes candidates.  A second pass
    counts these exactly, and all other paths by hash bucket: no path of a bucket
    has more requests than the bucket.  Buckets with fewer than the ``n``-th
    candidate are thereby settled; only paths of the other buckets are counted
    one by one.  Shuffles carry candidates and buckets, not paths, and the
    broadcast sets are bounded by :data:`CANDIDATES` and :data:`PATH_BUCKETS`.
    """
    if n > CANDIDATES:
        raise ValueError(f"n must be <= {CANDIDATES}, got {n}")
    narrow = df.select("path", *[c for c in input_order(df, order_cols) if c != "path"])
    sketch = narrow.agg(F.expr(f"approx_top_k(path, {CANDIDATES}, {FOLLOWED})").alias("items"))
    proposed = sketch.select(F.explode("items.item").alias("candidate"), F.lit(True).alias("is_candidate"))
    marked = narrow.join(F.broadcast(proposed), F.col("path").eqNullSafe(F.col("candidate")), "left").drop("candidate")
    bucket = F.pmod(F.xxhash64("path"), F.lit(PATH_BUCKETS))
    marked = marked.withColumn("bucket", F.when(F.col("is_candidate").isNull(), bucket))
    by = [F.when(F.col("is_candidate"), F.col("path")).alias("path"), "bucket"]
    met = [_count().alias("n"), _first_seen(df, order_cols)]
    counted = marked.groupBy(*by).agg(*met)
    candidates = counted.where("bucket is null").drop("bucket")
    leading = candidates.orderBy(F.desc("n")).limit(n).agg(F.min("n").alias("least"), F.count("*").alias("rows"))
    floor = leading.select(F.when(F.col("rows") == n, F.col("least")).otherwise(0)).scalar()
    unsettled = counted.where(F.col("bucket").isNotNull() & (F.col("n") >= floor)).select("bucket")
    others = marked.join(F.broadcast(unsettled), "bucket", "left_semi").groupBy("path").agg(*met)
    both = candidates.unionByName(others)
    return first_rows(both, [F.col("n").desc(), "first_seen", "path"], n).drop("first_seen")


def group_stats(df: DataFrame, key: str | Column, depth: int = 1) -> DataFrame:
    """Requests and mean duration per key: method, status, path_prefix or a Column."""
    return df.groupBy(named_key(key, depth).alias("key")).agg(
        _count().alias("requests"),
        (F.coalesce(F.sum("duration_ms"), F.lit(0.0)) / _count()).alias("avg_duration_ms"),
    )


def split_buckets(df: DataFrame, key: str | Column, depth: int = 1) -> DataFrame:
    """Add ``bucket``; a null status is ``unknown``, a null key stays unmatched (null)."""
    column = named_key(key, depth)
    if isinstance(key, str) and key == "status_class":
        column = F.coalesce(column, F.lit("unknown"))
    return df.withColumn("bucket", column)


def split_counts(df: DataFrame, key: str | Column, depth: int = 1) -> DataFrame:
    """Requests per bucket; the null bucket holds the unmatched ones."""
    return split_buckets(df, key, depth).groupBy("bucket").agg(_count().alias("n"))


def pivot_long(
    df: DataFrame, row_by: str | Column = "method", col_by: str | Column = "status_class"
) -> DataFrame:
    """Frequency table in long form (row, col, n): any number of columns."""
    return df.groupBy(named_key(row_by).alias("row"), named_key(col_by).alias("col")).agg(
        _count().alias("n")
    )


def pivot(
    df: DataFrame,
    row_by: str | Column = "method",
    col_by: str | Column = "status_class",
    values: Sequence[str] | None = None,
) -> DataFrame:
    """Frequency table in wide form: sorted rows, one sorted column per value, 0 when absent.

    ``values`` fixes the columns; requests with any other value, or none, count
    in a last column ``other``.  Without it Spark first lists the distinct ones.
    """
    counted = pivot_long(df, row_by, col_by)
    if values:
        listed = F.when(F.col("col").isin(list(values)), F.col("col")).otherwise(F.lit(OTHER))
        counted = counted.withColumn("col", listed)
    columns = [*sorted(set(values) - {OTHER}), OTHER] if values else None
    wide = counted.groupBy("row").pivot("col", columns).agg(F.sum("n"))
    return wide.na.fill(0).orderBy("row")


def with_correlation(df: DataFrame) -> DataFrame:
    """Add ``correlation_id`` from the request headers."""
    return df.withColumn("correlation_id", correlation_id(F.col("request_headers")))


def correlation_chains(df: DataFrame) -> DataFrame:
    """Requests and time range per correlation id, the uncorrelated ones as one chain."""
    return with_correlation(df).groupBy("correlation_id").agg(
        _count().alias("requests"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def correlation_totals(df: DataFrame) -> DataFrame:
    """One row: chains, correlated and uncorrelated requests."""
    loose = F.col("correlation_id") == UNCORRELATED
    return correlation_chains(df).agg(
        _count().alias("chains"),
        F.coalesce(F.sum(F.when(~loose, F.col("requests"))), F.lit(0)).alias("correlated"),
        F.coalesce(F.sum(F.when(loose, F.col("requests"))), F.lit(0)).alias("uncorrelated"),
    )
