"""Comparing captures: two sets of requests, a snapshot and the log, two requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.functions.headers import sorted_entries
from callsift.plans.ordering import input_order, last_per_key, with_row_index
from callsift.plans.rows import explode_structs

# The compared fields; ids, times and durations always differ.
COMPARED = (
    "method",
    "path",
    "query_string",
    "request_headers",
    "request_body",
    "response_status",
    "response_headers",
    "response_body",
)


def comparable_record() -> Column:
    """A request reduced to comparable values: header maps as sorted entries."""
    return F.struct(
        F.col("id"),
        *[
            sorted_entries(F.col(c)).alias(c) if c.endswith("_headers") else F.col(c)
            for c in COMPARED
        ],
    )


def _diffs(old: str, new: str) -> Column:
    """Array of (field, old_value, new_value) for the fields that differ, values as text."""

    def text(side: str, name: str) -> Column:
        value = F.col(f"{side}.{name}")
        return F.to_json(value) if name.endswith("_headers") else value.cast("string")

    return F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"{old}.{name}").eqNullSafe(F.col(f"{new}.{name}")),
                    F.struct(
                        F.lit(name).alias("field"),
                        text(old, name).alias("old_value"),
                        text(new, name).alias("new_value"),
                    ),
                )
                for name in COMPARED
            ]
        )
    )


def _outer_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on null-safe keys, which come out once."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    joined = left.join(right, same, "full_outer")
    merged = {k: F.coalesce(F.col(k), F.col(f"_r_{k}")) for k in keys}
    return joined.withColumns(merged).drop(*[f"_r_{k}" for k in keys])


def compare_sets(
    baseline: DataFrame, current: DataFrame, order_cols: Sequence[str] | None = None
) -> DataFrame:
    """Match the last request of each (upper-case method, path) in both captures.

    One row per key: ``state`` is ``matched``, ``only_baseline`` or
    ``only_current``; ``diffs`` lists the differing fields of a matched pair.
    """

    def latest(df: DataFrame, name: str) -> DataFrame:
        keyed = df.select(
            F.upper("method").alias("match_method"),
            F.col("path").alias("match_path"),
            comparable_record().alias(name),
            *[F.col(c).alias(f"_o_{c}") for c in input_order(df, order_cols)],
        )
        order = [c for c in keyed.columns if c.startswith("_o_")]
        return last_per_key(keyed, ["match_method", "match_path"], order).drop(*order)

    return paired_records(
        _outer_join(latest(baseline, "old"), latest(current, "new"), ["match_method", "match_path"])
    )


def paired_records(joined: DataFrame) -> DataFrame:
    """State and differences of full outer pairs ``match_method, match_path, old, new`` of records."""
    state = (
        F.when(F.col("new").isNull(), "only_baseline")
        .when(F.col("old").isNull(), "only_current")
        .otherwise("matched")
    )
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    return joined.select(
        "match_method",
        "match_path",
        state.alias("state"),
        F.col("old.id").alias("baseline_id"),
        F.col("new.id").alias("current_id"),
        F.when(both, _diffs("old", "new")).alias("diffs"),
    )


def comparison_diffs(compared: DataFrame) -> DataFrame:
    """Long form of the differences of matched pairs."""
    keys = ["match_method", "match_path", "baseline_id", "current_id"]
    return explode_structs(compared, keys, "diffs")


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row: matched pairs, regressions (pairs with any difference), one-sided keys."""
    return compared.agg(
        F.count_if(F.col("state") == "matched").alias("compared"),
        F.count_if(F.size("diffs") > 0).alias("regressions"),
        F.count_if(F.col("state") == "only_baseline").alias("only_baseline"),
        F.count_if(F.col("state") == "only_current").alias("only_current"),
    )


def snapshot_diff(
    snapshot: DataFrame, current: DataFrame, order_cols: Sequence[str] | None = None
) -> DataFrame:
    """Endpoints (method as written, path) that differ between snapshot and log.

    ``change`` is ``only_in_snapshot``, ``only_in_current`` or ``status_changed``
    (status of the last request on each side).
    """

    def latest(df: DataFrame, status: str) -> DataFrame:
        order = input_order(df, order_cols)
        narrow = df.select("method", "path", "response_status", *[c for c in order])
        return last_per_key(narrow, ["method", "path"], order).select(
            "method", "path", F.col("response_status").alias(status), F.lit(True).alias(f"_in_{status}")
        )

    joined = _outer_join(
        latest(snapshot, "snapshot_status"), latest(current, "current_status"), ["method", "path"]
    )
    return endpoint_changes(joined)


def endpoint_changes(joined: DataFrame) -> DataFrame:
    """The endpoints of full outer pairs that stand on one side only, or whose status differs."""
    change = (
        F.when(F.col("_in_current_status").isNull(), "only_in_snapshot")
        .when(F.col("_in_snapshot_status").isNull(), "only_in_current")
        .when(~F.col("snapshot_status").eqNullSafe(F.col("current_status")), "status_changed")
    )
    return (
        joined.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select("method", "path", "change", "snapshot_status", "current_status")
    )


def _diff_two(df: DataFrame, is_a: Column, is_b: Column, order: Sequence[str]) -> DataFrame:
    position = F.struct(*order)
    pair = df.where(is_a | is_b).agg(
        F.min_by(comparable_record(), F.when(is_a, position)).alias("old"),
        F.min_by(comparable_record(), F.when(is_b, position)).alias("new"),
    )
    both = pair.where(F.col("old").isNotNull() & F.col("new").isNotNull())
    ids = [F.col("old.id").alias("id_a"), F.col("new.id").alias("id_b")]
    return explode_structs(both, ids, _diffs("old", "new"))


def diff_by_id(
    df: DataFrame, id_a: str, id_b: str, order_cols: Sequence[str] | None = None
) -> DataFrame:
    """Differing fields (field, old_value, new_value) of two requests; none if one is absent."""
    return _diff_two(df, F.col("id") == id_a, F.col("id") == id_b, input_order(df, order_cols))


def diff_by_index(
    df: DataFrame, index_a: int, index_b: int, order_cols: Sequence[str] | None = None
) -> DataFrame:
    """As :func:`diff_by_id` for two 0-based positions in the log."""
    indexed = with_row_index(df, input_order(df, order_cols), "_at")
    return _diff_two(indexed, F.col("_at") == index_a, F.col("_at") == index_b, ["_at"])
