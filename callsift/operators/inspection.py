"""Per-request diagnostics: anomaly scores and inspection warnings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.functions.headers import header_any_case
from callsift.functions.text import fixed_decimals, float_text, has_text, is_blank
from callsift.functions.validity import json_valid
from callsift.plans.ordering import input_order
from callsift.plans.rows import explode_structs

# Thresholds and points of the anomaly score.
SERVER_ERROR, CLIENT_ERROR = 500, 400
VERY_SLOW_MS, SLOW_MS = 3000, 1000
LARGE_BODY_CHARS = 10_000
HIGH_SCORE, MEDIUM_SCORE = 10, 5
# Texts of inspection warnings.
SLOW_TEXT = " ms exceeds threshold {:.1f} ms"
SERVER_ERROR_TEXT = "Server error: HTTP "
UNTYPED_BODY_TEXT = "Non-empty request body has no Content-Type header"
NOT_JSON_TEXT = "Content-Type is application/json but body is not valid JSON"
EMPTY_PATH_TEXT = "Request path is empty"


def score(df: DataFrame, min_score: int = 0, order_cols: Sequence[str] | None = None) -> DataFrame:
    """Add ``score``, ``band`` and ``reasons``; keep scores from ``min_score`` up.

    Sorted by score, highest first, ties in input order.
    """
    status, duration = F.col("response_status"), F.col("duration_ms")
    body_chars = F.coalesce(F.char_length("request_body"), F.lit(0))

    def reason(condition: Column, *parts: Column | str) -> Column:
        pieces = [F.lit(p) if isinstance(p, str) else p for p in parts]
        return F.when(condition, F.concat(*pieces))

    server = status >= SERVER_ERROR
    client = (status >= CLIENT_ERROR) & ~server
    very_slow = duration >= VERY_SLOW_MS
    slow = (duration >= SLOW_MS) & ~very_slow
    delete = F.col("method") == "DELETE"
    large = body_chars > LARGE_BODY_CHARS
    ms = float_text(duration)
    # Points and wording.
    points = [(server, 10), (client, 4), (very_slow, 6), (slow, 3), (delete, 1), (large, 2)]
    reasons = [
        reason(server, "Server error status ", status.cast("string")),
        reason(client, "Client error status ", status.cast("string")),
        reason(very_slow, "Very slow response ", ms, f"ms (>={VERY_SLOW_MS}ms)"),
        reason(slow, "Slow response ", ms, f"ms (>={SLOW_MS}ms)"),
        reason(delete, "Destructive method DELETE"),
        reason(large, "Large request body (", body_chars.cast("string"), " bytes)"),
    ]
    total = F.lit(0)
    for condition, n in points:
        total = total + F.when(condition, n).otherwise(0)
    band = F.when(F.col("score") >= HIGH_SCORE, "HIGH").when(F.col("score") >= MEDIUM_SCORE, "MED")
    # Texts come after the sort, which would sample and shuffle them.
    return (
        df.withColumn("score", total)
        .where(F.col("score") >= min_score)
        .orderBy(F.col("score").desc(), *input_order(df, order_cols))
        .withColumn("band", band.otherwise("LOW"))
        .withColumn("reasons", F.array_compact(F.array(*reasons)))
    )


def inspect(df: DataFrame, slow_threshold_ms: float = 1000.0) -> DataFrame:
    """Add ``warnings``: an array of (field, message), empty when all is well."""
    status, duration = F.col("response_status"), F.col("duration_ms")

    def warning(condition: Column, field: str, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(
            F.coalesce(condition, F.lit(False)),
            F.struct(F.lit(field).alias("field"), text.alias("message")),
        )

    def bad_json(side: str) -> Column:
        return has_text(F.col(f"{side}_body")) & ~F.col(f"_{side}_json")

    slow_text = F.concat(
        fixed_decimals(duration, 1), F.lit(SLOW_TEXT.format(slow_threshold_ms))
    )
    claims = {
        side: F.contains(
            header_any_case(F.col(f"{side}_headers"), "content-type"), F.lit("application/json")
        )
        & has_text(F.col(f"{side}_body"))
        for side in ("request", "response")
    }
    checked = df.withColumns({f"_{s}_claims": c for s, c in claims.items()}).withColumns(
        {
            f"_{s}_json": json_valid(F.col(f"{s}_body"), F.col(f"_{s}_claims"))
            | ~F.coalesce(F.col(f"_{s}_claims"), F.lit(False))
            for s in claims
        }
    )
    untyped = has_text(F.col("request_body")) & (
        header_any_case(F.col("request_headers"), "content-type") == ""
    )
    warnings = F.array(
        warning(duration > slow_threshold_ms, "duration_ms", slow_text),
        warning(
            status >= SERVER_ERROR,
            "response_status",
            F.concat(F.lit(SERVER_ERROR_TEXT), status.cast("string")),
        ),
        warning(untyped, "request_headers", UNTYPED_BODY_TEXT),
        warning(bad_json("request"), "request_body", NOT_JSON_TEXT),
        warning(bad_json("response"), "response_body", NOT_JSON_TEXT),
        warning(is_blank(F.col("path")), "path", EMPTY_PATH_TEXT),
    )
    helpers = [f"_{s}_{h}" for s in claims for h in ("claims", "json")]
    return checked.withColumn("warnings", F.array_compact(warnings)).drop(*helpers)


def inspection_warnings(inspected: DataFrame) -> DataFrame:
    """Long form: one row (record_id, position, field, message) per warning."""
    return explode_structs(inspected, [F.col("id").alias("record_id")], "warnings", "position")
