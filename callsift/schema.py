"""Canonical request schema, alias resolution and strict schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADERS = T.MapType(T.StringType(), T.StringType())

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query_string", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("request_headers", HEADERS),
        T.StructField("request_body", T.StringType()),
        T.StructField("response_status", T.IntegerType()),
        T.StructField("response_headers", HEADERS),
        T.StructField("response_body", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

# Other names under which captured logs carry a canonical column.
ALIASES = {
    "record_id": "id",
    "request_id": "id",
    "status_code": "response_status",
    "status": "response_status",
    "headers": "request_headers",
    "body": "request_body",
    "latency_ms": "duration_ms",
}
# Fixed value: the duration column that is carried in seconds.
SECONDS_ALIAS = "duration"

# Columns a log may leave out; of url and path at least one must be there.
OPTIONAL = ("seq", "service", "tags", "url", "path", "query_string")

# Scheme and authority are optional, so a bare "/path?query" parses as well.
_FROM_URL = {
    "path": r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)",
    "query_string": r"^[^?#]*\?([^#]*)",
}
_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"
_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ].*([zZ]|[+-]\d{2}(:?\d{2})?)$"


def ntz_micros(column: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ read as UTC, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), column)


def epoch_seconds(column: Column, data_type: T.DataType) -> Column:
    """Epoch seconds as DOUBLE from a number, a timestamp or ISO-8601 text.

    Values without a zone are UTC; text that cannot be read becomes 0.0.
    """
    if isinstance(data_type, T.TimestampNTZType):
        return ntz_micros(column) / F.lit(1e6)
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column) / F.lit(1e6)
    if not isinstance(data_type, T.StringType):
        return column.cast("double")
    text = F.trim(column)
    zoned = (
        F.when(text.rlike(_DATE_ONLY), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(_WITH_OFFSET), text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    instant = F.unix_micros(zoned.try_cast("timestamp")) / F.lit(1e6)
    return F.when(
        column.isNotNull(), F.coalesce(text.try_cast("double"), instant, F.lit(0.0))
    )


def _aliases_present(columns: list[str]) -> dict[str, str]:
    """Map each canonical name to the alias that stands for it, refusing ambiguity."""
    found: dict[str, str] = {}
    for alias, target in {**ALIASES, SECONDS_ALIAS: "duration_ms"}.items():
        if alias in columns:
            if target in columns or target in found:
                raise ValueError(f"more than one column stands for '{target}': '{alias}' as well")
            found[target] = alias
    return found


def conform(df: DataFrame, strict: bool = True) -> DataFrame:
    """Return ``df`` with exactly the canonical columns.

    ``strict`` raises ``ValueError`` for unknown columns and for missing ones;
    otherwise unknown columns are dropped and missing ones filled with null or
    an empty map/array.
    """
    names = {f.name for f in REQUEST_SCHEMA}
    aliases = _aliases_present(df.columns)
    known = names | set(aliases.values())
    unknown = [c for c in df.columns if c not in known]
    missing = [
        f.name
        for f in REQUEST_SCHEMA
        if f.name not in df.columns and f.name not in aliases and f.name not in OPTIONAL
    ]
    if "url" not in df.columns and "path" not in df.columns:
        missing.append("path")
    if strict and unknown:
        raise ValueError(f"unknown field(s): {', '.join(unknown)}")
    if strict and missing:
        raise ValueError(f"missing field(s): {', '.join(missing)}")
    return df.select(*canonical_columns(df, aliases))


def canonical_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> list[Column]:
    """Expressions of the canonical columns, derived, cast and defaulted as needed."""
    names = aliases or {}
    return [_canonical_column(df, f, names.get(f.name)) for f in REQUEST_SCHEMA]


def _canonical_column(df: DataFrame, field: T.StructField, alias: str | None) -> Column:
    name = alias or field.name
    if name not in df.columns:
        return _absent(df, field).alias(field.name)
    value, data_type = F.col(name), df.schema[name].dataType
    if field.name == "timestamp":
        value = epoch_seconds(value, data_type)
    elif isinstance(data_type, T.BinaryType):
        value = F.make_valid_utf8(value.cast("string"))
    elif name == SECONDS_ALIAS:
        value = value.cast("double") * F.lit(1000.0)
    value = value.cast(field.dataType)
    if isinstance(field.dataType, T.MapType):
        value = F.coalesce(value, _empty_map())
    elif isinstance(field.dataType, T.ArrayType):
        value = F.coalesce(value, F.array().cast(field.dataType))
    elif field.name in _FROM_URL and "url" in df.columns:
        value = F.coalesce(value, F.regexp_extract(F.col("url"), _FROM_URL[field.name], 1))
    return value.alias(field.name)


def _absent(df: DataFrame, field: T.StructField) -> Column:
    if field.name in _FROM_URL and "url" in df.columns:
        return F.regexp_extract(F.col("url"), _FROM_URL[field.name], 1)
    if isinstance(field.dataType, T.MapType):
        return _empty_map()
    if isinstance(field.dataType, T.ArrayType):
        return F.array().cast(field.dataType)
    return F.lit(None).cast(field.dataType)


def _empty_map() -> Column:
    return F.create_map().cast(HEADERS)
