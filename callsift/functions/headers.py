"""Expressions over header maps (``MAP<STRING,STRING>``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsift.functions.text import strip

# Headers that carry a correlation id, in order of priority.
CORRELATION_HEADERS = ("x-correlation-id", "x-request-id", "x-trace-id", "traceparent")
# Fixed value: the chain of requests without any of them.
UNCORRELATED = "__uncorrelated__"


def header(headers: Column, name: str, default: str = "") -> Column:
    """Value under the exact name, else ``default``."""
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(default))


def header_any_case(headers: Column, name: str) -> Column:
    """Value under ``name`` in any letter case; the last such entry wins; else ``''``."""
    same = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.try_element_at(same, F.lit(-1))["value"], F.lit(""))


def rebuild(headers: Column, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """Map with rewritten keys and values; keys that collide keep the last value."""
    entries = F.transform(
        F.map_entries(headers),
        lambda e: F.struct(key(e["key"]).alias("key"), value(e["value"]).alias("value")),
    )
    latest = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + F.lit(2), F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )
    return F.map_from_entries(latest)


def normalized(headers: Column) -> Column:
    return rebuild(headers, lambda k: strip(F.lower(k)), strip)


def sorted_entries(headers: Column) -> Column:
    """Entries as a sorted array: maps themselves have no equality or order."""
    return F.sort_array(F.map_entries(headers))


def correlation_id(headers: Column) -> Column:
    """First non-empty correlation header, else :data:`UNCORRELATED`."""
    found = [F.nullif(header_any_case(headers, name), F.lit("")) for name in CORRELATION_HEADERS]
    return F.coalesce(*found, F.lit(UNCORRELATED))
