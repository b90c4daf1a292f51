"""Key expressions: endpoints, status classes, fingerprints, sampling buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsift.functions.headers import sorted_entries
from callsift.functions.text import path_prefix


def as_condition(predicate: Column | str | None) -> Column:
    """A predicate as a Column that is never null: null counts as no match."""
    if predicate is None:
        return F.lit(True)
    column = F.expr(predicate) if isinstance(predicate, str) else predicate
    return F.coalesce(column.cast("boolean"), F.lit(False))


def upper_method() -> Column:
    return F.upper("method")


def status_class(unknown: str | None = None) -> Column:
    """``2xx`` and the like; a null status gives ``unknown``."""
    label = F.concat(F.floor(F.col("response_status") / 100).cast("string"), F.lit("xx"))
    return label if unknown is None else F.coalesce(label, F.lit(unknown))


def status_text() -> Column:
    return F.col("response_status").cast("string")


def named_key(key: str | Column, depth: int = 1) -> Column:
    """``method``, ``status_class``, ``status`` or ``path_prefix``; a Column passes through."""
    if isinstance(key, Column):
        return key
    known = {
        "method": upper_method,
        "status_class": status_class,
        "status": status_text,
        "path_prefix": lambda: path_prefix(F.col("path"), depth),
    }
    if key not in known:
        raise ValueError(f"unknown key '{key}'; choose from {sorted(known)}")
    return known[key]()


def fingerprint() -> Column:
    """SHA-256 of method, path, query, request headers in any order, and body."""
    identity = F.struct(
        F.col("method"),
        F.col("path"),
        F.col("query_string"),
        sorted_entries(F.col("request_headers")).alias("request_headers"),
        F.col("request_body"),
    )
    return F.sha2(F.to_json(identity), 256)


def sample_bucket(text: Column, buckets: int = 10_000) -> Column:
    """MD5 of ``text``, read as one 128-bit number, modulo ``buckets``.

    The digest is folded in four 32-bit steps so that it fits BIGINT.
    """
    digest = F.md5(text.cast("binary"))
    shift = (1 << 32) % buckets
    folded = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        folded = F.pmod(folded * shift + word, F.lit(buckets))
    return folded
