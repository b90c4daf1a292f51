"""Row-level rewrites: normalize, anonymize, redact, truncate, patch, rename.

All are narrow projections.  Each adds a flag column that tells whether the row
was changed; :func:`change_counts` turns a flag into counters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.functions import text
from callsift.functions.headers import normalized, sorted_entries
from callsift.functions.keys import as_condition
from callsift.plans.errors import contained

# What stands for masked text and marks cut text.
MASK = "[REDACTED]"
TRUNCATION_MARKER = "...[truncated]"

# Header names and JSON body keys that are masked by default.
SENSITIVE_HEADERS = ("authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token")
SENSITIVE_BODY_KEYS = ("password", "token", "secret", "api_key")

_BODIES = ("request_body", "response_body")
_HEADER_MAPS = ("request_headers", "response_headers")


def normalize(df: DataFrame) -> DataFrame:
    """Clean paths, header names and values, bodies and methods; flag ``changed``.

    A method that only changes its case or spacing does not count as a change.
    """
    old = df.withColumns(
        {
            "_path": text.clean_path(F.col("path")),
            **{f"_{h}": normalized(F.col(h)) for h in _HEADER_MAPS},
            **{f"_{b}": text.strip(F.col(b)) for b in _BODIES},
        }
    )
    differs = [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("path", *_BODIES)]
    differs += [
        ~sorted_entries(F.col(h)).eqNullSafe(sorted_entries(F.col(f"_{h}"))) for h in _HEADER_MAPS
    ]
    flagged = old.withColumn("changed", _any(differs))
    cleaned = {c: F.col(f"_{c}") for c in ("path", *_BODIES, *_HEADER_MAPS)}
    cleaned["method"] = text.strip(F.upper("method"))
    return flagged.withColumns(cleaned).drop(*[f"_{c}" for c in ("path", *_BODIES, *_HEADER_MAPS)])


def anonymize(
    df: DataFrame,
    headers: Sequence[str] | None = None,
    body_patterns: Sequence[str] | None = None,
) -> DataFrame:
    """Mask sensitive header values on both sides and JSON values in the request body.

    Inside each match of a custom pattern, the quoted text behind a colon is
    masked.  Empty lists mean the defaults.  The response body is left alone;
    use :func:`redact` for it.
    """
    names = [h.lower() for h in (headers or SENSITIVE_HEADERS)]

    def mask(headers_col: str) -> Column:
        return F.transform_values(
            headers_col, lambda k, v: F.when(F.lower(k).isin(names), F.lit(MASK)).otherwise(v)
        )

    body = F.col("request_body")
    if body_patterns:
        for pattern in body_patterns:
            body = _mask_inside_matches(body, text.java_pattern(pattern))
    else:
        for key in SENSITIVE_BODY_KEYS:
            body = F.regexp_replace(body, rf'(?iU)("{key}"\s*:\s*)"[^"]*"', f'$1"{MASK}"')
    return df.withColumns({h: mask(h) for h in _HEADER_MAPS} | {"request_body": body})


def _mask_inside_matches(body: Column, pattern: str) -> Column:
    matches = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    masked = F.transform(
        matches, lambda m: F.regexp_replace(m, r'(?U)(:\s*)"[^"]*"', f'$1"{MASK}"')
    )
    between = F.split(body, pattern, -1)
    pieces = F.zip_with(between, masked, lambda b, m: F.concat(b, F.coalesce(m, F.lit(""))))
    return F.when(F.size(matches) > 0, F.array_join(pieces, "")).otherwise(body)


@dataclass(frozen=True)
class RedactRule:
    """Replace every case-insensitive match of ``pattern`` in one field.

    Patterns use Python syntax for groups and back-references.  For a header
    map the rule acts on values, never on names.
    """

    field: str
    pattern: str
    replacement: str = MASK
    predicate: Column | str | None = None


@contained
def redact(df: DataFrame, rules: Sequence[RedactRule]) -> DataFrame:
    """Apply the rules in turn; predicates see the original row; flag ``redacted``.

    The flag is set when any single step changed something, even if a later
    step put the old text back.
    """

    def rewrite(rule: RedactRule) -> Callable[[Column], Column]:
        pattern, replacement = text.java_pattern(rule.pattern), text.java_replacement(rule.replacement)

        def on_text(value: Column) -> Column:
            return F.regexp_replace(value, pattern, replacement)

        if rule.field in _HEADER_MAPS:
            return lambda value: F.transform_values(value, lambda _, v: on_text(v))
        return on_text

    fields = (*_BODIES, *_HEADER_MAPS)
    steps = [(r.field, rewrite(r), r.predicate) for r in rules if r.field in fields]
    return _chain(df, steps, "redacted", per_step=True)


@dataclass(frozen=True)
class PatchRule:
    """Rewrite one column with ``transform`` where ``predicate`` holds.

    A transform that makes null of a value has failed, as one that raises
    becomes null; with ``nulls`` null is a value like any other.
    """

    field: str
    transform: Callable[[Column], Column]
    predicate: Column | str | None = None
    nulls: bool = False


@contained
def patch(df: DataFrame, rules: Sequence[PatchRule], failed: str | None = None) -> DataFrame:
    """Apply the rules in turn; predicates see the original row; flag ``patched``.

    Rules for columns that do not exist are ignored.  A row on which a transform
    fails keeps all its values; ``failed`` names a further flag for such rows.  A
    failing predicate is no match.  The flag compares the row with the original;
    write the result to a new path, it replaces the input.
    """
    rules = [r for r in rules if r.field in df.columns]
    steps = [(r.field, r.transform, r.predicate) for r in rules]
    return _chain(df, steps, "patched", per_step=False, strict=[not r.nulls for r in rules], failed=failed)


def patch_counts(df: DataFrame, rules: Sequence[PatchRule]) -> DataFrame:
    """One row: total, changed, skipped (failed ones included) and failed rows, in one scan."""
    marked = patch(df, rules, failed="_failed")
    return marked.agg(
        F.count("*").alias("total"),
        F.count_if("patched").alias("changed"),
        F.count_if(~F.col("patched")).alias("skipped"),
        F.count_if("_failed").alias("failed"),
    )


def _chain(
    df: DataFrame, steps: Sequence[tuple], flag: str, per_step: bool, strict: Sequence[bool] = (), failed: str | None = None
) -> DataFrame:
    """Fold rewrite steps over columns, one projection per step.

    Steps marked in ``strict`` fail where they make null of a value, and the row
    then gets back what it had; ``failed`` names a flag for that.

    Conditions are columns of the first projection because they are about the
    original row; separate projections keep the expression size linear.
    """
    touched = list(dict.fromkeys(name for name, _, _ in steps))
    work = df.withColumns(
        {f"_if{i}": as_condition(p) for i, (_, _, p) in enumerate(steps)}
        | {f"_was_{c}": F.col(c) for c in touched}
        | {"_flag": F.lit(False), "_failed": F.lit(False)}
    )
    for i, (name, transform, _) in enumerate(steps):
        stepped = work.withColumn(
            "_next", F.when(F.col(f"_if{i}"), transform(F.col(name))).otherwise(F.col(name))
        )
        if strict and strict[i]:
            lost = F.col("_next").isNull() & F.col(name).isNotNull()
            stepped = stepped.withColumn("_failed", F.col("_failed") | lost)
        if per_step:
            stepped = stepped.withColumn("_flag", F.col("_flag") | _differs(df, name, "_next"))
        work = stepped.withColumn(name, F.col("_next")).drop("_next")
    if any(strict):
        work = work.withColumns({c: F.when(F.col("_failed"), F.col(f"_was_{c}")).otherwise(F.col(c)) for c in touched})
    if not per_step:
        work = work.withColumn("_flag", _any([_differs(df, c, f"_was_{c}") for c in touched]))
    if failed:
        work = work.withColumn(failed, F.col("_failed"))
    return work.withColumn(flag, F.col("_flag")).drop(
        "_flag", *([] if failed == "_failed" else ["_failed"]), *[f"_was_{c}" for c in touched], *[f"_if{i}" for i in range(len(steps))]
    )


def _differs(df: DataFrame, left: str, right: str) -> Column:
    a, b = F.col(left), F.col(right)
    if df.schema[left].dataType.typeName() == "map":
        a, b = sorted_entries(a), sorted_entries(b)
    return ~a.eqNullSafe(b)


def _any(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def truncate(df: DataFrame, max_bytes: int = 4096) -> DataFrame:
    """Cut both bodies to ``max_bytes`` UTF-8 bytes plus a marker; flag ``truncated``."""
    if max_bytes < 0:
        raise ValueError(f"max_bytes must be >= 0, got {max_bytes}")
    too_long = _any([F.coalesce(F.octet_length(b) > max_bytes, F.lit(False)) for b in _BODIES])
    return df.withColumn("truncated", too_long).withColumns(
        {b: text.truncate_utf8(F.col(b), max_bytes, TRUNCATION_MARKER) for b in _BODIES}
    )


@dataclass(frozen=True)
class RenameRule:
    """Set ``columns`` (name to Column) on rows where ``predicate`` holds."""

    predicate: Column | str
    columns: dict[str, Column] = field(default_factory=dict)
    description: str = ""


def replace_path_prefix(old: str, new: str, description: str | None = None) -> RenameRule:
    rest = F.expr(f"substring(path, {len(old) + 1})")
    return RenameRule(
        F.col("path").startswith(old),
        {"path": F.concat(F.lit(new), rest)},
        description or f"path prefix '{old}' becomes '{new}'",
    )


@contained
def rename(df: DataFrame, rules: Sequence[RenameRule]) -> DataFrame:
    """Rewrite each row by the first rule that matches; flag ``renamed``."""
    conditions = [as_condition(r.predicate) for r in rules]
    changes: dict[str, Column] = {}
    for name in dict.fromkeys(c for r in rules for c in r.columns):
        value = F.col(name)
        for rule, condition in reversed(list(zip(rules, conditions))):
            value = F.when(condition, rule.columns.get(name, F.col(name))).otherwise(value)
        changes[name] = value
    return df.withColumns(changes | {"renamed": _any(conditions)})


def change_counts(df: DataFrame, flag: str) -> DataFrame:
    """One row: total, changed and unchanged rows of a flagged transform."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(flag).alias("changed"),
        F.count_if(~F.col(flag)).alias("unchanged"),
    )
