"""Rule sets: tag, label, classify, highlight, validate.

A rule pairs a name with a predicate (Column or SQL text).  A null predicate is
no match, except in validation, where it is a failure.  So is a predicate that
would raise on a row (:mod:`callsift.plans.errors`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.functions.keys import as_condition
from callsift.functions.text import strip
from callsift.plans.errors import contained
from callsift.plans.rows import explode_structs


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: Column | str
    message: str = ""


# The default rule sets and their thresholds.
DEFAULT_TAGS = (
    Rule("slow", "duration_ms > 1000"),
    Rule("error", "response_status >= 500"),
    Rule("client-error", "response_status >= 400 and response_status < 500"),
    Rule("post", "upper(method) = 'POST'"),
    Rule("get", "upper(method) = 'GET'"),
    Rule("large-body", "char_length(request_body) > 4096"),
)
DEFAULT_HIGHLIGHTS = (
    Rule("server-error", "response_status >= 500"),
    Rule("client-error", "response_status >= 400 and response_status < 500"),
    Rule("slow", "duration_ms > 1000"),
)


def default_labels(slow_threshold_ms: float = 1000) -> tuple[Rule, ...]:
    # Label names, thresholds and mutating methods.
    return (
        Rule("slow", F.col("duration_ms") > slow_threshold_ms, "slow response"),
        Rule("error", "response_status >= 500", "5xx response"),
        Rule("client-error", "response_status >= 400 and response_status < 500", "4xx response"),
        Rule("large-response", "char_length(response_body) > 10000", "large response body"),
        Rule("mutation", "method in ('POST', 'PUT', 'PATCH', 'DELETE')", "mutating method"),
    )


def all_matches(rules: Sequence[Rule]) -> Column:
    """Names of all matching rules, in rule order."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(
        F.array(*[F.when(as_condition(r.predicate), F.lit(r.name)) for r in rules])
    )


def first_match(rules: Sequence[Rule]) -> Column:
    """Name of the first matching rule, else null."""
    value = F.lit(None).cast("string")
    for rule in reversed(rules):
        value = F.when(as_condition(rule.predicate), F.lit(rule.name)).otherwise(value)
    return value


@contained
def tag(df: DataFrame, rules: Sequence[Rule] = DEFAULT_TAGS) -> DataFrame:
    """Add ``matched_tags``: every tag whose rule holds."""
    return df.withColumn("matched_tags", all_matches(rules))


@contained
def label(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``labels``: every label whose rule holds."""
    return df.withColumn("labels", all_matches(default_labels() if rules is None else rules))


def label_counts(labeled: DataFrame) -> DataFrame:
    names = labeled.select(F.explode_outer("labels").alias("label"))
    return names.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))


def label_totals(labeled: DataFrame) -> DataFrame:
    return labeled.agg(
        F.count("*").alias("total"), F.count_if(F.size("labels") > 0).alias("labeled")
    )


@contained
def classify(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``category``: the first rule that holds, null when unclassified."""
    return df.withColumn("category", first_match(rules))


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(F.count("*").alias("n"))


@contained
def highlight(df: DataFrame, rules: Sequence[Rule] = DEFAULT_HIGHLIGHTS) -> DataFrame:
    """Add ``rule``: the first highlight rule that holds, else null."""
    return df.withColumn("rule", first_match(rules))


def highlighted_only(df: DataFrame, rules: Sequence[Rule] = DEFAULT_HIGHLIGHTS) -> DataFrame:
    return highlight(df, rules).where(F.col("rule").isNotNull())


# Names and messages of the built-in checks.
def status_below_500() -> Rule:
    return Rule("no_server_error", "response_status < 500", "Response status code is 5xx (server error).")


def non_empty_path() -> Rule:
    return Rule("non_empty_path", strip(F.col("path")) != "", "Request path is empty.")


def duration_at_most(max_ms: float) -> Rule:
    return Rule(
        f"duration_below_{int(max_ms)}ms",
        F.col("duration_ms") <= float(max_ms),
        f"Request duration exceeds {max_ms} ms.",
    )


@contained
def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row (record_id, rule_name, message) per failing rule of each request."""
    failures = [
        F.when(
            ~as_condition(r.predicate),
            F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.message).alias("message")),
        )
        for r in rules
    ]
    if not failures:
        return df.where(F.lit(False)).select(
            F.col("id").alias("record_id"), F.lit("").alias("rule_name"), F.lit("").alias("message")
        )
    return explode_structs(
        df, [F.col("id").alias("record_id")], F.array_compact(F.array(*failures))
    )


@contained
def validation_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row: total requests, errors, and requests whose id has no error.

    Failures are counted per row first, then per id, so the distinct ids are
    found by a partial aggregate.
    """
    failing = F.lit(0)
    for rule in rules:
        failing = failing + (~as_condition(rule.predicate)).cast("int")
    per_id = (
        df.select("id", failing.alias("_errors"))
        .groupBy("id")
        .agg(F.count("*").alias("_rows"), F.sum("_errors").alias("_errors"))
    )
    return per_id.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("_errors"), F.lit(0)).alias("errors"),
        (F.coalesce(F.sum("_rows"), F.lit(0)) - F.count_if(F.col("_errors") > 0)).alias("valid"),
    )
