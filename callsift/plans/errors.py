"""Errors of user expressions, contained in the row that causes them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ANSI = "spark.sql.ansi.enabled"


@contextmanager
def errors_as_null(spark: SparkSession) -> Iterator[None]:
    """Expressions of DataFrames built inside give null where they would raise.

    Spark fixes how an expression treats errors when it analyses it, so the
    setting only has to hold while a DataFrame is built, not while it runs.
    Division by zero, values that do not fit a cast and missing array elements
    become null.  Whole numbers that overflow wrap around (use ``try_add`` and the
    like), and ``raise_error`` still raises.  The setting belongs to the session:
    do not build other DataFrames of it in another thread meanwhile.
    """
    before = spark.conf.get(_ANSI)
    spark.conf.set(_ANSI, "false")
    try:
        yield
    finally:
        spark.conf.set(_ANSI, before)


def contained(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a DataFrame whose predicates and transforms give null instead of raising."""

    @functools.wraps(operator)
    def build(df: DataFrame, *args, **kwargs) -> DataFrame:
        with errors_as_null(df.sparkSession):
            return operator(df, *args, **kwargs)

    return build
