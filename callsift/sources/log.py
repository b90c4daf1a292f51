"""Reading and appending request logs (JSON Lines at the edge, Parquet inside)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.schema import (
    ALIASES,
    OPTIONAL,
    REQUEST_SCHEMA,
    SECONDS_ALIAS,
    canonical_columns,
    conform,
)

_NAMES = {
    f.name: [f.name, *[a for a, target in ALIASES.items() if target == f.name]]
    for f in REQUEST_SCHEMA
}
_ACCEPTED = [*[n for names in _NAMES.values() for n in names], SECONDS_ALIAS]
CORRUPT = "_corrupt_record"
_END = "_callsift_end"
_BAD = "_callsift_bad"
# White space around a line (fixed values: what str.strip removes, without the line ends of a file).
_SPACES = " \t\x0b\x0c\r\n\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DAY = "day"


def _line_schema() -> T.StructType:
    """Every accepted name; times as text because they are numbers or ISO-8601.

    Whole numbers are read as doubles, since writers may put ``200.0``.
    """
    fields = [T.StructField(SECONDS_ALIAS, T.DoubleType())]
    for target in REQUEST_SCHEMA:
        data_type = T.StringType() if target.name == "timestamp" else target.dataType
        if isinstance(data_type, T.IntegerType):
            data_type = T.DoubleType()
        fields += [T.StructField(name, data_type) for name in _NAMES[target.name]]
    return T.StructType(fields)


def read_log(
    spark: SparkSession,
    path: str | list[str],
    format: str = "json",
    strict: bool = True,
    mode: str = "FAILFAST",
    since: float | None = None,
    until: float | None = None,
) -> DataFrame:
    """Requests in canonical form; an absent path gives no rows.

    ``since`` (inclusive) and ``until`` (exclusive) bound the timestamp; on a
    Parquet log partitioned by day they also select the days that are read.

    JSON Lines: blank lines are skipped.  ``FAILFAST`` raises on a line that is
    not exactly one record, has a value of a wrong type or a null id, also when
    rows are only counted; with ``strict`` also on unknown or missing fields.
    ``PERMISSIVE`` keeps such lines in ``_corrupt_record``, other columns null.
    """
    if format not in ("json", "parquet"):
        raise ValueError(f"format must be 'json' or 'parquet', got '{format}'")
    paths = [path] if isinstance(path, str) else list(path)
    try:
        if format == "parquet":
            stored = spark.read.parquet(*paths)
            if DAY in stored.columns:
                stored = _between(stored, DAY, _day(since), _day(until), whole_end=True).drop(DAY)
            requests = conform(stored, strict)
        else:
            requests = parse_lines(spark.read.text(paths), strict, mode)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REQUEST_SCHEMA)
    return _between(requests, "timestamp", since, until)


def _between(df: DataFrame, column: str, since, until, whole_end: bool = False) -> DataFrame:
    if since is not None:
        df = df.where(F.col(column) >= since)
    if until is not None:
        df = df.where(F.col(column) <= until if whole_end else F.col(column) < until)
    return df


def _day(instant: float | None) -> date | None:
    return None if instant is None else datetime.fromtimestamp(instant, timezone.utc).date()


def parse_lines(lines: DataFrame, strict: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Canonical requests from a DataFrame (or stream) of JSON lines in ``value``."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode must be 'FAILFAST' or 'PERMISSIVE', got '{mode}'")
    lines = lines.select(F.trim("value", F.lit(_SPACES)).alias("value")).where(F.col("value") != "")
    # In an array with an end mark after the line, whatever else the line holds keeps the mark from being the
    # second entry.  The mark is a hash of the line, so no line can bring its own.
    mark = F.xxhash64("value").cast("string")
    closed = F.concat(F.lit("["), "value", F.lit(f',{{"{_END}":"'), mark, F.lit('"}]'))
    typed = F.from_json("value", _line_schema().add(_BAD, T.StringType()), {"columnNameOfCorruptRecord": _BAD})
    both = F.struct(F.from_json(closed, "array<map<string,string>>").alias("whole"), typed.alias("r"))
    # Behind a generator what is parsed or judged is not put in for each of its many uses.
    read = lines.select("value", F.explode_outer(F.array(both)).alias("read")).select("value", "read.whole", "read.r")
    one = (F.size("whole") == 2) & (F.get("whole", F.lit(1))[_END] == mark)
    fields = F.when(one, F.get("whole", F.lit(0)))
    judged = read.select("value", "r", F.explode_outer(F.array(fields)).alias("f"))
    problem = F.when(~_sound(), _problem(strict))
    if mode == "FAILFAST":
        # A filter runs even where no column is asked for.
        parsed = judged.where(_raised(problem)).select("r")
    else:
        marked = judged.select("value", "r", F.explode_outer(F.array(problem)).alias("p"))
        record = F.when(F.col("p").isNull(), F.col("r"))
        parsed = marked.select(record.alias("r"), F.when(F.col("p").isNotNull(), F.col("value")).alias(CORRUPT))
    kept = [] if mode == "FAILFAST" else [CORRUPT]
    merged = parsed.select(*[_any_name(f.name).try_cast(_kind(f)).alias(f.name) for f in REQUEST_SCHEMA], *kept)
    return merged.select(*canonical_columns(merged), *kept)


def _raised(problem: Column) -> Column:
    """True for a good line; the error of a bad one."""
    return F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))


def _kind(field: T.StructField) -> T.DataType:
    return T.StringType() if field.name == "timestamp" else field.dataType


def _any_name(name: str) -> Column:
    """The value of a canonical column under whichever accepted name the line has."""
    values = [F.col(f"r.{n}") for n in _NAMES[name]]
    if name == "duration_ms":
        values.append(F.col(f"r.{SECONDS_ALIAS}") * F.lit(1000.0))
    return F.coalesce(*values)


def _required() -> dict[str, list[str]]:
    """The names of which a line must have one, by the column they stand for."""
    groups = {n: _NAMES[n] for n in _NAMES if n not in OPTIONAL} | {"path": ["path", "url"]}
    groups["duration_ms"] = [*groups["duration_ms"], SECONDS_ALIAS]
    return groups


def _whole_status() -> Column:
    status = F.col("r.response_status")
    return (status == F.rint(status)) & (F.abs(status) < 2.0**31)


def _sound() -> Column:
    """Whether a line surely has no problem; other lines are judged by :func:`_problem`, field by field.

    It has an id and every required column under its own name, no unknown name, no
    name twice, and all its values could be read as their types.
    """
    keys = F.map_keys("f")
    known, wanted = (F.array(*[F.lit(n) for n in names]) for names in (_ACCEPTED, _required()))
    tests = [
        F.col(f"r.{_BAD}").isNull(),
        F.col("r.id").isNotNull(),
        F.coalesce(_whole_status(), F.lit(True)),
        F.size(F.array_except(wanted, keys)) == 0,
        F.size(F.array_except(keys, known)) == 0,
        F.size(F.array_distinct(keys)) == F.size(keys),
    ]
    return F.col("f").isNotNull() & reduce(and_, tests)


def _problem(strict: bool) -> Column:
    """What is wrong with a line, null when nothing is.

    ``f`` holds the line's fields as text (null if the line is not exactly one
    record), ``r`` the typed ones.
    """

    def listed(label: str, names: Column) -> Column:
        where = F.concat(F.lit(f"{label} field(s) "), F.array_join(names, ", "), F.lit(" in record: "))
        return F.when(F.size(names) > 0, F.concat(where, F.col("value")))

    def given(name: str) -> Column:
        return F.try_element_at("f", F.lit(name)).isNotNull()

    malformed = F.when(F.col("f").isNull(), F.concat(F.lit("malformed record: "), F.col("value")))
    wrong = [F.when(given(n) & F.col(f"r.{n}").isNull(), F.lit(n)) for n in _ACCEPTED]
    wrong.append(F.when(~_whole_status(), F.lit("response_status")))
    keys = F.map_keys("f")
    nameless = F.arrays_overlap(keys, F.array(*[F.lit(n) for n in _NAMES["id"]])) & ~_any_given(_NAMES["id"], given)
    wrong.append(F.when(nameless, F.lit("id")))
    mistyped = listed("wrong type in", F.array_compact(F.array(*wrong)))
    if not strict:
        return F.coalesce(malformed, mistyped)
    unknown = F.array_except(keys, F.array(*[F.lit(n) for n in _ACCEPTED]))
    missing = F.array_compact(
        F.array(
            *[
                F.when(~F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names])), F.lit(target))
                for target, names in _required().items()
            ]
        )
    )
    return F.coalesce(malformed, listed("unknown", unknown), listed("missing", missing), mistyped)


def _any_given(names: list[str], given: Callable[[str], Column]) -> Column:
    return reduce(or_, [given(n) for n in names])


def append_log(df: DataFrame, path: str, format: str = "json", daily: bool = False) -> None:
    """Append requests as new files; existing files are never changed.

    ``daily`` partitions a Parquet log by UTC day.  Rows are rebalanced by day
    first: few files per day, and several tasks for a busy one.
    """
    if format not in ("json", "parquet"):
        raise ValueError(f"format must be 'json' or 'parquet', got '{format}'")
    if format == "json":
        df.write.mode("append").option("ignoreNullFields", "false").json(path)
        return
    if daily:
        day = F.date_add(F.lit(date(1970, 1, 1)), F.floor(F.col("timestamp") / 86400).cast("int"))
        dated = df.withColumn(DAY, day).hint("rebalance", DAY)
        dated.write.mode("append").partitionBy(DAY).parquet(path)
    else:
        df.write.mode("append").parquet(path)
