"""Renderings of requests: JSON, CSV, curl commands and access-log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.functions.headers import header
from callsift.functions.text import fixed_decimals, float_text, has_text

# The separators and columns of the export formats.
CURL_SEPARATOR = " \\\n"
CSV_COLUMNS = ("id", "timestamp", "method", "path", "query_string", "status_code", "duration_ms")


def csv_columns(df: DataFrame) -> DataFrame:
    """The seven columns of the CSV export, numbers as shortest decimal text."""
    return df.select(
        "id",
        float_text(F.col("timestamp")).alias("timestamp"),
        "method",
        "path",
        "query_string",
        F.col("response_status").alias("status_code"),
        float_text(F.col("duration_ms")).alias("duration_ms"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nulls and empty texts are empty, quotes are doubled."""
    options = {"header": "true", "escape": '"', "nullValue": "", "emptyValue": ""}
    csv_columns(df).write.options(**options).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, all fields, nulls included."""
    df.write.option("ignoreNullFields", "false").json(path)


def _quoted_lines(headers: Column, before: str, after: str) -> Column:
    """Array with one text per header, in map order; a null value is empty."""
    return F.transform(
        F.map_entries(headers),
        lambda e: F.concat(F.lit(before), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")), F.lit(after)),
    )


def curl_commands(df: DataFrame) -> DataFrame:
    """(id, command): an equivalent curl call of each request (fixed texts)."""
    host = header(F.col("request_headers"), "Host", "localhost")
    query = F.when(has_text(F.col("query_string")), F.concat(F.lit("?"), "query_string"))
    url = F.concat(F.lit("  'http://"), host, F.coalesce("path", F.lit("")), F.coalesce(query, F.lit("")), F.lit("'"))
    body = F.replace(F.col("request_body"), F.lit("'"), F.lit("'\\''"))
    data = F.when(has_text(F.col("request_body")), F.concat(F.lit("  -d '"), body, F.lit("'")))
    first = F.concat(F.lit("curl -X "), F.coalesce("method", F.lit("GET")))
    parts = F.concat(
        F.array(first),
        _quoted_lines(F.col("request_headers"), "  -H '", "'"),
        F.array_compact(F.array(data, url)),
    )
    return df.select("id", F.array_join(parts, CURL_SEPARATOR).alias("command"))


def log_lines(
    df: DataFrame, show_headers: bool = False, show_body: bool = False, max_body_len: int = 256
) -> DataFrame:
    """(id, line): ``[time] METHOD path -> status  (ms)``, optionally headers and bodies."""
    none = F.lit("None")
    first = F.concat(
        F.lit("["),
        F.coalesce(float_text(F.col("timestamp")), none),
        F.lit("] "),
        F.coalesce("method", none),
        F.lit(" "),
        F.coalesce("path", none),
        F.lit(" -> "),
        F.coalesce(F.col("response_status").cast("string"), none),
        F.lit("  ("),
        F.coalesce(fixed_decimals(F.col("duration_ms"), 1), none),
        F.lit(" ms)"),
    )
    parts = [F.array(first)]
    if show_headers:
        for side in ("request", "response"):
            headers = F.col(f"{side}_headers")
            title = F.array(F.lit(f"  {side.capitalize()} Headers:"))
            block = F.concat(title, _quoted_lines(headers, "    ", ""))
            parts.append(F.when(F.size(headers) > 0, block).otherwise(F.array().cast("array<string>")))
    if show_body:
        snippets = []
        for side in ("request", "response"):
            body = F.col(f"{side}_body")
            more = F.when(F.char_length(body) > max_body_len, F.lit("…")).otherwise(F.lit(""))
            shown = F.concat(
                F.lit(f"  {side.capitalize()} Body: "), F.substring(body, 1, max_body_len), more
            )
            snippets.append(F.when(has_text(body), shown))
        parts.append(F.array_compact(F.array(*snippets)))
    return df.select("id", F.array_join(F.concat(*parts), "\n").alias("line"))


def write_lines(rendered: DataFrame, column: str, path: str) -> None:
    """Write one rendered column as text, records apart by a blank line."""
    rendered.select(column).write.option("lineSep", "\n\n").text(path)
