"""Request tables derived from the driver's test tables, whole tables each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.schema import epoch_seconds

# Instants that part the capture (2024-01-11, -16 and -21, UTC).
EARLY, MIDDLE, LATE = 1704931200.0, 1705363200.0, 1705795200.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map(**entries: Column) -> Column:
    """Header map of the non-null entries; ``_`` in a name stands for ``-``."""
    parts = []
    for name, value in entries.items():
        one = F.create_map(F.lit(name.replace("_", "-")), value)
        parts.append(F.when(value.isNotNull(), one).otherwise(_no_headers()))
    return F.map_concat(*parts)


def _no_headers() -> Column:
    return F.create_map().cast("map<string,string>")


_K = "cast(get_json_object(props, '$.k') as int) as k"
_NONE = "cast(map() as map<string,string>)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per row of ``events``."""
    events = _table(spark, sf_dir, "events")
    # Projections of their own, so that the JSON is parsed once per row.
    parsed = events.withColumn(
        "timestamp", epoch_seconds(F.col("ts"), events.schema["ts"].dataType)
    ).selectExpr("*", _K)
    coded = parsed.selectExpr(
        "*",
        """cast(case when event_type = 'error' then 500 + k % 4 when k % 10 = 0 then 404
          when k % 10 = 1 then 301 else 200 end as int) as response_status""",
    )
    return coded.selectExpr(
        "cast(event_id as string) as id",
        "event_id as seq",
        "timestamp",
        """case event_type when 'view' then 'GET' when 'click' then 'get' when 'purchase' then 'POST'
          when 'signup' then 'PUT' else 'DELETE' end as method""",
        "concat('/api/', event_type, '/', user_id % 10) as path",
        "if(k % 3 = 0, '', concat('k=', k)) as query_string",
        f"""map_concat(map('Host', concat('svc', k % 5)),
          if(k % 4 <> 0, map('X-Correlation-ID', concat('corr-', user_id, '-', k % 7)), {_NONE}),
          case event_type when 'purchase' then map('Content-Type', 'application/json')
            when 'signup' then map('Content-Type', 'application/json; charset=utf-8')
            else {_NONE} end) as request_headers""",
        """case when event_type in ('purchase', 'error') then props
          when event_type = 'signup' then replace(props, '}', '') end as request_body""",
        "response_status",
        """map('Content-Type', if(response_status >= 400, 'application/json', 'text/html'))
          as response_headers""",
        """case when response_status >= 500 then concat('{"error": ', response_status)
          when response_status = 404 then '{"error": 404}' else '' end as response_body""",
        "value * 10 as duration_ms",
        """array_compact(array(event_type, if(k % 5 = 0, 'canary', null),
          if(response_status >= 500, 'alert', null))) as tags""",
    )


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the capture, when one endpoint had another path."""
    r = requests(spark, sf_dir).where(F.col("timestamp") < MIDDLE)
    return _moved(r, "/api/signup/0", "/api/register/0")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half, after another endpoint moved."""
    r = requests(spark, sf_dir).where(F.col("timestamp") >= MIDDLE)
    return _moved(r, "/api/view/1", "/api/show/1")


def _moved(requests: DataFrame, old: str, new: str) -> DataFrame:
    path = F.col("path")
    return requests.withColumn("path", F.when(path == old, F.lit(new)).otherwise(path))


def overlapping(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three captures of which neighbours share a third of the time."""
    r = requests(spark, sf_dir)
    t = F.col("timestamp")
    return [r.where(t < MIDDLE), r.where((t >= EARLY) & (t < LATE)), r.where(t >= MIDDLE)]


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per document, the whole text as request body."""
    return _table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("seq"),
        F.col("doc_id").cast("double").alias("timestamp"),
        F.lit("POST").alias("method"),
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang")).alias("path"),
        F.lit("").alias("query_string"),
        _map(Host=F.col("source"), X_Lang=F.col("lang")).alias("request_headers"),
        F.col("text").alias("request_body"),
        F.lit(200).alias("response_status"),
        _no_headers().alias("response_headers"),
        F.lit(None).cast("string").alias("response_body"),
        F.col("n_chars").cast("double").alias("duration_ms"),
    )


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch per page; plain-http ones carry untidy paths, headers and bodies."""
    url = F.col("url")
    untidy = F.startswith(url, F.lit("http:"))
    host = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
    path = F.regexp_extract(url, "^https?://[^/?#]*([^?#]*)", 1)
    return _table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"),
        F.col("page_id").alias("seq"),
        F.col("page_id").cast("double").alias("timestamp"),
        F.lit("get ").alias("method"),
        F.when(untidy, F.concat(F.lit("/"), path, F.lit("//"))).otherwise(path).alias("path"),
        F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1).alias("query_string"),
        F.when(untidy, F.create_map(F.lit("Host "), F.concat(F.lit(" "), host)))
        .otherwise(F.create_map(F.lit("host"), host))
        .alias("request_headers"),
        F.lit(None).cast("string").alias("request_body"),
        F.lit(200).alias("response_status"),
        _no_headers().alias("response_headers"),
        F.when(untidy, F.concat(F.lit("\u00a0\n "), F.col("html"), F.lit(" \u2003\t")))
        .otherwise(F.col("html"))
        .alias("response_body"),
        F.length("html").cast("double").alias("duration_ms"),
    )


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per conversation turn, with credentials in headers and body."""
    said = F.replace(F.col("text"), F.lit('"'), F.lit(""))
    body = F.concat(
        F.lit('{"Password" : "'), F.col("role"), F.lit('", "secret":"'), F.col("conv_id"),
        F.lit('", "text": "'), said, F.lit('"}'),
    )
    return _table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("id"),
        (F.col("conv_id") * 10_000 + F.col("turn")).alias("seq"),
        F.col("conv_id").cast("double").alias("timestamp"),
        F.lit("POST").alias("method"),
        F.concat(F.lit("/chat/"), F.col("role")).alias("path"),
        F.lit("").alias("query_string"),
        _map(Authorization=F.col("role"), X_Request_ID=F.col("conv_id").cast("string")).alias(
            "request_headers"
        ),
        body.alias("request_body"),
        F.lit(200).alias("response_status"),
        _map(Set_Cookie=F.col("role"), X_Turn=F.col("turn").cast("string")).alias("response_headers"),
        F.lit(None).cast("string").alias("response_body"),
        F.length("text").cast("double").alias("duration_ms"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per conversation turn; some conversations belong to no request."""
    return _table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100).cast("string").alias("record_id"),
        F.col("turn").cast("bigint").alias("idx"),
        F.col("text").alias("note"),
        F.when(F.col("role") != "user", F.col("role")).alias("author"),
    )


def removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the notes by assistants."""
    return annotations(spark, sf_dir).where(F.col("author") == "assistant").select("record_id", "idx")


def replay_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three replay attempts per record from ``events``."""
    parsed = _table(spark, sf_dir, "events").selectExpr("*", _K)
    return parsed.selectExpr(
        "event_id div 3 as record_id",
        "event_id div 3000 as run",
        "cast(event_id % 3 + 1 as int) as attempt",
        """cast(case when event_type = 'error' and k % 4 = 0 then null
          when event_type = 'error' then 500 + k % 4 when k % 10 = 0 then 404 else 200 end as int)
          as status""",
        "if(event_type = 'error' and k % 4 = 0, 'timeout', null) as error",
        "value * 10 as duration_ms",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot per day of the capture."""
    day = F.floor(F.col("timestamp") / 86400)
    return requests(spark, sf_dir).select(
        "*",
        F.concat(F.lit("day-"), day).alias("name"),
        ((day + 1) * 86400).alias("created_at"),
    )
