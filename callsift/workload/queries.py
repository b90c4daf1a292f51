"""The registered queries: each operator over whole tables, with its DuckDB twin.

``QUERIES`` maps a name to a callable ``(spark, sf_dir) -> DataFrame`` and
``ORACLES`` to the SQL that must give the same rows.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.functions.headers import header
from callsift.operators import (
    aggregates,
    annotations,
    compare,
    dedup,
    filters,
    inspection,
    paging,
    profiling,
    replay,
    rules,
    timeseries,
    transforms,
)
from callsift.plans.scratch import scratch_path
from callsift.sources import archive, baselines, exports, log, rewrites, snapshots, split
from callsift.streaming import watch
from callsift.workload import tables
from callsift.workload.sql import SPACE, on_requests, with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return add


def _rounded(name: str, digits: int = 6):
    """Sums and means of doubles depend on the order of addition in the last bits."""
    return F.round(F.col(name), digits).alias(name)


# --------------------------------------------------------------------------- sources and sinks

_LOADED = """
select id, seq, timestamp, method, path, query_string, host, content_type, request_body,
  response_status, response_body, duration_ms, array_to_string(tags, ',') as tags from requests"""


@_register(on_requests(_LOADED))
def load_requests(spark, sf_dir):
    path = scratch_path(spark, "log")
    log.append_log(tables.requests(spark, sf_dir), path)
    return log.read_log(spark, path).select(
        "id",
        "seq",
        "timestamp",
        "method",
        "path",
        "query_string",
        header(F.col("request_headers"), "Host").alias("host"),
        F.try_element_at("request_headers", F.lit("Content-Type")).alias("content_type"),
        "request_body",
        "response_status",
        "response_body",
        "duration_ms",
        F.array_join("tags", ",").alias("tags"),
    )


@_register(on_requests("select id, method, path, duration_ms from requests where id = '417'"))
def find_by_id(spark, sf_dir):
    return filters.find_by_id(tables.requests(spark, sf_dir), "417").select(
        "id", "method", "path", "duration_ms"
    )


@_register(on_requests("select id, path from requests where list_contains(tags, 'canary')"))
def find_by_tag(spark, sf_dir):
    return filters.find_by_tag(tables.requests(spark, sf_dir), "canary").select("id", "path")


@_register(
    on_requests("""
select id, cast(timestamp as varchar) as timestamp, method, path, query_string,
  response_status as status_code, cast(duration_ms as varchar) as duration_ms from requests""")
)
def export_csv_projection(spark, sf_dir):
    return exports.csv_columns(tables.requests(spark, sf_dir))


@_register(
    on_requests(r"""
select id, array_to_string(list_filter([
    concat('curl -X ', method),
    concat('  -H ''Host: ', host, ''''),
    '  -H ''X-Correlation-ID: ' || correlation || '''',
    '  -H ''Content-Type: ' || content_type || '''',
    '  -d ''' || replace(nullif(request_body, ''), '''', '''\''''') || '''',
    concat('  ''http://', host, path, case when query_string <> '' then '?' || query_string else '' end, '''')
  ], lambda x: x is not null), ' \' || chr(10)) as command from requests""")
)
def export_curl(spark, sf_dir):
    return exports.curl_commands(tables.requests(spark, sf_dir))


@_register(
    on_requests("""
select id, array_to_string(list_filter([
    concat('[', cast(timestamp as varchar), '] ', method, ' ', path, ' -> ',
      cast(response_status as varchar), '  (', printf('%.1f', duration_ms), ' ms)'),
    '  Request Headers:', concat('    Host: ', host), '    X-Correlation-ID: ' || correlation,
    '    Content-Type: ' || content_type,
    '  Response Headers:', concat('    Content-Type: ', response_type),
    case when request_body <> '' then concat('  Request Body: ', request_body) end,
    case when response_body <> '' then concat('  Response Body: ', response_body) end
  ], lambda x: x is not null), chr(10)) as line from requests""")
)
def render_log_lines(spark, sf_dir):
    return exports.log_lines(tables.requests(spark, sf_dir), show_headers=True, show_body=True)


@_register(
    on_requests(
        "select id, method, path from requests where timestamp >= " + str(tables.MIDDLE)
    )
)
def restore_new_records(spark, sf_dir):
    parts = tables.overlapping(spark, sf_dir)
    archived = parts[1].unionByName(parts[2]).unionByName(parts[0])
    return archive.restore_new_records(archived, parts[0]).select("id", "method", "path")


@_register(
    on_requests("""
select concat('day-', cast(day as varchar)) as name, (day + 1) * 86400 as created_at, count(*) as records
from (select cast(floor(timestamp / 86400) as bigint) as day from requests) group by day""")
)
def snapshot_list(spark, sf_dir):
    return snapshots.snapshot_list(tables.snapshots(spark, sf_dir))


# --------------------------------------------------------------------------- round trips


@_register(on_requests("select id, seq, path, response_status from requests"))
def json_export_round_trip(spark, sf_dir):
    path = scratch_path(spark, "export")
    exports.write_json(tables.requests(spark, sf_dir), path)
    return log.read_log(spark, path).select("id", "seq", "path", "response_status")


@_register(
    on_requests("""
select id, path, restored, 0 as again from requests,
  (select count(*) filter (timestamp >= %s) as restored from requests)""" % tables.MIDDLE)
)
def restore_round_trip(spark, sf_dir):
    """An archive of everything restored twice into a log that has the earlier requests."""
    everything, path, kept = tables.requests(spark, sf_dir), scratch_path(spark, "log"), scratch_path(spark, "archive")
    log.append_log(everything.where(F.col("timestamp") < tables.MIDDLE), path, "parquet")
    archive.archive(everything, kept)
    added = [archive.restore(spark, kept, path) for _ in range(2)]
    read = log.read_log(spark, path, "parquet", strict=False).select("id", "path")
    return read.withColumns({"restored": F.lit(added[0]).cast("long"), "again": F.lit(added[1])})


@_register(
    on_requests("""
select 'late' as name, count(*) as records, count(*) as loaded, cast(sum(response_status) as bigint) as statuses
from requests where timestamp >= %s""" % tables.MIDDLE)
)
def snapshot_round_trip(spark, sf_dir):
    """Saved, replaced, listed and loaded; another one is deleted."""
    everything = tables.requests(spark, sf_dir)
    store = snapshots.SnapshotStore(spark, f"snapshots_{uuid.uuid4().hex}")
    for name, part in (("gone", everything), ("late", everything), ("late", everything.where(F.col("timestamp") >= tables.MIDDLE))):
        store.save(part, name)
    store.delete("gone")
    loaded = store.load("late").agg(
        F.count("*").alias("loaded"), F.sum(F.col("response_status").cast("long")).alias("statuses")
    )
    return store.list().select("name", "records").join(F.broadcast(loaded))


@_register(
    on_requests("select id, seq, path, response_status, (select count(*) from requests) as archived from requests")
)
def archive_round_trip(spark, sf_dir):
    path = scratch_path(spark, "archive")
    written = archive.archive(tables.requests(spark, sf_dir), path)
    read = archive.read_archive(spark, path).select("id", "seq", "path", "response_status")
    return read.join(archive.archived_ids(spark, path), "id").withColumn("archived", F.lit(written))


@_register(
    on_requests("""
select lower(method) as bucket_name, method as bucket, count(*) as n from requests group by method""")
)
def split_round_trip(spark, sf_dir):
    path = scratch_path(spark, "split")
    split.write_split(tables.requests(spark, sf_dir), F.col("method"), path)
    read = spark.read.parquet(path)
    return read.groupBy(F.lower("bucket_name").alias("bucket_name"), "bucket").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- logs without seq

_CAPTURED = """
select * replace (row_number() over (order by timestamp, id) as seq) from requests"""


def _captured(spark, sf_dir):
    """The requests as a capture writes them, without ``seq``, read back from JSON Lines."""
    path = scratch_path(spark, "captured")
    log.append_log(tables.requests(spark, sf_dir).drop("seq"), path)
    return log.read_log(spark, path)


def _on_captured(body: str, **more: str) -> str:
    return with_tables("requests", body=body, captured=_CAPTURED, **more)


@_register(
    _on_captured("""
select id from captured qualify row_number() over (
  partition by method, path, query_string, host, correlation, content_type, request_body order by seq) = 1""")
)
def dedup_unsequenced(spark, sf_dir):
    return dedup.dedup_unique(_captured(spark, sf_dir)).select("id")


@_register(_on_captured("select id, path from captured order by seq limit 50 offset 300"))
def page_unsequenced(spark, sf_dir):
    return paging.paginate(_captured(spark, sf_dir), 7, 50).select("id", "path")


@_register(
    _on_captured(
        """
select cast(ceil(least(count(*) filter (ok), 120) / 25) as bigint) as batches,
  least(count(*) filter (ok), 120) as records,
  count(*) filter (not ok and seq < coalesce((select seq from accepted where n = 121),
    (select max(seq) + 1 from captured))) as filtered_out
from (select *, response_status >= 400 as ok from captured)""",
        accepted="""
select seq, row_number() over (order by seq) as n from captured where response_status >= 400""",
    )
)
def batch_stats_unsequenced(spark, sf_dir):
    return timeseries.batch_stats(
        _captured(spark, sf_dir), 25, max_records=120, predicate="response_status >= 400"
    )


@_register(
    _on_captured("""
select id, row_number() over (order by duration_ms desc, seq) - 1 as position from captured""")
)
def sort_unsequenced(spark, sf_dir):
    return paging.ranked(_captured(spark, sf_dir), "duration_ms", "desc").select("id", "position")


@_register(
    _on_captured("""
select path, n from (select path, count(*) as n, min(seq) as first_seen from captured group by path)
order by n desc, first_seen, path limit 5""")
)
def top_paths_unsequenced(spark, sf_dir):
    return aggregates.top_paths(_captured(spark, sf_dir))


@_register(
    _on_captured("""
select kind, count(*) as n from (
  select case seq % 9 when 1 then 'trailing' when 2 then 'two' when 3 then 'type' when 4 then 'cut' when 5 then 'closed'
    when 6 then 'closed two' when 7 then 'large' else 'good' end as kind from (select event_id as seq from events))
group by kind""")
)
def bad_lines(spark, sf_dir):
    """Lines of nine kinds, of which the reader sets seven aside; blank lines do not count."""
    good = tables.requests(spark, sf_dir)
    line = F.to_json(F.struct(*good.columns), {"ignoreNullFields": "false"})
    kind = F.col("seq") % 9
    status = '"response_status":[0-9]+'
    bad = (
        F.when(kind == 1, F.concat(line, F.lit(" garbage")))
        .when(kind == 5, F.concat(line, F.lit("] garbage")))
        .when(kind == 6, F.concat(line, F.lit("] ["), line))
        .when(kind == 7, F.regexp_replace(line, status, '"response_status":1e12'))
        .when(kind == 8, F.concat(F.lit("\t "), line, F.lit("\u3000")))
        .when(kind == 2, F.concat(line, line))
        .when(kind == 3, F.regexp_replace(line, '"response_status":[0-9]+', '"response_status":"oops"'))
        .when(kind == 4, F.substring(line, 1, 20))
        .otherwise(line)
    )
    blank = F.explode(F.array(bad, F.lit("\t"), F.lit(" \x0b\u2003"))).alias("value")
    read = log.parse_lines(good.select(blank), mode="PERMISSIVE")
    raw = F.col(log.CORRUPT)
    found = (
        F.when(raw.isNull(), "good").when(raw.endswith("] garbage"), "closed").when(raw.contains("] [{"), "closed two")
        .when(raw.contains("1e12"), "large").when(raw.endswith("garbage"), "trailing").when(raw.contains("}{"), "two")
        .when(raw.contains("oops"), "type").otherwise("cut")
    )
    return read.groupBy(found.alias("kind")).agg(F.count("*").alias("n"))


@_register(
    _on_captured("""
select kind, count(*) as n from (
  select case event_id % 4 when 1 then 'unknown' when 2 then 'missing' when 3 then 'both' else 'good' end as kind from events)
group by kind""")
)
def strict_lines(spark, sf_dir):
    """Lines with unknown or missing fields, which a strict reader sets aside."""
    good = tables.requests(spark, sf_dir)
    kind = F.col("seq") % 4
    line = F.to_json(F.struct(*good.columns), {"ignoreNullFields": "false"})
    line = F.when(kind.isin(1, 3), F.concat(F.lit('{"extra":1,'), F.substr(line, F.lit(2)))).otherwise(line)
    line = F.when(kind.isin(2, 3), F.regexp_replace(line, '"method":"[A-Za-z]+",', "")).otherwise(line)
    raw = F.col(log.CORRUPT)
    extra, lacking = raw.contains('"extra"'), ~raw.contains('"method"')
    found = F.when(raw.isNull(), "good").when(extra & lacking, "both").when(extra, "unknown").otherwise("missing")
    read = log.parse_lines(good.select(line.alias("value")), mode="PERMISSIVE")
    return read.groupBy(found.alias("kind")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- filters


@_register(
    on_requests("""
select id, method, path, response_status, duration_ms from requests
where upper(method) = 'GET' and starts_with(path, '/api/click') and response_status = 200
  and duration_ms >= 50 and duration_ms <= 2000 and host = 'svc3'""")
)
def filter_requests(spark, sf_dir):
    return filters.filter_requests(
        tables.requests(spark, sf_dir),
        method="get",
        path_prefix="/api/click",
        status=200,
        min_duration_ms=50,
        max_duration_ms=2000,
        host="svc3",
    ).select("id", "method", "path", "response_status", "duration_ms")


@_register(
    on_requests("""
select id, path from requests
where (cast('0x' || md5(id) as uhugeint) % 10000) / 10000.0 < 0.3 and response_status < 500""")
)
def hash_sample(spark, sf_dir):
    return filters.hash_sample(
        tables.requests(spark, sf_dir), 0.3, predicate="response_status < 500"
    ).select("id", "path")


_RULE = """case when response_status >= 500 then 'server-error'
  when response_status >= 400 then 'client-error' when duration_ms > 1000 then 'slow' end"""


@_register(on_requests(f"select id, {_RULE} as rule from requests where {_RULE} is not null"))
def highlighted_only(spark, sf_dir):
    return rules.highlighted_only(tables.requests(spark, sf_dir)).select("id", "rule")


_RATES = """
select upper(method) as method, path, count(*) as requests,
  (select max(timestamp) - min(timestamp) from requests) as window_seconds,
  count(*) / (select max(timestamp) - min(timestamp) from requests) as rps
from requests group by 1, 2"""


def _rates(df: DataFrame) -> DataFrame:
    return df.select(
        "method", "path", "requests", _rounded("window_seconds"), _rounded("rps", 12), "exceeds_limit"
    )


_RATE_COLUMNS = """method, path, requests, round(window_seconds, 6) as window_seconds,
  round(rps, 12) as rps, rps > 0.00008 as exceeds_limit"""


@_register(on_requests(f"select {_RATE_COLUMNS} from rates", rates=_RATES))
def rate_limits(spark, sf_dir):
    return _rates(timeseries.rate_limits(tables.requests(spark, sf_dir), 0.00008))


@_register(on_requests(f"select {_RATE_COLUMNS} from rates where rps > 0.00008", rates=_RATES))
def rate_limit_violations(spark, sf_dir):
    return _rates(timeseries.rate_limit_violations(tables.requests(spark, sf_dir), 0.00008))


@_register(
    on_requests(
        """
select round(max(window_seconds), 3) as window_seconds, cast(0.00008 as double) as max_rps,
  count(*) as total_endpoints, count(*) filter (rps > 0.00008) as violation_count from rates""",
        rates=_RATES,
    )
)
def rate_limit_summary(spark, sf_dir):
    summary = timeseries.rate_limit_summary(tables.requests(spark, sf_dir), 0.00008)
    return summary.withColumn("window_seconds", F.round("window_seconds", 3))


# --------------------------------------------------------------------------- transforms

_NORMALIZED = rf"""
select id, 'GET' as method, new_path as path, host, md5(new_body) as body_md5,
  untidy or new_path <> url_path or new_body <> response_body as changed
from (
  select *, regexp_replace(response_body, '^{SPACE}+|{SPACE}+$', '', 'g') as new_body,
    case when squeezed = '/' then squeezed else rtrim(squeezed, '/') end as new_path
  from (
    select *, regexp_replace(case when untidy then concat('/', url_path, '//') else url_path end,
      '/+', '/', 'g') as squeezed from page_requests))"""


@_register(with_tables("page_requests", body=_NORMALIZED))
def normalize_requests(spark, sf_dir):
    return transforms.normalize(tables.page_requests(spark, sf_dir)).select(
        "id",
        "method",
        "path",
        F.element_at("request_headers", "host").alias("host"),
        F.md5(F.col("response_body").cast("binary")).alias("body_md5"),
        "changed",
    )


_MASKED = "request_body"
for _key in ("password", "token", "secret", "api_key"):
    _MASKED = (
        rf"""regexp_replace({_MASKED}, '("{_key}"\s*:\s*)"[^"]*"', '\1"[REDACTED]"', 'gi')"""
    )


@_register(
    with_tables(
        "chat_requests",
        body=f"""
select id, '[REDACTED]' as credential, correlation, '[REDACTED]' as cookie, turn,
  md5({_MASKED}) as body_md5 from chat_requests""",
    )
)
def anonymize_requests(spark, sf_dir):
    return transforms.anonymize(tables.chat_requests(spark, sf_dir)).select(
        "id",
        F.element_at("request_headers", "Authorization").alias("credential"),
        F.element_at("request_headers", "X-Request-ID").alias("correlation"),
        F.element_at("response_headers", "Set-Cookie").alias("cookie"),
        F.element_at("response_headers", "X-Turn").alias("turn"),
        F.md5(F.col("request_body").cast("binary")).alias("body_md5"),
    )


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_SECRET = r'(token|secret|api_key|password)\s*=\s*"[^"]*"'


def _redacted(spark, sf_dir):
    return transforms.redact(
        tables.document_requests(spark, sf_dir),
        [
            transforms.RedactRule("request_body", _EMAIL, "<email>"),
            transforms.RedactRule("request_body", _SECRET, r'\1 = "$[REDACTED]"'),
            transforms.RedactRule("request_headers", "^src", "origin-", "path like '%/en'"),
        ],
    )


_REDACTED = rf"""
select id, md5(new_body) as body_md5, case when ends_with(path, '/en')
    then regexp_replace(split_part(path, '/', 2), '^src', 'origin-') else split_part(path, '/', 2) end as host,
  new_body <> request_body or ends_with(path, '/en') as redacted
from (select *, regexp_replace(regexp_replace(request_body, '{_EMAIL}', '<email>', 'gi'),
  '{_SECRET}', '\1 = "$[REDACTED]"', 'gi') as new_body from document_requests)"""


@_register(with_tables("document_requests", body=_REDACTED))
def redact_bodies(spark, sf_dir):
    return _redacted(spark, sf_dir).select(
        "id",
        F.md5(F.col("request_body").cast("binary")).alias("body_md5"),
        F.element_at("request_headers", "Host").alias("host"),
        "redacted",
    )


# The cut may fall inside a character; the incomplete bytes at the end become one U+FFFD.
_TRUNCATED = r"""
select id, octets > 4096 as truncated,
  md5(case when octets <= 4096 then request_body
    else concat(decode(unhex(whole)), case when whole <> cut then chr(65533) else '' end, '...[truncated]')
    end) as body_md5
from (
  select *, regexp_replace(cut, '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-4]([89AB][0-9A-F]){0,2})$', '')
    as whole
  from (
    select id, request_body, octet_length(encode(request_body)) as octets,
      substring(hex(encode(request_body)), 1, 8192) as cut from document_requests))"""


@_register(with_tables("document_requests", body=_TRUNCATED))
def truncate_bodies(spark, sf_dir):
    return transforms.truncate(tables.document_requests(spark, sf_dir)).select(
        "id", "truncated", F.md5(F.col("request_body").cast("binary")).alias("body_md5")
    )


def _patched(spark, sf_dir):
    return transforms.patch(
        tables.requests(spark, sf_dir),
        [
            transforms.PatchRule("path", lambda c: F.concat(F.lit("/v2"), c), "method = 'GET'"),
            transforms.PatchRule("method", F.upper),
            transforms.PatchRule("path", lambda c: F.concat(c, F.lit("/list")), "method = 'get'"),
            transforms.PatchRule("duration_ms", lambda c: c * 2, "response_status >= 500"),
            transforms.PatchRule("not_a_column", F.upper),
        ],
    )


@_register(
    on_requests("""
select id, upper(method) as method,
  case method when 'GET' then '/v2' || path when 'get' then path || '/list' else path end as path,
  case when response_status >= 500 then duration_ms * 2 else duration_ms end as duration_ms,
  method in ('GET', 'get') or (response_status >= 500 and duration_ms <> 0) as patched
from requests""")
)
def patch_requests(spark, sf_dir):
    return _patched(spark, sf_dir).select("id", "method", "path", "duration_ms", "patched")


_FAILING = """
select *, response_status % 100 = 0 and method = 'GET' as failed, id % 7 <> 0 and 10 / (id % 7) > 3 as chosen
from (select * replace (cast(id as bigint) as id) from requests)"""

_FAILING_RULES = [
    transforms.PatchRule("duration_ms", lambda c: c + F.floor(1000 / (F.col("response_status") % 100)), "method = 'GET'"),
    # Fails on every seventh id, where it is no match.
    transforms.PatchRule("method", F.lower, "10 / (cast(id as int) % 7) > 3"),
]


@_register(
    on_requests(f"""
select cast(id as varchar) as id, case when chosen and not failed then lower(method) else method end as method,
  case when method = 'GET' and not failed then duration_ms + floor(1000 / (response_status % 100)) else duration_ms end
    as duration_ms,
  not failed and (method = 'GET' or chosen and method <> lower(method)) as patched, failed as patch_failed
from ({_FAILING})""")
)
def patch_errors(spark, sf_dir):
    """Rows on which a transform fails stay as they are; a failing predicate is no match."""
    patched = transforms.patch(tables.requests(spark, sf_dir), _FAILING_RULES, failed="patch_failed")
    return patched.select("id", "method", "duration_ms", "patched", "patch_failed")


@_register(
    on_requests(f"""
select count(*) as total, count(*) filter (changed) as changed, count(*) filter (not changed) as skipped,
  count(*) filter (failed) as failed
from (select failed, not failed and (method = 'GET' or chosen and method <> lower(method)) as changed from ({_FAILING}))""")
)
def patch_error_counts(spark, sf_dir):
    return transforms.patch_counts(tables.requests(spark, sf_dir), _FAILING_RULES)


@_register(
    on_requests("""
select id, array_to_string(list_filter([
    case when response_status % 100 <> 0 and 100 / (response_status % 100) >= 25 then 'ratio' end,
    case when try_cast(split_part(path, '/', 4) as int) > 4 then 'high' end], lambda v: v is not null), ',') as tags
from requests""")
)
def tag_with_errors(spark, sf_dir):
    """Rules that divide by zero, read a missing part or cast text are no match on that row."""
    tagged = rules.tag(
        tables.requests(spark, sf_dir),
        [
            rules.Rule("ratio", "100 / (response_status % 100) >= 25"),
            rules.Rule("high", "cast(split(path, '/')[3] as int) > 4"),
        ],
    )
    return tagged.select("id", F.array_join("matched_tags", ",").alias("tags"))


def _renamed(spark, sf_dir):
    return transforms.rename(
        tables.requests(spark, sf_dir),
        [
            transforms.replace_path_prefix("/api/click/1", "/first"),
            transforms.replace_path_prefix("/api/click", "/v2/click"),
            transforms.RenameRule("method = 'PUT'", {"method": F.lit("PATCH")}),
        ],
    )


@_register(
    on_requests("""
select id, case method when 'PUT' then 'PATCH' else method end as method,
  case when starts_with(path, '/api/click/1') then '/first' || substr(path, 13)
    when starts_with(path, '/api/click') then '/v2/click' || substr(path, 11) else path end as path,
  starts_with(path, '/api/click') or method = 'PUT' as renamed
from requests""")
)
def rename_paths(spark, sf_dir):
    return _renamed(spark, sf_dir).select("id", "method", "path", "renamed")


_COUNTERS = f"""
select name, count(*) as total, count(*) filter (changed) as changed,
  count(*) filter (not changed) as unchanged
from (
  select 'normalize' as name, changed from ({_NORMALIZED})
  union all select 'redact', redacted from ({_REDACTED})
  union all select 'truncate', octet_length(encode(request_body)) > 4096 from document_requests
  union all select 'patch', method in ('GET', 'get') or (response_status >= 500 and duration_ms <> 0)
    from requests
  union all select 'rename', starts_with(path, '/api/click') or method = 'PUT' from requests)
group by name"""


@_register(with_tables("requests", "page_requests", "document_requests", body=_COUNTERS))
def transform_counters(spark, sf_dir):
    counted = None
    for name, (df, flag) in _transforms(spark, sf_dir).items():
        row = transforms.change_counts(df, flag).select(F.lit(name).alias("name"), "*")
        counted = row if counted is None else counted.unionByName(row)
    return counted


def _transforms(spark, sf_dir) -> dict[str, tuple[DataFrame, str]]:
    return {
        "normalize": (transforms.normalize(tables.page_requests(spark, sf_dir)), "changed"),
        "redact": (_redacted(spark, sf_dir), "redacted"),
        "truncate": (transforms.truncate(tables.document_requests(spark, sf_dir)), "truncated"),
        "patch": (_patched(spark, sf_dir), "patched"),
        "rename": (_renamed(spark, sf_dir), "renamed"),
    }


@_register(with_tables("requests", "page_requests", "document_requests", body=_COUNTERS))
def transform_counters_written(spark, sf_dir):
    """Counts of changed rows, taken while the rewritten rows are written."""
    rows = []
    for name, (df, flag) in _transforms(spark, sf_dir).items():
        counts = rewrites.write_rewritten(df, flag, scratch_path(spark, f"rewritten-{name}"))
        rows.append((name, counts.total, counts.changed, counts.unchanged))
    return spark.createDataFrame(rows, "name string, total long, changed long, unchanged long")


# --------------------------------------------------------------------------- rules


@_register(
    on_requests("""
select id, array_to_string(list_filter([
    case when duration_ms > 1000 then 'slow' end, case when response_status >= 500 then 'error' end,
    case when response_status between 400 and 499 then 'client-error' end,
    case when upper(method) = 'POST' then 'post' end, case when upper(method) = 'GET' then 'get' end,
    case when length(request_body) > 4096 then 'large-body' end
  ], lambda x: x is not null), ',') as matched_tags from requests""")
)
def tag_requests(spark, sf_dir):
    return rules.tag(tables.requests(spark, sf_dir)).select(
        "id", F.array_join("matched_tags", ",").alias("matched_tags")
    )


_LABELED = """
select id, list_filter([
    case when duration_ms > 1000 then 'slow' end, case when response_status >= 500 then 'error' end,
    case when response_status between 400 and 499 then 'client-error' end,
    case when length(response_body) > 10000 then 'large-response' end,
    case when method in ('POST', 'PUT', 'PATCH', 'DELETE') then 'mutation' end
  ], lambda x: x is not null) as labels from requests"""


@_register(
    on_requests("select id, array_to_string(labels, ',') as labels from labeled", labeled=_LABELED)
)
def label_requests(spark, sf_dir):
    return rules.label(tables.requests(spark, sf_dir)).select(
        "id", F.array_join("labels", ",").alias("labels")
    )


@_register(
    on_requests(
        "select label, count(*) as n from (select unnest(labels) as label from labeled) group by label",
        labeled=_LABELED,
    )
)
def label_counts(spark, sf_dir):
    return rules.label_counts(rules.label(tables.requests(spark, sf_dir)))


@_register(
    on_requests(
        "select count(*) as total, count(*) filter (len(labels) > 0) as labeled from labeled",
        labeled=_LABELED,
    )
)
def label_totals(spark, sf_dir):
    return rules.label_totals(rules.label(tables.requests(spark, sf_dir)))


_CATEGORIES = (
    rules.Rule("failure", "response_status >= 500"),
    rules.Rule("write", "method in ('POST', 'PUT')"),
    rules.Rule("uncorrelated", "request_headers['X-Correlation-ID'] is null and duration_ms > 100"),
)
_CLASSIFIED = """
select id, case when response_status >= 500 then 'failure' when method in ('POST', 'PUT') then 'write'
  when correlation is null and duration_ms > 100 then 'uncorrelated' end as category from requests"""


@_register(on_requests(_CLASSIFIED))
def classify_requests(spark, sf_dir):
    return rules.classify(tables.requests(spark, sf_dir), _CATEGORIES).select("id", "category")


@_register(on_requests(f"select category, count(*) as n from ({_CLASSIFIED}) group by category"))
def category_counts(spark, sf_dir):
    return rules.category_counts(rules.classify(tables.requests(spark, sf_dir), _CATEGORIES))


@_register(on_requests(f"select id, {_RULE} as rule from requests"))
def highlight_requests(spark, sf_dir):
    return rules.highlight(tables.requests(spark, sf_dir)).select("id", "rule")


_SCORED = """
select id, case when response_status >= 500 then 10 when response_status >= 400 then 4 else 0 end
    + case when duration_ms >= 3000 then 6 when duration_ms >= 1000 then 3 else 0 end
    + case when method = 'DELETE' then 1 else 0 end
    + case when length(request_body) > 10000 then 2 else 0 end as score,
  array_to_string(list_filter([
    case when response_status >= 500 then concat('Server error status ', response_status)
      when response_status >= 400 then concat('Client error status ', response_status) end,
    case when duration_ms >= 3000 then concat('Very slow response ', duration_ms, 'ms (>=3000ms)')
      when duration_ms >= 1000 then concat('Slow response ', duration_ms, 'ms (>=1000ms)') end,
    case when method = 'DELETE' then 'Destructive method DELETE' end,
    case when length(request_body) > 10000
      then concat('Large request body (', length(request_body), ' bytes)') end
  ], lambda x: x is not null), '; ') as reasons from requests"""


@_register(
    on_requests(
        """
select id, score, case when score >= 10 then 'HIGH' when score >= 5 then 'MED' else 'LOW' end as band,
  reasons from scored where score >= 3""",
        scored=_SCORED,
    )
)
def score_requests(spark, sf_dir):
    return inspection.score(tables.requests(spark, sf_dir), min_score=3).select(
        "id", "score", "band", F.array_join("reasons", "; ").alias("reasons")
    )


_NOT_JSON = "'Content-Type is application/json but body is not valid JSON'"
_WARNINGS = f"""
select id as record_id, unnest(list_filter([
    case when duration_ms > 1000 then {{'field': 'duration_ms',
      'message': printf('%.1f', duration_ms) || ' ms exceeds threshold 1000.0 ms'}} end,
    case when response_status >= 500 then {{'field': 'response_status',
      'message': concat('Server error: HTTP ', response_status)}} end,
    case when request_body <> '' and content_type is null then {{'field': 'request_headers',
      'message': 'Non-empty request body has no Content-Type header'}} end,
    case when contains(content_type, 'application/json') and request_body <> ''
      and not json_valid(request_body) then {{'field': 'request_body', 'message': {_NOT_JSON}}} end,
    case when contains(response_type, 'application/json') and response_body <> ''
      and not json_valid(response_body) then {{'field': 'response_body', 'message': {_NOT_JSON}}} end,
    case when path = '' then {{'field': 'path', 'message': 'Request path is empty'}} end
  ], lambda x: x is not null)) as w from requests"""


@_register(on_requests("select record_id, w.field, w.message from warned", warned=_WARNINGS))
def inspect_requests(spark, sf_dir):
    inspected = inspection.inspect(tables.requests(spark, sf_dir))
    return inspection.inspection_warnings(inspected).drop("position")


def _checks():
    return [rules.status_below_500(), rules.non_empty_path(), rules.duration_at_most(1500)]


_FAILURES = """
select id as record_id, unnest(list_filter([
    case when response_status >= 500 then {'rule_name': 'no_server_error',
      'message': 'Response status code is 5xx (server error).'} end,
    case when trim(path) = '' then {'rule_name': 'non_empty_path', 'message': 'Request path is empty.'} end,
    case when duration_ms > 1500 then {'rule_name': 'duration_below_1500ms',
      'message': 'Request duration exceeds 1500 ms.'} end
  ], lambda x: x is not null)) as e from requests"""


@_register(on_requests("select record_id, e.rule_name, e.message from failed", failed=_FAILURES))
def validate_requests(spark, sf_dir):
    return rules.validate(tables.requests(spark, sf_dir), _checks())


@_register(
    on_requests(
        """
select (select count(*) from requests) as total, count(*) as errors,
  (select count(*) from requests) - count(distinct record_id) as valid from failed""",
        failed=_FAILURES,
    )
)
def validation_summary(spark, sf_dir):
    return rules.validation_summary(tables.requests(spark, sf_dir), _checks())


# --------------------------------------------------------------------------- aggregates

_ENDPOINTS = """
select method, path, count(*) as requests, round(sum(duration_ms), 4) as total_duration_ms,
  round(sum(duration_ms) / count(*), 4) as avg_duration_ms,
  count(*) filter (response_status >= 400) as errors,
  round(count(*) filter (response_status >= 400) / count(*), 6) as error_rate, min(seq) as first_seen
from requests group by method, path"""


def _endpoints(df: DataFrame) -> DataFrame:
    return df.select(
        "method", "path", "requests", _rounded("total_duration_ms", 4), _rounded("avg_duration_ms", 4),
        "errors", _rounded("error_rate"), F.col("first_seen.seq").alias("first_seen"),
    )


@_register(on_requests(_ENDPOINTS))
def endpoint_stats(spark, sf_dir):
    return _endpoints(aggregates.endpoint_stats(tables.requests(spark, sf_dir)))


@_register(
    on_requests(
        "select * from endpoints order by requests desc, first_seen, method, path limit 10",
        endpoints=_ENDPOINTS,
    )
)
def endpoint_top_n(spark, sf_dir):
    return _endpoints(aggregates.endpoint_top_n(tables.requests(spark, sf_dir), 10))


@_register(
    on_requests(
        "select * from endpoints order by avg_duration_ms desc, first_seen, method, path limit 10",
        endpoints=_ENDPOINTS,
    )
)
def endpoint_slowest(spark, sf_dir):
    return _endpoints(aggregates.endpoint_top_n(tables.requests(spark, sf_dir), 10, "duration"))


@_register(
    on_requests(
        "select method, path, response_status, count(*) as n from requests group by 1, 2, 3"
    )
)
def endpoint_status_counts(spark, sf_dir):
    return aggregates.endpoint_status_counts(tables.requests(spark, sf_dir))


@_register(
    on_requests("""
select count(*) as total, round(avg(duration_ms), 4) as avg_duration_ms,
  (select path from requests order by duration_ms desc, seq desc limit 1) as slowest_path,
  max(duration_ms) as slowest_ms,
  (select path from requests order by duration_ms, seq limit 1) as fastest_path,
  min(duration_ms) as fastest_ms,
  round(count(*) filter (response_status >= 400) / count(*), 6) as error_rate
from requests""")
)
def summary(spark, sf_dir):
    return aggregates.summary(tables.requests(spark, sf_dir)).select(
        "total", _rounded("avg_duration_ms", 4), "slowest_path", "slowest_ms", "fastest_path",
        "fastest_ms", _rounded("error_rate"),
    )


@_register(on_requests("select method, count(*) as n from requests group by 1"))
def method_counts(spark, sf_dir):
    return aggregates.method_counts(tables.requests(spark, sf_dir))


@_register(
    on_requests("select cast(response_status as varchar) as status, count(*) as n from requests group by 1")
)
def status_counts(spark, sf_dir):
    return aggregates.status_counts(tables.requests(spark, sf_dir))


@_register(
    on_requests("""
select path, n from (select path, count(*) as n, min(seq) as s from requests group by path)
order by n desc, s, path limit 5""")
)
def top_paths(spark, sf_dir):
    return aggregates.top_paths(tables.requests(spark, sf_dir))


@_register(
    on_requests("""
select path, n from (select path, count(*) as n, min(seq) as s from requests group by path)
order by n desc, s, path limit 40""")
)
def heavy_paths(spark, sf_dir):
    """The most frequent paths without a shuffle of all paths."""
    return aggregates.heavy_paths(tables.requests(spark, sf_dir), 40)


def _grouped(key: str) -> str:
    return on_requests(
        f"select {key} as key, count(*) as requests,"
        " round(sum(duration_ms) / count(*), 4) as avg_duration_ms from requests group by 1"
    )


def _groups(df: DataFrame) -> DataFrame:
    return df.select("key", "requests", _rounded("avg_duration_ms", 4))


@_register(_grouped("upper(method)"))
def group_by_method(spark, sf_dir):
    return _groups(aggregates.group_stats(tables.requests(spark, sf_dir), "method"))


@_register(_grouped("cast(response_status as varchar)"))
def group_by_status(spark, sf_dir):
    return _groups(aggregates.group_stats(tables.requests(spark, sf_dir), "status"))


@_register(_grouped("concat('/', array_to_string(string_split(trim(path, '/'), '/')[1:2], '/'))"))
def group_by_path_prefix(spark, sf_dir):
    return _groups(aggregates.group_stats(tables.requests(spark, sf_dir), "path_prefix", depth=2))


@_register(
    on_requests("""
select concat(cast(response_status // 100 as varchar), 'xx') as bucket, count(*) as n
from requests group by 1""")
)
def split_counts(spark, sf_dir):
    return aggregates.split_counts(tables.requests(spark, sf_dir), "status_class")


_PROFILE = """count(*) as requests, min(duration_ms) as min_ms, max(duration_ms) as max_ms,
  round(avg(duration_ms), 4) as mean_ms, quantile_disc(duration_ms, 0.5) as p50_ms,
  quantile_disc(duration_ms, 0.9) as p90_ms, quantile_disc(duration_ms, 0.99) as p99_ms"""


def _profiled(df: DataFrame) -> DataFrame:
    return df.withColumn("mean_ms", F.round("mean_ms", 4))


@_register(on_requests(f"select {_PROFILE} from requests"))
def latency_profile(spark, sf_dir):
    return _profiled(profiling.latency_profile(tables.requests(spark, sf_dir)))


@_register(on_requests(f"select method, path, {_PROFILE} from requests group by 1, 2"))
def latency_profile_by_path(spark, sf_dir):
    return _profiled(profiling.latency_profile(tables.requests(spark, sf_dir), ["method", "path"]))


@_register(
    on_requests("""
select method, path, count(*) as requests, min(duration_ms) as min_ms, max(duration_ms) as max_ms,
  round(sum(duration_ms), 3) as total_ms, true as p50_found, true as p90_found, true as p99_found
from requests where timestamp >= %s and timestamp < %s group by 1, 2""" % (tables.EARLY, tables.LATE))
)
def latency_profile_merged(spark, sf_dir):
    """Percentiles of an interval from written sketches of its days, their ranks counted in the requests.

    The count is exact, so a value is found if its ranks reach the wanted one within twice the stated error.
    """
    requests, keys = tables.requests(spark, sf_dir), ["method", "path"]
    first, last = int(tables.EARLY // 86400), int(tables.LATE // 86400) - 1
    written = scratch_path(spark, "summaries")
    profiling.latency_summaries(requests, keys).write.parquet(written)
    profile = profiling.merged_profile(spark.read.parquet(written), keys, first_day=first, last_day=last)
    timed = requests.where((F.col("timestamp") >= tables.EARLY) & (F.col("timestamp") < tables.LATE))
    ranked = timed.select(*keys, "duration_ms").join(profile, keys)
    figures = ["requests", "min_ms", "max_ms", "mean_ms"]
    counts = []
    for p in profiling.PERCENTILES:
        counts += [
            F.count_if(F.col("duration_ms") < F.col(f"p{p}_ms")).alias(f"_below{p}"),
            F.count_if(F.col("duration_ms") <= F.col(f"p{p}_ms")).alias(f"_upto{p}"),
        ]
    counted = ranked.groupBy(*keys, *figures).agg(*counts)
    room = F.col("requests") * 2 * profiling.rank_error()
    found = []
    for p in profiling.PERCENTILES:
        wanted = F.ceil(F.col("requests") * p / 100)
        reached = (F.col(f"_below{p}") < wanted + room) & (F.col(f"_upto{p}") >= wanted - room)
        found.append(reached.alias(f"p{p}_found"))
    # Means may end in a five that either side rounds its own way; sums do not.
    total = F.round(F.col("mean_ms") * F.col("requests"), 3).alias("total_ms")
    return counted.select(*keys, "requests", "min_ms", "max_ms", total, *found)


@_register(
    on_requests("""
select case when duration_ms < 50 then '<50ms' when duration_ms < 100 then '<100ms'
    when duration_ms < 250 then '<250ms' when duration_ms < 500 then '<500ms'
    when duration_ms < 1000 then '<1000ms' when duration_ms < 2500 then '<2500ms'
    when duration_ms < 5000 then '<5000ms' else '>=5000ms' end as bucket, count(*) as n
from requests group by 1""")
)
def latency_histogram(spark, sf_dir):
    return profiling.latency_histogram(tables.requests(spark, sf_dir))


@_register(
    on_requests("""
select upper(method) as "row", count(*) filter (response_status // 100 = 2) as "2xx",
  count(*) filter (response_status // 100 = 3) as "3xx",
  count(*) filter (response_status // 100 = 4) as "4xx",
  count(*) filter (response_status // 100 = 5) as "5xx",
  count(*) filter (response_status is null or response_status // 100 not between 2 and 5) as other
from (select method, case when k % 6 = 0 then null when k % 6 = 1 then 101 else response_status end
    as response_status from (select *, seq % 97 as k from requests))
group by 1""")
)
def pivot_method_status(spark, sf_dir):
    classes = ["2xx", "3xx", "4xx", "5xx"]
    odd = F.col("seq") % 97 % 6
    status = F.when(odd == 1, F.lit(101)).when(odd != 0, F.col("response_status"))
    some = tables.requests(spark, sf_dir).withColumn("response_status", status)
    return aggregates.pivot(some, values=classes)


@_register(
    on_requests("""
select path as "row", cast(response_status as varchar) as col, count(*) as n from requests group by 1, 2""")
)
def pivot_path_status(spark, sf_dir):
    return aggregates.pivot_long(tables.requests(spark, sf_dir), F.col("path"), "status")


_CHAINS = """
select coalesce(correlation, '__uncorrelated__') as correlation_id, count(*) as requests,
  min(timestamp) as first_timestamp, max(timestamp) as last_timestamp from requests group by 1"""


@_register(on_requests(_CHAINS))
def correlation_chains(spark, sf_dir):
    return aggregates.correlation_chains(tables.requests(spark, sf_dir))


@_register(
    on_requests(
        """
select count(*) as chains,
  cast(sum(requests) filter (correlation_id <> '__uncorrelated__') as bigint) as correlated,
  cast(sum(requests) filter (correlation_id = '__uncorrelated__') as bigint) as uncorrelated from chains""",
        chains=_CHAINS,
    )
)
def correlation_totals(spark, sf_dir):
    return aggregates.correlation_totals(tables.requests(spark, sf_dir))


# --------------------------------------------------------------------------- comparison

_HEADERS_JSON = """concat('[', array_to_string(list_filter([
    '{"key":"Content-Type","value":"' || content_type || '"}',
    '{"key":"Host","value":"' || host || '"}',
    '{"key":"X-Correlation-ID","value":"' || correlation || '"}'
  ], lambda x: x is not null), ','), ']')"""
_RESPONSE_JSON = """concat('[{"key":"Content-Type","value":"', response_type, '"}]')"""


def _latest(table: str, key: str) -> str:
    return f"""
select *, {key} as match_method, {_HEADERS_JSON} as request_headers, {_RESPONSE_JSON} as response_headers
from {table} qualify row_number() over (partition by {key}, path order by seq desc) = 1"""


_PAIRS = "old full join new on old.match_method = new.match_method and old.path = new.path"
_DIFF_LIST = "list_filter([" + ", ".join(
    f"case when old.{c} is distinct from new.{c} then {{'field': '{c}',"
    f" 'old_value': cast(old.{c} as varchar), 'new_value': cast(new.{c} as varchar)}} end"
    for c in compare.COMPARED
) + "], lambda x: x is not null)"
_BOTH = "old.id is not null and new.id is not null"
_COMPARED = f"""
select coalesce(old.match_method, new.match_method) as match_method, coalesce(old.path, new.path) as match_path,
  case when new.id is null then 'only_baseline' when old.id is null then 'only_current' else 'matched' end
    as state, old.id as baseline_id, new.id as current_id,
  case when {_BOTH} then {_DIFF_LIST} end as diffs from {_PAIRS}"""


def _on_captures(body: str) -> str:
    return with_tables(
        "baseline",
        "current_log",
        old=_latest("baseline", "upper(method)"),
        new=_latest("current_log", "upper(method)"),
        compared=_COMPARED,
        body=body,
    )


def _compared(spark, sf_dir):
    return compare.compare_sets(tables.baseline(spark, sf_dir), tables.current(spark, sf_dir))


@_register(
    _on_captures("""
select match_method, match_path, state, baseline_id, current_id,
  array_to_string(list_transform(diffs, lambda d: d.field), ',') as changed_fields from compared""")
)
def compare_sets(spark, sf_dir):
    fields = F.transform("diffs", lambda d: d["field"])
    return _compared(spark, sf_dir).withColumn("changed_fields", F.array_join(fields, ",")).drop("diffs")


@_register(
    _on_captures("""
select match_method, match_path, baseline_id, current_id, d.field, d.old_value, d.new_value
from (select *, unnest(diffs) as d from compared)""")
)
def diff_fields(spark, sf_dir):
    return compare.comparison_diffs(_compared(spark, sf_dir))


@_register(
    _on_captures("""
select count(*) filter (state = 'matched') as compared, count(*) filter (len(diffs) > 0) as regressions,
  count(*) filter (state = 'only_baseline') as only_baseline,
  count(*) filter (state = 'only_current') as only_current from compared""")
)
def comparison_summary(spark, sf_dir):
    return compare.comparison_summary(_compared(spark, sf_dir))


def _diff_pair(column: str, a: str, b: str) -> str:
    # The row number is the position in the log, from 0.
    every = f"""
select *, {_HEADERS_JSON} as request_headers, {_RESPONSE_JSON} as response_headers,
  row_number() over (order by seq) - 1 as place from requests"""
    return on_requests(
        f"""
select id_a, id_b, d.field, d.old_value, d.new_value
from (select old.id as id_a, new.id as id_b, unnest({_DIFF_LIST}) as d from old, new)""",
        every=every,
        old=f"select * from every where {column} = {a}",
        new=f"select * from every where {column} = {b}",
    )


@_register(_diff_pair("id", "'3'", "'417'"))
def diff_by_id(spark, sf_dir):
    return compare.diff_by_id(tables.requests(spark, sf_dir), "3", "417")


@_register(_diff_pair("place", "5", "900"))
def diff_by_index(spark, sf_dir):
    return compare.diff_by_index(tables.requests(spark, sf_dir), 5, 900)


@_register(
    with_tables(
        "baseline",
        "current_log",
        old=_latest("baseline", "method"),
        new=_latest("current_log", "method"),
        body=f"""
select * from (
  select coalesce(old.method, new.method) as method, coalesce(old.path, new.path) as path,
    case when new.id is null then 'only_in_snapshot' when old.id is null then 'only_in_current'
      when old.response_status is distinct from new.response_status then 'status_changed' end as change,
    cast(old.response_status as varchar) as snapshot_status,
    cast(new.response_status as varchar) as current_status from {_PAIRS}) where change is not null""",
    )
)
def snapshot_diff(spark, sf_dir):
    diff = compare.snapshot_diff(tables.baseline(spark, sf_dir), tables.current(spark, sf_dir))
    status = {c: F.col(c).cast("string") for c in ("snapshot_status", "current_status")}
    return diff.withColumns(status)


@_register(ORACLES["snapshot_diff"])
def snapshot_diff_bucketed(spark, sf_dir):
    """The snapshot stored by endpoint; only the log is shuffled."""
    table = f"endpoints_{uuid.uuid4().hex}"
    baselines.save_baseline(tables.baseline(spark, sf_dir), table, buckets=8, exact_method=True)
    diff = baselines.changes_since_baseline(spark, table, tables.current(spark, sf_dir))
    status = {c: F.col(c).cast("string") for c in ("snapshot_status", "current_status")}
    return diff.withColumns(status)


@_register(ORACLES["diff_fields"])
def diff_fields_bucketed(spark, sf_dir):
    """Differences from a baseline stored by endpoint."""
    table = f"endpoints_{uuid.uuid4().hex}"
    baselines.save_baseline(tables.baseline(spark, sf_dir), table, buckets=8)
    return compare.comparison_diffs(baselines.compare_with_baseline(spark, table, tables.current(spark, sf_dir)))


# --------------------------------------------------------------------------- annotations


@_register(
    with_tables(
        "requests",
        "annotations",
        body="""
select record_id, idx, note, coalesce(author, 'user') as author from annotations
where record_id in (select id from requests)""",
    )
)
def annotate_existing(spark, sf_dir):
    noted = annotations.annotate_existing(
        tables.annotations(spark, sf_dir), tables.requests(spark, sf_dir)
    )
    return noted.select("record_id", "idx", "note", "author")


@_register(
    with_tables(
        "requests",
        "annotations",
        body="""
select id as record_id, method, path, cast(idx as varchar) as idx, note, author
from requests left join annotations on id = record_id""",
    )
)
def annotations_listing(spark, sf_dir):
    listing = annotations.annotations_listing(
        tables.requests(spark, sf_dir), tables.annotations(spark, sf_dir)
    )
    return listing.withColumn("idx", F.col("idx").cast("string"))


@_register(with_tables("annotations", body="select distinct record_id from annotations"))
def annotated_ids(spark, sf_dir):
    return annotations.annotated_ids(tables.annotations(spark, sf_dir))


@_register(
    with_tables(
        "annotations",
        placed="""
select *, row_number() over (partition by record_id order by idx) - 1 as place from annotations""",
        body="""
select record_id, note, row_number() over (partition by record_id order by place) - 1 as idx
from placed where not exists (select 1 from annotations a
  where a.record_id = placed.record_id and a.idx = placed.place and a.author = 'assistant')""",
    )
)
def remove_annotation(spark, sf_dir):
    left = annotations.remove_annotations(
        tables.annotations(spark, sf_dir), tables.removals(spark, sf_dir)
    )
    return left.select("record_id", "note", "idx")


# --------------------------------------------------------------------------- replay results

_MATCHED = """
select record_id, run, attempt, status, recorded, error, coalesce(status = recorded, false) and error is null
  as matched
from (select attempts.*, response_status as recorded from attempts join requests
  on cast(record_id as varchar) = id)"""


def _matched(spark, sf_dir):
    return replay.replay_match(tables.requests(spark, sf_dir), tables.replay_attempts(spark, sf_dir))


@_register(
    with_tables(
        "requests",
        "attempts",
        matched=_MATCHED,
        body="""
select cast(record_id as varchar) as record_id, attempt, cast(status as varchar) as status,
  recorded as recorded_status, error, matched from matched""",
    )
)
def replay_match(spark, sf_dir):
    return _matched(spark, sf_dir).select(
        "record_id", "attempt", F.col("status").cast("string"), "recorded_status", "error", "matched"
    )


@_register(
    with_tables(
        "requests",
        "attempts",
        matched=_MATCHED,
        body="""
select count(*) as total, count(*) filter (matched) as matched,
  count(*) filter (not matched and error is null) as mismatched,
  count(*) filter (error is not null) as errored from matched""",
    )
)
def replay_summary(spark, sf_dir):
    return replay.replay_summary(_matched(spark, sf_dir))


@_register(
    with_tables(
        "attempts",
        body="""
select count(*) as total, count(*) filter (error is null and status is not null) as success,
  count(*) filter (error is not null) as errors,
  round(sum(duration_ms) filter (error is null) / count(*) filter (error is null), 4) as avg_duration_ms
from attempts""",
    )
)
def replay_pool_summary(spark, sf_dir):
    pooled = replay.pool_summary(tables.replay_attempts(spark, sf_dir))
    return pooled.withColumn("avg_duration_ms", F.round("avg_duration_ms", 4))


@_register(
    with_tables(
        "attempts",
        body="""
select coalesce(cast(status as varchar), 'unknown') as status, count(*) as n from attempts
where error is null group by 1""",
    )
)
def replay_pool_status_counts(spark, sf_dir):
    return replay.pool_status_counts(tables.replay_attempts(spark, sf_dir))


_OUTCOMES = """
select record_id, attempts, final_status, final_error,
  final_error is null and coalesce(final_status not in (500, 502, 503, 504), true) as succeeded
from (
  select record_id, status as final_status, error as final_error,
    count(*) over (partition by record_id) as attempts,
    row_number() over (partition by record_id order by attempt desc) as back from attempts)
where back = 1"""


@_register(
    with_tables(
        "attempts",
        outcomes=_OUTCOMES,
        body="""
select record_id, attempts, cast(final_status as varchar) as final_status, final_error, succeeded
from outcomes""",
    )
)
def retry_outcomes(spark, sf_dir):
    outcomes = replay.retry_outcomes(tables.replay_attempts(spark, sf_dir))
    return outcomes.withColumn("final_status", F.col("final_status").cast("string"))


@_register(
    with_tables(
        "attempts",
        outcomes=_OUTCOMES,
        body="""
select count(*) as total, count(*) filter (succeeded) as succeeded,
  count(*) filter (not succeeded) as failed, cast(sum(attempts) as bigint) as total_attempts
from outcomes""",
    )
)
def retry_summary(spark, sf_dir):
    return replay.retry_summary(replay.retry_outcomes(tables.replay_attempts(spark, sf_dir)))


@_register(
    with_tables(
        "attempts",
        body="""
select run, count(*) as total, count(*) filter (status < 400) as success_count,
  count(*) - count(*) filter (status < 400) as failure_count,
  count(*) filter (error is not null) as error_count from attempts group by run""",
    )
)
def run_summary(spark, sf_dir):
    return replay.run_summary(tables.replay_attempts(spark, sf_dir))


@_register(
    with_tables(
        "attempts",
        body="""
select run, status, count(*) as n from attempts where status is not null group by run, status""",
    )
)
def run_status_counts(spark, sf_dir):
    return replay.run_status_counts(tables.replay_attempts(spark, sf_dir))


# --------------------------------------------------------------------------- duplicates and merging

_COPIES = """partition by method, path, query_string, host, correlation, content_type, request_body"""


@_register(
    on_requests(f"select id from requests qualify row_number() over ({_COPIES} order by seq) = 1")
)
def dedup_unique(spark, sf_dir):
    return dedup.dedup_unique(tables.requests(spark, sf_dir)).select("id")


@_register(
    on_requests(f"select id from requests qualify row_number() over ({_COPIES} order by seq) > 1")
)
def dedup_duplicates(spark, sf_dir):
    return dedup.dedup_duplicates(tables.requests(spark, sf_dir)).select("id")


@_register(
    on_requests(
        f"select id, count(*) over ({_COPIES}) as group_size from requests"
        f" qualify count(*) over ({_COPIES}) > 1"
    )
)
def duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(tables.requests(spark, sf_dir)).select("id", "group_size")


@_register(
    with_tables(
        "document_requests",
        body="""
select id, count(*) over (partition by path, request_body) as group_size from document_requests
qualify count(*) over (partition by path, request_body) > 1""",
    )
)
def duplicate_uploads(spark, sf_dir):
    return dedup.duplicate_groups(tables.document_requests(spark, sf_dir)).select("id", "group_size")


_MERGED = """
select * from overlapping qualify row_number() over (
  partition by timestamp, method, path, response_status order by source_index, seq) = 1"""


@_register(with_tables("overlapping", body=f"select source_index, id from ({_MERGED})"))
def merge_sources(spark, sf_dir):
    return dedup.merge(tables.overlapping(spark, sf_dir)).select("source_index", "id")


@_register(with_tables("overlapping", body="select source_index, id from overlapping"))
def merge_union_all(spark, sf_dir):
    return dedup.merge(tables.overlapping(spark, sf_dir), deduplicate=False).select(
        "source_index", "id"
    )


_MERGE_STATS = f"""
select source_index, records, merged, records - merged as duplicates_skipped
from (select source_index, count(*) as records from overlapping group by 1)
join (select source_index, count(*) as merged from ({_MERGED}) group by 1) using (source_index)"""


@_register(with_tables("overlapping", body=_MERGE_STATS))
def merge_stats(spark, sf_dir):
    return dedup.merge_stats(tables.overlapping(spark, sf_dir))


@_register(
    with_tables(
        "overlapping",
        stats=_MERGE_STATS,
        body="""
select count(*) as total_sources, cast(sum(merged) as bigint) as total_merged,
  cast(sum(duplicates_skipped) as bigint) as duplicates_skipped from stats""",
    )
)
def merge_totals(spark, sf_dir):
    return dedup.merge_totals(tables.overlapping(spark, sf_dir))


# --------------------------------------------------------------------------- time and order


@_register(
    on_requests(
        """
select id, case when previous is not null
  then round(greatest(0.0, (timestamp - previous) * 1000.0), 3) end as gap_before_ms from lagged""",
        lagged="select *, lag(timestamp) over (order by timestamp, seq) as previous from requests",
    )
)
def timeline_gaps(spark, sf_dir):
    return timeseries.timeline_gaps(tables.requests(spark, sf_dir)).select(
        "id", _rounded("gap_before_ms", 3)
    )


@_register(
    on_requests("""
select count(*) as requests, round((max(timestamp) - min(timestamp)) * 1000.0, 3) as total_span_ms
from requests""")
)
def timeline_span(spark, sf_dir):
    return timeseries.timeline_span(tables.requests(spark, sf_dir)).select(
        "requests", _rounded("total_span_ms", 3)
    )


_PLACED = """
select *, row_number() over (partition by trunc(timestamp * 1000.0 / 3600000.0) order by timestamp, seq)
  as place from requests"""


@_register(on_requests("select id from placed where place <= 10", placed=_PLACED))
def throttle_kept(spark, sf_dir):
    return timeseries.throttle_kept(tables.requests(spark, sf_dir), 0.0028, 3_600_000).select("id")


@_register(on_requests("select id, place <= 10 as kept from placed", placed=_PLACED))
def throttle(spark, sf_dir):
    return timeseries.throttle(tables.requests(spark, sf_dir), 0.0028, 3_600_000).select("id", "kept")


@_register(
    on_requests(
        "select count(*) filter (place <= 10) as kept, count(*) filter (place > 10) as dropped from placed",
        placed=_PLACED,
    )
)
def throttle_counts(spark, sf_dir):
    return timeseries.throttle_counts(tables.requests(spark, sf_dir), 0.0028, 3_600_000)


@_register(
    on_requests("""
select id, (row_number() over (order by seq) - 1) // 25 as batch_id from requests
where response_status >= 400""")
)
def batch_records(spark, sf_dir):
    return timeseries.batch_records(
        tables.requests(spark, sf_dir), 25, predicate="response_status >= 400"
    ).select("id", "batch_id")


@_register(
    on_requests(
        """
select cast(ceil(least(count(*) filter (ok), 120) / 25) as bigint) as batches,
  least(count(*) filter (ok), 120) as records,
  count(*) filter (not ok and seq < coalesce((select seq from accepted where n = 121),
    (select max(seq) + 1 from requests))) as filtered_out
from (select *, response_status >= 400 as ok from requests)""",
        accepted="""
select seq, row_number() over (order by seq) as n from requests where response_status >= 400""",
    )
)
def batch_stats(spark, sf_dir):
    return timeseries.batch_stats(
        tables.requests(spark, sf_dir), 25, max_records=120, predicate="response_status >= 400"
    )


@_register(
    on_requests("""
select id, row_number() over (order by duration_ms desc, seq) - 1 as position from requests""")
)
def sort_requests(spark, sf_dir):
    ranked = paging.ranked(tables.requests(spark, sf_dir), "duration_ms", "desc")
    return ranked.select("id", "position")


@_register(on_requests("select id, path from requests order by seq limit 50 offset 300"))
def paginate(spark, sf_dir):
    return paging.paginate(tables.requests(spark, sf_dir), 7, 50).select("id", "path")


@_register(
    on_requests("""
select 7 as page, 50 as page_size, count(*) as total, greatest(1, (count(*) + 49) // 50) as total_pages,
  7 < greatest(1, (count(*) + 49) // 50) as has_next, true as has_prev from requests""")
)
def page_meta(spark, sf_dir):
    return paging.page_meta(tables.requests(spark, sf_dir), 7, 50)


@_register(on_requests("select id from requests order by timestamp desc, seq limit 250"))
def trim_newest(spark, sf_dir):
    return paging.trim(tables.requests(spark, sf_dir), 250).select("id")


@_register(on_requests("select id from requests order by timestamp, seq limit 250"))
def trim_oldest(spark, sf_dir):
    return paging.trim(tables.requests(spark, sf_dir), 250, newest=False).select("id")


@_register(
    on_requests("""
select count(*) as total_before, least(count(*), 250) as kept, count(*) - least(count(*), 250) as removed
from requests""")
)
def trim_counts(spark, sf_dir):
    return paging.trim_counts(tables.requests(spark, sf_dir), 250)


# --------------------------------------------------------------------------- streaming


@_register(
    on_requests(f"select id, method, path, timestamp from requests where timestamp >= {tables.MIDDLE}")
)
def stream_new_records(spark, sf_dir):
    before, _, after = tables.overlapping(spark, sf_dir)
    path, out = scratch_path(spark, "stream-log"), scratch_path(spark, "stream-out")
    # The later capture arrives twice, next to the records that were there before.
    for part in (before, after, after):
        log.append_log(part, path)
    fresh = watch.new_records(watch.stream_log(spark, path), before)
    query = (
        fresh.select("id", "method", "path", "timestamp")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("id string, method string, path string, timestamp double").parquet(out)


@_register(on_requests("select id, upper(method) as method, path from requests where response_status >= 400"))
def stream_row_operators(spark, sf_dir):
    """Row operators on a stream, as on a table."""
    path, out = scratch_path(spark, "stream-log"), scratch_path(spark, "stream-out")
    log.append_log(tables.requests(spark, sf_dir), path)
    errors = transforms.normalize(watch.stream_log(spark, path)).where("response_status >= 400")
    query = (
        errors.select("id", "method", "path")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("id string, method string, path string").parquet(out)


@_register(
    on_requests("""
select id from requests where response_status = 200 and timestamp < %(m)s
union all
(select id from requests where response_status = 200 and timestamp >= %(m)s order by seq limit 100)""" % {"m": tables.MIDDLE})
)
def stream_limited_batches(spark, sf_dir):
    """A consumer with a limit of records, stopped and started again in between."""
    everything = tables.requests(spark, sf_dir)
    early, late = everything.where(F.col("timestamp") < tables.MIDDLE), everything.where(F.col("timestamp") >= tables.MIDDLE)
    path, out, checkpoint = (scratch_path(spark, f"stream-{p}") for p in ("log", "out", "checkpoint"))
    limit = early.where("response_status = 200").count() + 100
    for part in (early, late, late):
        log.append_log(part, path)
        watch.consume_batches(
            watch.stream_log(spark, path), lambda batch, n: batch.select("id").write.mode("append").parquet(out), checkpoint,
            "response_status = 200", max_records=limit,
        ).awaitTermination()
    return spark.read.schema("id string").parquet(out)
