"""The derived tables of :mod:`callsift.workload.tables` as DuckDB SQL."""

from __future__ import annotations

from callsift.workload.tables import EARLY, LATE, MIDDLE

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

_K = "cast(json_extract_string(props, '$.k') as int)"

TABLES = {
    "requests": f"""
select cast(event_id as varchar) as id, event_id as seq, epoch_us(ts) / 1e6 as timestamp,
  case event_type when 'view' then 'GET' when 'click' then 'get' when 'purchase' then 'POST'
    when 'signup' then 'PUT' else 'DELETE' end as method,
  concat('/api/', event_type, '/', cast(user_id % 10 as varchar)) as path,
  case when k % 3 = 0 then '' else concat('k=', cast(k as varchar)) end as query_string,
  concat('svc', cast(k % 5 as varchar)) as host,
  case when k % 4 <> 0 then concat('corr-', cast(user_id as varchar), '-', cast(k % 7 as varchar)) end
    as correlation,
  case event_type when 'purchase' then 'application/json'
    when 'signup' then 'application/json; charset=utf-8' end as content_type,
  case when event_type in ('purchase', 'error') then props
    when event_type = 'signup' then replace(props, '}}', '') end as request_body,
  response_status,
  case when response_status >= 400 then 'application/json' else 'text/html' end as response_type,
  case when response_status >= 500 then concat('{{"error": ', cast(response_status as varchar))
    when response_status = 404 then '{{"error": 404}}' else '' end as response_body,
  value * 10 as duration_ms,
  list_filter([event_type, case when k % 5 = 0 then 'canary' end,
    case when response_status >= 500 then 'alert' end], lambda x: x is not null) as tags
from (
  select *, {_K} as k,
    cast(case when event_type = 'error' then 500 + {_K} % 4 when {_K} % 10 = 0 then 404
      when {_K} % 10 = 1 then 301 else 200 end as int) as response_status
  from events)""",
    "baseline": f"""
select * replace (case when path = '/api/signup/0' then '/api/register/0' else path end as path)
from requests where timestamp < {MIDDLE}""",
    "current_log": f"""
select * replace (case when path = '/api/view/1' then '/api/show/1' else path end as path)
from requests where timestamp >= {MIDDLE}""",
    "overlapping": f"""
select 0 as source_index, * from requests where timestamp < {MIDDLE}
union all select 1, * from requests where timestamp >= {EARLY} and timestamp < {LATE}
union all select 2, * from requests where timestamp >= {MIDDLE}""",
    "document_requests": """
select cast(doc_id as varchar) as id, doc_id as seq, concat('/', source, '/', lang) as path,
  text as request_body from documents""",
    "page_requests": r"""
select cast(page_id as varchar) as id, page_id as seq, starts_with(url, 'http:') as untidy,
  regexp_extract(url, '^https?://([^/?#]*)', 1) as host,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as url_path,
  regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query_string,
  case when starts_with(url, 'http:')
    then concat(chr(160), chr(10), ' ', html, ' ', chr(8195), chr(9)) else html end as response_body
from pages""",
    "chat_requests": """
select concat(cast(conv_id as varchar), '-', cast(turn as varchar)) as id, role,
  concat('{"Password" : "', role, '", "secret":"', cast(conv_id as varchar), '", "text": "',
    replace(text, '"', ''), '"}') as request_body,
  cast(conv_id as varchar) as correlation, cast(turn as varchar) as turn, conv_id
from conversations""",
    "annotations": """
select cast(conv_id * 100 as varchar) as record_id, cast(turn as bigint) as idx, text as note,
  case when role <> 'user' then role end as author from conversations""",
    "attempts": f"""
select event_id // 3 as record_id, event_id // 3000 as run, cast(event_id % 3 + 1 as int) as attempt,
  case when event_type = 'error' and {_K} % 4 = 0 then null when event_type = 'error' then 500 + {_K} % 4
    when {_K} % 10 = 0 then 404 else 200 end as status,
  case when event_type = 'error' and {_K} % 4 = 0 then 'timeout' end as error,
  value * 10 as duration_ms
from events""",
}

_NEEDS = {
    "baseline": ("requests",),
    "current_log": ("requests",),
    "overlapping": ("requests",),
}


def with_tables(*names: str, body: str, **more: str) -> str:
    """``body`` behind the named tables and the further expressions ``more``."""
    ctes: dict[str, str] = {}
    for name in names:
        for needed in (*_NEEDS.get(name, ()), name):
            ctes[needed] = TABLES[needed]
    listed = ",\n".join(f"{name} as ({text.strip()})" for name, text in {**ctes, **more}.items())
    return f"with {listed}\n{body.strip()}"


def on_requests(body: str, **more: str) -> str:
    return with_tables("requests", body=body, **more)
