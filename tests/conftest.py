from __future__ import annotations

import pytest

from callsift.schema import REQUEST_SCHEMA
from tests.session import local_session

DEFAULTS = {
    "id": "1",
    "seq": 0,
    "timestamp": 0.0,
    "method": "GET",
    "url": None,
    "path": "/api",
    "query_string": "",
    "service": None,
    "request_headers": {},
    "request_body": None,
    "response_status": 200,
    "response_headers": {},
    "response_body": None,
    "duration_ms": 10.0,
    "tags": [],
}


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Requests from dicts; ``seq`` and ``id`` count up unless given."""

    def build(*rows: dict):
        full = [
            tuple({**DEFAULTS, "seq": i, "id": str(i), **row}[f.name] for f in REQUEST_SCHEMA)
            for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(full, REQUEST_SCHEMA)

    return build


@pytest.fixture
def values():
    """Rows of a DataFrame as tuples; bare values for a single column."""

    def collect(df, *columns):
        rows = df.select(*columns).collect() if columns else df.collect()
        return [r[0] if len(r) == 1 else tuple(r) for r in rows]

    return collect
