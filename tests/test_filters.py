from __future__ import annotations

import hashlib

import pytest

from callsift.operators import filters


def test_filter_is_a_conjunction_with_inclusive_bounds(log, values):
    df = log(
        {"method": "get", "path": "/api/a", "duration_ms": 10.0},
        {"method": "GET", "path": "/api/b", "duration_ms": 20.0},
        {"method": "GET", "path": "/other", "duration_ms": 20.0},
        {"method": "POST", "path": "/api/c", "duration_ms": 15.0},
        {"method": "GET", "path": "/api/d", "duration_ms": None},
    )
    bounded = dict(min_duration_ms=10, max_duration_ms=20)
    assert values(filters.filter_requests(df, "Get", "/api", 200, **bounded), "id") == ["0", "1"]
    assert filters.filter_requests(df, method="", path_prefix="", host="").count() == 5


def test_host_is_the_exact_header(log, values):
    df = log(
        {"request_headers": {"Host": "a"}}, {"request_headers": {"host": "a"}}, {"request_headers": {}}
    )
    assert values(filters.filter_requests(df, host="a"), "id") == ["0"]


def test_lookups(log, values):
    df = log({"id": "x", "path": "/1", "tags": ["t"]}, {"id": "x", "path": "/2"}, {"tags": ["u", "t"]})
    assert values(filters.find_by_id(df, "x"), "path") == ["/1"]
    assert filters.find_by_id(df, "nope").count() == 0
    assert sorted(values(filters.find_by_tag(df, "t"), "id")) == ["2", "x"]


def test_sample_follows_the_md5_of_the_id(log, values):
    ids = [f"req-{i}" for i in range(200)]
    df = log(*[{"id": i} for i in ids])
    want = [i for i in ids if int(hashlib.md5(i.encode()).hexdigest(), 16) % 10_000 / 10_000 < 0.4]
    assert values(filters.hash_sample(df, 0.4, seed=1), "id") == want
    assert values(filters.hash_sample(df, 0.4, seed=2), "id") == want
    assert filters.hash_sample(df, 0.0).count() == 0
    assert filters.hash_sample(df, 1.0).count() == 200
    assert filters.hash_sample(df, 1.0, predicate="id = 'req-7'").count() == 1
    assert filters.hash_sample(df, 1.0, predicate="cast(null as boolean)").count() == 0


@pytest.mark.parametrize("rate", [-0.1, 1.1])
def test_sample_rate_is_checked(log, rate):
    with pytest.raises(ValueError, match="rate"):
        filters.hash_sample(log({}), rate)
