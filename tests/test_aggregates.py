from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from callsift.operators import aggregates as ag
from callsift.operators import profiling


def test_endpoint_stats_keep_methods_as_written(log, values):
    df = log(
        {"method": "GET", "path": "/a", "duration_ms": 10.0},
        {"method": "GET", "path": "/a", "duration_ms": None, "response_status": 500},
        {"method": "get", "path": "/a", "duration_ms": 30.0, "response_status": 404},
    )
    stats = ag.endpoint_stats(df).drop("first_seen").orderBy("method")
    assert values(stats) == [
        ("GET", "/a", 2, 10.0, 5.0, 1, 0.5),
        ("get", "/a", 1, 30.0, 30.0, 1, 1.0),
    ]
    assert sorted(values(ag.endpoint_status_counts(df), "method", "response_status", "n")) == [
        ("GET", 200, 1), ("GET", 500, 1), ("get", 404, 1),
    ]


def test_top_endpoints_break_ties_by_first_seen(log, values):
    df = log({"path": "/b"}, {"path": "/a"}, {"path": "/c", "duration_ms": 99.0}, {"path": "/c"})
    assert values(ag.endpoint_top_n(df, 2), "path") == ["/c", "/b"]
    assert values(ag.endpoint_top_n(df, 1, "duration"), "path") == ["/c"]
    with pytest.raises(ValueError):
        ag.endpoint_top_n(df, 1, "nope")


def test_summary_and_its_ties(log, values):
    df = log(
        {"path": "/a", "duration_ms": 5.0},
        {"path": "/b", "duration_ms": 5.0},
        {"path": "/c", "duration_ms": None, "response_status": 400},
    )
    assert values(ag.summary(df)) == [(3, 5.0, "/b", 5.0, "/a", 5.0, 1 / 3)]
    assert values(ag.summary(df.limit(0))) == [(0, None, None, None, None, None, 0.0)]
    assert values(ag.top_paths(df, 2)) == [("/a", 1), ("/b", 1)]


def test_groups(log, values):
    df = log(
        {"method": "get", "path": "/a/b", "duration_ms": 1.0},
        {"method": "GET", "path": "/a/c", "duration_ms": 3.0, "response_status": 404},
    )
    assert values(ag.group_stats(df, "method")) == [("GET", 2, 2.0)]
    assert sorted(values(ag.group_stats(df, "status"), "key")) == ["200", "404"]
    assert values(ag.group_stats(df, "path_prefix"), "key") == ["/a"]
    assert sorted(values(ag.group_stats(df, "path_prefix", 2), "key")) == ["/a/b", "/a/c"]
    assert values(ag.group_stats(df, F.lit("all")), "key", "requests") == [("all", 2)]


def test_split_leaves_null_keys_unmatched(log, values):
    df = log({"response_status": None}, {"path": None}, {"path": "/x/y"})
    assert sorted(values(ag.split_counts(df, "status_class"))) == [("2xx", 2), ("unknown", 1)]
    counts = ag.split_counts(df, "path_prefix")
    assert sorted(values(counts), key=str) == [("/api", 1), ("/x", 1), (None, 1)]


def test_pivot_fills_gaps_and_sorts(log, values):
    df = log(
        {"method": "post", "response_status": 201},
        {"method": "GET", "response_status": 500},
        {"method": "GET", "response_status": 200},
    )
    table = ag.pivot(df)
    assert table.columns == ["row", "2xx", "5xx"]
    assert values(table) == [("GET", 1, 1), ("POST", 1, 0)]
    assert ag.pivot(df, col_by="status", values=["500", "404"]).columns == ["row", "404", "500", "other"]
    with pytest.raises(ValueError):
        ag.pivot(df, row_by="nope")


def test_correlation_takes_the_first_non_empty_header(log, values):
    df = log(
        {"request_headers": {"X-Trace-ID": "t", "x-correlation-id": ""}, "timestamp": 1.0},
        {"request_headers": {"x-TRACE-id": "t"}, "timestamp": 4.0},
        {"request_headers": {"Traceparent": "p", "X-Request-Id": "r"}},
        {},
    )
    assert sorted(values(ag.correlation_chains(df))) == [
        ("__uncorrelated__", 1, 0.0, 0.0), ("r", 1, 0.0, 0.0), ("t", 2, 1.0, 4.0),
    ]
    assert values(ag.correlation_totals(df)) == [(3, 3, 1)]


def test_percentiles_on_ten_values(log, values):
    df = log(*[{"duration_ms": float(v)} for v in range(10, 101, 10)])
    assert values(profiling.latency_profile(df)) == [(10, 10.0, 100.0, 55.0, 50.0, 90.0, 100.0)]
    empty = profiling.latency_profile(df.limit(0))
    assert values(empty) == [(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 99, 100, 101])
def test_percentiles_are_nearest_rank_per_group(log, values, n):
    durations = [((i * 7919) % 101) * 0.37 - 3 for i in range(n)] + [5.0] * (n // 2)
    df = log(*[{"duration_ms": d, "path": p} for d in durations for p in ("/a", "/b")])
    ordered = sorted(durations)

    def rank(p):
        return ordered[max(0, math.ceil(p / 100.0 * len(ordered)) - 1)]

    got = profiling.latency_profile(df, ["path"]).orderBy("path")
    assert values(got, "path", "p50_ms", "p90_ms", "p99_ms", "requests") == [
        (path, rank(50), rank(90), rank(99), len(ordered)) for path in ("/a", "/b")
    ]


def test_approximate_profile(log, values):
    df = log(*[{"duration_ms": float(v)} for v in range(1, 101)], {"duration_ms": None})
    assert values(profiling.latency_profile(df, approximate=True), "requests", "p50_ms") == [(100, 50.0)]


def test_histogram_labels(log, values):
    df = log({"duration_ms": 49.9}, {"duration_ms": 50.0}, {"duration_ms": 5000.0}, {"duration_ms": None})
    assert sorted(values(profiling.latency_histogram(df))) == [("<100ms", 1), ("<50ms", 1), (">=5000ms", 1)]
    assert sorted(values(profiling.latency_histogram(df, [60]))) == [("<60ms", 2), (">=60ms", 1)]


def test_profile_of_many_values_in_one_bin_and_nan(spark, values):
    """Half a million different values within one bin, and NaN above all numbers."""
    near = spark.range(500_000).select((1000.0 + F.col("id") / 1e7).alias("duration_ms"))
    row = profiling.latency_profile(near).first()
    assert (row.requests, row.p50_ms, row.p90_ms, row.p99_ms) == (
        500_000, 1000.0 + 249_999 / 1e7, 1000.0 + 449_999 / 1e7, 1000.0 + 494_999 / 1e7,
    )
    some = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "duration_ms double")
    row = profiling.latency_profile(some).first()
    assert (row.p50_ms, str(row.p99_ms), str(row.max_ms)) == (2.0, "nan", "nan")


def test_pivot_with_listed_values_counts_every_request(spark):
    rows = [("GET", 200), ("GET", 101), ("GET", None), ("PUT", None)]
    df = spark.createDataFrame(rows, "method string, response_status int")
    found = ag.pivot(df, values=["2xx", "3xx"]).collect()
    assert [tuple(r) for r in found] == [("GET", 1, 0, 2), ("PUT", 0, 0, 1)]


def test_percentiles_of_infinity_and_nan(log, values):
    """Numbers, then infinity, then NaN; minus infinity comes first."""
    inf, nan = float("inf"), float("nan")
    df = log(*[{"duration_ms": v} for v in (1.0, 2.0, inf, nan)])
    p50, p75, p90 = values(profiling.latency_profile(df, percentiles=(50, 75, 90)), "p50_ms", "p75_ms", "p90_ms")[0]
    assert (p50, p75) == (2.0, inf) and p90 != p90
    df = log(*[{"duration_ms": v} for v in (-inf, 3.0, inf, inf)])
    assert values(profiling.latency_profile(df, percentiles=(25, 50, 75)), "p25_ms", "p50_ms", "p75_ms") == [(-inf, 3.0, inf)]


def test_merged_profile_equals_the_exact_one_while_sketches_hold_all(log, values):
    day = 86_400.0
    rows = [{"duration_ms": float(v % 97), "timestamp": day * (v % 5), "path": f"/{v % 2}"} for v in range(1_000)]
    rows += [{"duration_ms": v, "path": "/odd"} for v in (1.0, 2.0, float("inf"), float("nan"))]
    rows += [{"duration_ms": None, "path": "/none"}, {"duration_ms": float("nan"), "path": "/nan"}]
    rows += [{"duration_ms": 7.0, "timestamp": None, "path": "/0"}]
    df = log(*rows)
    summaries = profiling.latency_summaries(df)
    assert repr(sorted(values(profiling.merged_profile(summaries, ["path"])))) == repr(
        sorted(values(profiling.latency_profile(df, ["path"])))
    )
    two_days = df.where((F.col("timestamp") >= day) & (F.col("timestamp") < 3 * day))
    assert values(profiling.merged_profile(summaries, first_day=1, last_day=2)) == values(profiling.latency_profile(two_days))
    assert values(profiling.merged_profile(summaries, first_day=90)) == []


def test_merged_profile_is_within_its_error(spark):
    df = spark.range(200_000).selectExpr(
        "'GET' as method", "'/a' as path", "86400.0D * (id % 20) as timestamp", "cast(xxhash64(id) % 50000 as double) as duration_ms"
    )
    row = profiling.merged_profile(profiling.latency_summaries(df, k=512)).first()
    for p in (50, 90, 99):
        rank = df.where(F.col("duration_ms") <= row[f"p{p}_ms"]).count()
        assert abs(rank - 2_000 * p) <= 2 * profiling.rank_error(512) * 200_000
