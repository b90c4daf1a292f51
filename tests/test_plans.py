"""What reaches the scan and the shuffle."""

from __future__ import annotations

import pytest

from callsift.operators import aggregates, dedup, filters, inspection, profiling, transforms
from callsift.sources.log import append_log, read_log
from callsift.workload.tables import requests


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "log")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    append_log(requests(spark, "/root/testdata/sf0.001"), path, "parquet")
    return read_log(spark, path, "parquet", strict=False)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(stored):
    found = filters.filter_requests(stored, path_prefix="/api/c", status=200, min_duration_ms=5)
    plan = _plan(aggregates.endpoint_stats(found))
    for pushed in ("StringStartsWith(path,/api/c)", "EqualTo(response_status,200)"):
        assert pushed in plan
    assert "GreaterThanOrEqual(duration_ms,5.0)" in plan
    read = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "body" not in read and "headers" not in read
    assert "EqualTo(id,7)" in _plan(filters.find_by_id(stored, "7"))


def test_row_operators_do_not_shuffle_or_leave_the_jvm(stored):
    chained = transforms.truncate(transforms.anonymize(transforms.normalize(stored)))
    plan = _plan(chained)
    assert "Exchange" not in plan and "Python" not in plan
    warnings = inspection.inspection_warnings(inspection.inspect(stored))
    assert "Python" not in _plan(warnings) and "Exchange" not in _plan(warnings)


def test_aggregates_reduce_before_the_shuffle(stored):
    plan = _plan(aggregates.endpoint_stats(stored))
    assert plan.count("HashAggregate") == 2 and "partial_sum" in plan
    assert "WindowGroupLimit" in _plan(dedup.dedup_unique(stored))


def test_no_plan_has_a_cross_join(stored):
    for df in (
        dedup.duplicate_groups(stored),
        dedup.dedup_duplicates(stored),
        profiling.latency_profile(stored),
        profiling.latency_profile(stored, ["method"]),
    ):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
