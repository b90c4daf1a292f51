"""Stored baselines, counted rewrites and heavy paths."""

from __future__ import annotations

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callsift.operators import aggregates, compare, transforms
from callsift.sources import baselines, rewrites
from callsift.sources.log import append_log
from callsift.streaming.watch import stream_log
from callsift.workload import tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def table():
    return f"baseline_{uuid.uuid4().hex}"


def _rows(df):
    return Counter(repr(r) for r in df.select(*sorted(df.columns)).collect())


def _odd(log):
    old = log(
        {"method": "get", "path": "/a", "response_status": 200},
        {"method": "GET", "path": "/a", "response_status": 500},
        {"method": None, "path": "/a"}, {"method": "GET", "path": None, "response_status": None},
        {"method": "GET", "path": "/only-old"}, {"method": "GET", "path": "null", "request_headers": {"b": "2", "a": "1"}},
    )
    new = log(
        {"method": "GET", "path": "/a", "response_status": 200},
        {"method": None, "path": "/a", "response_status": 404}, {"method": "GET", "path": None, "response_status": 200},
        {"method": "PUT", "path": "/only-new"}, {"method": "GET", "path": "null", "request_headers": {"a": "1", "b": "2"}},
    )
    return old, new


def test_stored_baselines_compare_like_logs(spark, log, table):
    old, new = _odd(log)
    for before, after in ((old, new), (old, old), (old.where("false"), new), (old, new.where("false"))):
        baselines.save_baseline(before, table, buckets=3)
        found = baselines.compare_with_baseline(spark, table, after)
        assert _rows(found) == _rows(compare.compare_sets(before, after))
        baselines.save_baseline(before, f"{table}_exact", buckets=4, exact_method=True)
        changes = baselines.changes_since_baseline(spark, f"{table}_exact", after)
        assert _rows(changes) == _rows(compare.snapshot_diff(before, after))


def test_stored_baselines_are_not_shuffled(spark, table):
    baselines.save_baseline(tables.baseline(spark, SF_DIR), table, buckets=5, exact_method=True)
    changes = baselines.changes_since_baseline(spark, table, tables.current(spark, SF_DIR))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = changes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and table in line)
    above, at = [], depth[scan]
    for i in range(scan - 1, -1, -1):
        if depth[i] < at:
            above.append(lines[i])
            at = depth[i]
    joined = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert "SelectedBucketsCount: 5 out of 5" in lines[scan] and "bod" not in lines[scan].split("ReadSchema")[1]
    assert not any("Exchange" in line for line in above[:joined])
    with pytest.raises(ValueError, match="no buckets"):
        tables.baseline(spark, SF_DIR).limit(3).write.saveAsTable(f"{table}_plain")
        baselines.changes_since_baseline(spark, f"{table}_plain", tables.current(spark, SF_DIR))


def test_rewrites_are_counted_while_written(spark, log, tmp_path):
    df = log({"request_body": " x "}, {"method": "get"}, {"request_body": " y"})
    counts = rewrites.write_rewritten(transforms.normalize(df), "changed", str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert (counts.total, counts.changed, counts.unchanged) == (3, 2, 1) and read.columns == df.columns
    empty = rewrites.write_rewritten(transforms.normalize(df.where("false")), "changed", str(tmp_path / "none"), keep_flag=True)
    assert (empty.total, empty.changed, empty.unchanged) == (0, 0, 0)
    assert "changed" in spark.read.parquet(str(tmp_path / "none")).columns


def test_streams_are_rewritten_and_counted_over_restarts(spark, log, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("log", "out", "checkpoint"))
    for rows in ([{"id": "1", "request_body": " x "}, {"id": "2"}], [{"id": "3", "method": "put", "request_body": "y "}], []):
        if rows:
            append_log(log(*rows), source)
        stream = transforms.normalize(stream_log(spark, source))
        rewrites.rewrite_stream(stream, "changed", out, checkpoint).awaitTermination()
    assert sorted(r.method for r in spark.read.parquet(out).collect()) == ["GET", "GET", "PUT"]
    assert tuple(rewrites.rewritten_counts(spark, out).first()) == (3, 2, 1)


def test_heavy_paths_equal_top_paths(spark, log, values, monkeypatch):
    paths = [f"/p{i % 97}" for i in range(400)] + [f"/once/{i}" for i in range(300)] + [None] * 5 + ["/late"] * 9
    df = log(*[{"path": p} for p in paths])
    for candidates, followed, buckets in ((1_000, 50_000, 65_536), (20, 20, 16), (20, 40, 1)):
        monkeypatch.setattr(aggregates, "CANDIDATES", candidates)
        monkeypatch.setattr(aggregates, "FOLLOWED", followed)
        monkeypatch.setattr(aggregates, "PATH_BUCKETS", buckets)
        for n in (1, 5, 20):
            assert values(aggregates.heavy_paths(df, n)) == values(aggregates.top_paths(df, n))
    assert values(aggregates.heavy_paths(df.where("false"), 3)) == []
    few = df.where("path = '/late'")
    assert values(aggregates.heavy_paths(few.withColumn("bucket", F.lit("?")), 3)) == [("/late", 9)]
    with pytest.raises(ValueError, match="n must be"):
        aggregates.heavy_paths(df, 21)
