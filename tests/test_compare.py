from __future__ import annotations

from callsift.operators import annotations as an
from callsift.operators import compare, dedup, replay


def test_compare_matches_the_last_request_of_each_key(log, values):
    base = log(
        {"id": "b0", "path": "/a", "response_status": 500},
        {"id": "b1", "path": "/a", "method": "get"},
        {"id": "b2", "path": "/gone"},
        {"id": "b3", "path": "/same", "timestamp": 1.0, "duration_ms": 1.0},
        {"id": "b4", "path": None},
    )
    cur = log(
        {"id": "c0", "path": "/a", "response_status": 404, "request_headers": {"A": "1"}},
        {"id": "c1", "path": "/new"},
        {"id": "c2", "path": "/same", "timestamp": 9.0},
        {"id": "c3", "path": "/same", "method": "POST"},
        {"id": "c4", "path": None, "request_body": ""},
    )
    compared = compare.compare_sets(base, cur)
    assert sorted(values(compared, "state", "baseline_id", "current_id"), key=str) == [
        ("matched", "b1", "c0"),
        ("matched", "b3", "c2"),
        ("matched", "b4", "c4"),
        ("only_baseline", "b2", None),
        ("only_current", None, "c1"),
        ("only_current", None, "c3"),
    ]
    diffs = compare.comparison_diffs(compared)
    assert sorted(values(diffs, "baseline_id", "field", "old_value", "new_value"), key=str) == [
        ("b1", "method", "get", "GET"),
        ("b1", "request_headers", "[]", '[{"key":"A","value":"1"}]'),
        ("b1", "response_status", "200", "404"),
        ("b4", "request_body", None, ""),
    ]
    assert values(compare.comparison_summary(compared)) == [(3, 2, 1, 2)]


def test_snapshot_diff_uses_raw_methods(log, values):
    snap = log({"path": "/a"}, {"path": "/a", "response_status": 500}, {"path": "/s"}, {"path": "/n", "response_status": None})
    cur = log({"path": "/a"}, {"method": "get", "path": "/s"}, {"path": "/n", "response_status": None})
    assert sorted(values(compare.snapshot_diff(snap, cur)), key=str) == [
        ("GET", "/a", "status_changed", 500, 200),
        ("GET", "/s", "only_in_snapshot", 200, None),
        ("get", "/s", "only_in_current", None, 200),
    ]


def test_diff_two_requests(log, values):
    df = log({"path": "/a", "timestamp": 3.0}, {"path": "/a", "duration_ms": 99.0}, {"path": "/b"})
    assert compare.diff_by_id(df, "0", "1").count() == 0
    assert values(compare.diff_by_id(df, "0", "2"), "field", "old_value", "new_value") == [("path", "/a", "/b")]
    assert compare.diff_by_id(df, "0", "9").count() == 0
    assert values(compare.diff_by_index(df, 1, 2), "id_a", "id_b") == [("1", "2")]
    assert compare.diff_by_index(df, 1, 3).count() == 0


def test_dedup_ignores_time_status_and_header_order(log, values):
    df = log(
        {"timestamp": 1.0, "request_headers": {"a": "1", "b": "2"}},
        {"timestamp": 2.0, "request_headers": {"b": "2", "a": "1"}, "response_status": 500},
        {"method": "POST"},
        {"request_body": ""},
        {"method": "POST", "timestamp": 9.0},
        {"request_body": None, "method": "POST", "query_string": "q"},
    )
    assert sorted(values(dedup.dedup_unique(df), "id")) == ["0", "2", "3", "5"]
    assert sorted(values(dedup.dedup_duplicates(df), "id")) == ["1", "4"]
    groups = dedup.duplicate_groups(df)
    assert sorted(values(groups, "id", "group_size")) == [("0", 2), ("1", 2), ("2", 2), ("4", 2)]


def test_exact_copies_part_into_one_unique_and_the_rest(log, values):
    df = log(*[{"id": "x", "seq": 7} for _ in range(50)], {"id": "y", "path": "/other"}).drop("seq")
    assert sorted(values(dedup.dedup_unique(df), "id")) == ["x", "y"]
    assert values(dedup.dedup_duplicates(df), "id") == ["x"] * 49
    assert dedup.duplicate_groups(df).count() == 50


def test_merge(log, values):
    first = log({"id": "a", "timestamp": 1.0}, {"id": "b", "timestamp": 2.0, "response_status": None})
    second = log({"id": "c", "timestamp": 1.0}, {"id": "d", "timestamp": 2.0, "response_status": None}, {"id": "e"})
    none = first.limit(0)
    merged = dedup.merge([first, second, none])
    assert sorted(values(merged, "source_index", "id")) == [(0, "a"), (0, "b"), (1, "e")]
    assert dedup.merge([first, second], deduplicate=False).count() == 5
    stats = dedup.merge_stats([first, second, none]).orderBy("source_index")
    assert values(stats) == [(0, 2, 2, 0), (1, 3, 1, 2), (2, 0, 0, 0)]
    assert values(dedup.merge_totals([first, second, none])) == [(3, 3, 2)]
    assert values(dedup.merge_totals([first, second], deduplicate=False)) == [(2, 5, 0)]


def test_annotations(spark, log, values):
    requests = log({"id": "r1"}, {"id": "r2"})
    notes = spark.createDataFrame([("r1", 0, "n"), ("r1", 1, "m"), ("zz", 0, "x")], "record_id string, idx bigint, note string")
    kept = an.annotate_existing(notes, requests)
    assert sorted(values(kept, "record_id", "idx", "note", "author")) == [("r1", 0, "n", "user"), ("r1", 1, "m", "user")]
    listing = an.annotations_listing(requests, kept).orderBy("record_id", "idx")
    assert values(listing, "record_id", "note") == [("r1", "n"), ("r1", "m"), ("r2", None)]
    assert values(an.annotated_ids(kept)) == ["r1"]
    gone = spark.createDataFrame([("r1", 0), ("r1", 5), ("r2", 0)], "record_id string, idx int")
    assert values(an.remove_annotations(kept, gone), "record_id", "idx", "note") == [("r1", 0, "m")]


def test_replay_analysis(spark, log, values):
    requests = log({"id": "1"}, {"id": "2", "response_status": 404})
    results = spark.createDataFrame(
        [
            (1, 0, 1, 500, None, 10.0),
            (1, 0, 2, 200, None, 20.0),
            (2, 0, 1, None, "timeout", None),
            (2, 1, 2, 404, None, 30.0),
            (3, 1, 1, None, None, 40.0),
        ],
        "record_id bigint, run bigint, attempt int, status int, error string, duration_ms double",
    )
    matched = replay.replay_match(requests, results)
    assert sorted(values(matched, "record_id", "attempt", "matched")) == [
        ("1", 1, False), ("1", 2, True), ("2", 1, False), ("2", 2, True),
    ]
    assert values(replay.replay_summary(matched)) == [(4, 2, 1, 1)]
    assert values(replay.pool_summary(results)) == [(5, 3, 1, 25.0)]
    assert values(replay.pool_summary(results.limit(0))) == [(0, 0, 0, 0.0)]
    assert sorted(values(replay.pool_status_counts(results))) == [("200", 1), ("404", 1), ("500", 1), ("unknown", 1)]
    outcomes = replay.retry_outcomes(results).orderBy("record_id")
    assert values(outcomes) == [(1, 2, 200, None, True), (2, 2, 404, None, True), (3, 1, None, None, True)]
    assert values(replay.retry_summary(outcomes)) == [(3, 3, 0, 5)]
    assert values(replay.run_summary(results).orderBy("run")) == [(0, 3, 1, 2, 1), (1, 2, 0, 2, 0)]
    assert values(replay.run_status_counts(results).orderBy("run", "status")) == [(0, 200, 1), (0, 500, 1), (1, 404, 1)]
