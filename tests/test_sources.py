from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from callsift.schema import REQUEST_SCHEMA, conform
from callsift.sources import archive, exports, log as logs, snapshots, split

RECORD = {
    "id": "a",
    "timestamp": 1704067207.25,
    "method": "GET",
    "url": "http://h.example/a/b?x=1#f",
    "request_headers": {"Host": "h"},
    "request_body": None,
    "response_status": 200,
    "response_headers": {},
    "response_body": "é",
    "duration_ms": 12.5,
    "tags": ["t"],
}


def _write(path, *lines):
    path.mkdir(exist_ok=True)
    text = "\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines)
    (path / f"{len(list(path.iterdir()))}.jsonl").write_text(text, encoding="utf-8")
    return str(path)


def test_read_lines(spark, tmp_path, values):
    df = logs.read_log(spark, _write(tmp_path / "log", RECORD, "", "   ", {**RECORD, "id": "b"}))
    assert df.schema.simpleString() == REQUEST_SCHEMA.simpleString()
    row = df.where("id = 'a'").first()
    assert (row.timestamp, row.path, row.query_string) == (1704067207.25, "/a/b", "x=1")
    assert (row.request_headers, row.response_body, row.tags) == ({"Host": "h"}, "é", ["t"])
    assert df.count() == 2


def test_absent_path_is_an_empty_log(spark, tmp_path):
    df = logs.read_log(spark, str(tmp_path / "none"))
    assert (df.count(), df.schema) == (0, REQUEST_SCHEMA)
    assert logs.read_log(spark, str(tmp_path / "none"), format="parquet").count() == 0


def test_aliases_and_times(spark, tmp_path, values):
    base = {k: v for k, v in RECORD.items() if k not in ("id", "response_status", "duration_ms", "url", "tags")}
    lines = [
        {**base, "record_id": "1", "status_code": 500, "duration": 0.5, "path": "/p", "timestamp": "2024-05-10T14:32:01Z"},
        {**base, "request_id": "2", "status": 201, "latency_ms": 3, "url": "/q?z", "timestamp": "2024-05-10T16:32:01.5+02:00"},
        {**base, "id": "3", "response_status": None, "duration_ms": None, "path": "", "timestamp": "2024-05-10"},
        {**base, "id": "4", "response_status": 1, "duration_ms": 1, "path": "/", "timestamp": "soon"},
        {**base, "id": "5", "response_status": 1, "duration_ms": 1, "path": "/", "timestamp": "2024-05-10 14:32:01"},
    ]
    df = logs.read_log(spark, _write(tmp_path / "log", *lines)).orderBy("id")
    noon = datetime(2024, 5, 10, 14, 32, 1, tzinfo=timezone.utc).timestamp()
    day = datetime(2024, 5, 10, tzinfo=timezone.utc).timestamp()
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert values(df, "timestamp") == [noon, noon + 0.5, day, 0.0, noon]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert values(df, "response_status", "duration_ms", "path", "query_string")[:3] == [
        (500, 500.0, "/p", None), (201, 3.0, "/q", "z"), (None, None, "", None),
    ]


@pytest.mark.parametrize(
    "line, message",
    [
        ("{not json", "malformed record"),
        ("[1]", "malformed record"),
        ({**RECORD, "extra": 1}, "unknown field"),
        ({k: v for k, v in RECORD.items() if k != "method"}, "missing field.* method"),
        ({k: v for k, v in RECORD.items() if k != "url"}, "missing field.* path"),
    ],
)
def test_bad_lines_raise_or_are_set_aside(spark, tmp_path, values, line, message):
    path = _write(tmp_path / "log", RECORD, line)
    with pytest.raises(Exception, match=message):
        logs.read_log(spark, path).collect()
    lenient = logs.read_log(spark, path, mode="PERMISSIVE")
    bad = lenient.where(F.col(logs.CORRUPT).isNotNull())
    assert values(bad, logs.CORRUPT) == [line if isinstance(line, str) else json.dumps(line)]
    assert values(lenient.where(f"{logs.CORRUPT} is null"), "id") == ["a"]


def test_lenient_schema_ignores_unknown_fields(spark, tmp_path, values):
    df = logs.read_log(spark, _write(tmp_path / "log", {"id": "z", "extra": 1}), strict=False)
    assert values(df, "id", "request_headers", "tags") == [("z", {}, [])]


def test_append_and_read_back(spark, tmp_path, log, values):
    df = log({"request_headers": {"A": "1"}, "tags": ["x"]}, {"request_body": "line\nbreak", "url": "/u"})
    for format in ("json", "parquet"):
        path = str(tmp_path / format)
        logs.append_log(df, path, format)
        logs.append_log(df, path, format)
        back = logs.read_log(spark, path, format)
        assert sorted(values(back.select(F.to_json(F.struct("*"))))) == sorted(
            values(df.unionAll(df).select(F.to_json(F.struct("*"))))
        )
    with pytest.raises(ValueError):
        logs.append_log(df, "x", "csv")


def test_daily_log_prunes_days(spark, tmp_path, log, values):
    path, day = str(tmp_path / "daily"), 86400.0
    df = log(*[{"timestamp": t} for t in (0.0, day - 1, day, 2.5 * day, -1.0)])
    logs.append_log(df, path, "parquet", daily=True)
    assert (tmp_path / "daily" / "day=1970-01-02").exists()
    whole = logs.read_log(spark, path, "parquet")
    assert (whole.columns, whole.count()) == (df.columns, 5)
    part = logs.read_log(spark, path, "parquet", since=10.0, until=2 * day)
    assert sorted(values(part, "id")) == ["1", "2"]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_conform_checks_columns(spark, log):
    df = log({})
    assert conform(df).schema.simpleString() == df.schema.simpleString()
    with pytest.raises(ValueError, match="unknown"):
        conform(df.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError, match="missing"):
        conform(df.drop("method"))
    with pytest.raises(ValueError, match="more than one"):
        conform(df.withColumn("record_id", F.col("id")))
    assert conform(df.drop("method").withColumn("more", F.lit(1)), strict=False).count() == 1
    raw = df.withColumn("request_body", F.unhex(F.lit("61ff62")))
    assert conform(raw).first().request_body == "a�b"


def test_csv(spark, tmp_path, log):
    df = log(
        {"id": 'q"x', "path": "/a,b", "timestamp": 1704067207.5, "duration_ms": None, "query_string": ""},
    )
    path = tmp_path / "csv"
    exports.write_csv(df.coalesce(1), str(path))
    text = "".join(p.read_text() for p in path.glob("*.csv"))
    assert text == (
        "id,timestamp,method,path,query_string,status_code,duration_ms\n"
        '"q""x",1704067207.5,GET,"/a,b",,200,\n'
    )


def test_json_export_keeps_nulls(tmp_path, log):
    path = tmp_path / "json"
    exports.write_json(log({"id": "n"}), str(path))
    record = json.loads("".join(p.read_text() for p in path.glob("*.json")))
    assert record["id"] == "n" and record["request_body"] is None and "url" in record


def test_curl(log, values):
    df = log(
        {"method": "POST", "path": "/p", "query_string": "a=1", "request_headers": {"Host": "h:80"}, "request_body": "it's"},
        {"request_body": "", "query_string": None},
    )
    assert values(exports.curl_commands(df), "command") == [
        "curl -X POST \\\n  -H 'Host: h:80' \\\n  -d 'it'\\''s' \\\n  'http://h:80/p?a=1'",
        "curl -X GET \\\n  'http://localhost/api'",
    ]


def test_log_lines(tmp_path, log, values):
    df = log({"timestamp": 5.0, "request_headers": {"A": "1"}, "request_body": "abcdef", "response_body": "ab"})
    assert values(exports.log_lines(df), "line") == ["[5.0] GET /api -> 200  (10.0 ms)"]
    full = exports.log_lines(df, show_headers=True, show_body=True, max_body_len=3)
    assert values(full, "line") == [
        "[5.0] GET /api -> 200  (10.0 ms)\n  Request Headers:\n    A: 1\n"
        "  Request Body: abc…\n  Response Body: ab"
    ]
    exports.write_lines(full, "line", str(tmp_path / "text"))
    assert len(list((tmp_path / "text").glob("*.txt"))) >= 1


def test_archive_and_restore(spark, tmp_path, log, values):
    path = str(tmp_path / "archive")
    archived = log({"id": "a"}, {"id": "b", "path": "/1"}, {"id": "b", "path": "/2"}, {"id": "c"})
    assert archive.archive(archived, path) == 4
    assert sorted(values(archive.archived_ids(spark, path))) == ["a", "b", "b", "c"]
    new = archive.restore_new_records(archive.read_archive(spark, path), log({"id": "a"}, {"id": "a"}))
    assert sorted(values(new, "id", "path")) == [("b", "/1"), ("c", "/api")]
    assert new.columns == archived.columns


def test_snapshots(spark, log, values):
    store = snapshots.SnapshotStore(spark, "snapshots_test")
    assert store.list().count() == 0
    with pytest.raises(FileNotFoundError):
        store.load("one")
    store.save(log({"id": "a"}, {"id": "b"}), "one", datetime(2024, 1, 1, tzinfo=timezone.utc))
    store.save(log({"id": "c"}), "it's/2", datetime(2024, 1, 2, tzinfo=timezone.utc))
    store.save(log({"id": "d"}).limit(0), "empty", datetime(2024, 1, 3, tzinfo=timezone.utc))
    assert values(store.list()) == [
        ("empty", "2024-01-03T00:00:00+00:00", 0),
        ("it's/2", "2024-01-02T00:00:00+00:00", 1),
        ("one", "2024-01-01T00:00:00+00:00", 2),
    ]
    assert sorted(values(store.load("one"), "id")) == ["a", "b"]
    assert store.load("empty").count() == 0
    store.save(log({"id": "z"}), "one", datetime(2024, 1, 4, tzinfo=timezone.utc))
    assert values(store.load("one"), "id") == ["z"]
    assert store.delete("one") and not store.delete("one")
    assert values(store.list(), "name") == ["empty", "it's/2"]
    assert store.load("it's/2").columns == log({}).columns


def test_snapshot_readers_see_one_version(spark, log, values):
    store = snapshots.SnapshotStore(spark, "snapshots_versions")
    day = datetime(2024, 1, 2, tzinfo=timezone.utc)
    store.save(log({"id": "a"}), "s", day)
    reader = store.load("s")
    # A save that fails halfway is not seen.
    with pytest.raises(Exception):
        store.save(log({"id": "x"}).withColumn("path", F.raise_error(F.lit("boom"))), "s")
    assert values(store.load("s"), "id") == ["a"]
    # The same creation time and an earlier one replace too; a reader that began earlier keeps its rows.
    store.save(log({"id": "b"}, {"id": "c"}), "s", day)
    assert values(reader, "id") == ["a"] and sorted(values(store.load("s"), "id")) == ["b", "c"]
    assert values(store.list()) == [("s", "2024-01-02T00:00:00+00:00", 2)]
    store.save(log({"id": "d"}), "s", datetime(2024, 1, 1, tzinfo=timezone.utc))
    assert values(store.load("s"), "id") == ["d"]
    # Only the version that holds and the one before it are kept.
    assert sorted(values(spark.table("snapshots_versions"), "id")) == ["b", "c", "d"]
    other = snapshots.SnapshotStore(spark.newSession(), "snapshots_versions")
    other.save(log({"id": "e"}), "s")
    assert values(store.load("s"), "id") == ["e"]
    assert store.delete("s") and store.list().count() == 0 and spark.table("snapshots_versions").count() == 0
    with pytest.raises(FileNotFoundError):
        store.load("s")


def test_split_writes_safe_names_and_keeps_the_bucket(spark, tmp_path, log, values):
    path = str(tmp_path / "split")
    df = log({"path": "/a/b"}, {"path": "/"}, {"path": None}, {"path": "/_a/b/"}, {"path": "/a_b"})
    split.write_split(df, "path_prefix", path, depth=2)
    back = spark.read.parquet(path)
    assert sorted(values(back, "bucket", "bucket_name")) == [
        ("/", "root"), ("/_a/b", "a_b"), ("/a/b", "a_b"), ("/a_b", "a_b"),
    ]


def test_every_line_is_judged_to_its_end(spark, log):
    """Nothing after a record is read over, whatever closes the record early."""
    good = log({"id": "1"}).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
    bad = [f"{good}] garbage", f"{good}] [{good}", f"{good}, {good}", f"{good}{good}", f"{good} x", f"[{good}]", "{", "]", '"x"', "1"]
    bad += [f'{good}, {{"_callsift_end":"1"}}]', good.replace('"response_status":200', '"response_status":1e12')]
    bad += [good.replace('"response_status":200', '"response_status":200.5')]
    for line in bad:
        lines = spark.createDataFrame([(line,)], "value string")
        assert logs.parse_lines(lines, mode="PERMISSIVE").select("id", "_corrupt_record").collect() == [(None, line)], line
        with pytest.raises(Exception):
            logs.parse_lines(lines).collect()
    blank = ["", " ", "\t", "\x0b \r", " 　"]
    lines = spark.createDataFrame([(v,) for v in [*blank, f"\t{good}  "]], "value string")
    assert [r.id for r in logs.parse_lines(lines).collect()] == ["1"]


def test_restore_appends_what_is_missing(spark, tmp_path, log):
    archived, path = str(tmp_path / "archive"), str(tmp_path / "log")
    archive.archive(log({"id": "a"}, {"id": "b", "path": "/1"}, {"id": "b", "path": "/2"}), archived)
    assert archive.restore(spark, archived, path) == 2
    assert archive.restore(spark, archived, path) == 0
    found = logs.read_log(spark, path, "parquet", strict=False).select("id", "path").collect()
    assert sorted(tuple(r) for r in found) == [("a", "/api"), ("b", "/1")]


def test_a_line_is_parsed_and_judged_once(spark):
    """However many columns are made of it; FAILFAST names the judgement in the test and in its error."""
    lines = spark.createDataFrame([("",)], "value string")
    for mode, judged in (("FAILFAST", 2), ("PERMISSIVE", 1)):
        plan = logs.parse_lines(lines, mode=mode)._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("from_json("), plan.count("malformed record")) == (2, judged)


def test_sound_lines_have_no_problem(spark):
    """The quick judgement passes no line that the one field by field would not."""
    names = [n for n in REQUEST_SCHEMA.fieldNames() if n != "seq"]
    good = {n: None for n in names} | {"id": "1", "response_status": 200, "request_headers": {}, "tags": ["a", 1]}
    odd = [good, {**good, "seq": 5}, {**good, "more": 1}, {**good, "id": None}, {**good, "tags": "x"}, {**good, "tags": ""}]
    odd += [{**good, "duration_ms": v} for v in ("NaN", "x", "", [1], {"a": 1}, True)]
    odd += [{**good, "response_status": v} for v in (200.0, 200.5, 1e12, "200", [])]
    odd += [{k: v for k, v in good.items() if k != name} for name in names]
    texts = [json.dumps(o) for o in odd]
    texts += [texts[0][:-1] + tail for tail in (', "id": null}', ', "id": "2"}', ', "duration_ms": "x"}', ', "method": {}}', ",}", "}}")]
    for strict in (True, False):
        lines = spark.createDataFrame([(t,) for t in texts], "value string")
        quick = logs.parse_lines(lines, strict, "PERMISSIVE").select("id", "duration_ms", logs.CORRUPT).collect()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(logs, "_sound", lambda: F.lit(False))
            full = logs.parse_lines(lines, strict, "PERMISSIVE").select("id", "duration_ms", logs.CORRUPT).collect()
        assert [str(r) for r in quick] == [str(r) for r in full]
