from __future__ import annotations

import pytest

from callsift.operators import rules, transforms
from callsift.sources.log import append_log
from callsift.streaming import watch


def _run(df, tmp_path, name):
    query = (
        df.writeStream.format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_new_records_once_and_never_the_baseline(spark, tmp_path, log, values):
    path = str(tmp_path / "log")
    old = log({"id": "a"}, {"id": "b"})
    for part in (old, log({"id": "c"}, {"id": "c"}), log({"id": "c"}, {"id": "d"})):
        append_log(part, path)
    stream = watch.stream_log(spark, path, max_files_per_trigger=1)
    assert sorted(values(_run(watch.new_records(stream, old), tmp_path, "fresh"), "id")) == ["c", "d"]


def test_watermark_bounds_the_state(spark, tmp_path, log, values):
    path, now = str(tmp_path / "log"), 1_704_067_200.0
    old = log({"id": "a", "timestamp": now})
    for part in (old, log(*[{"id": "c", "timestamp": now + i} for i in range(3)]), log({"id": "d", "timestamp": now})):
        append_log(part, path)
    stream = watch.stream_log(spark, path, max_files_per_trigger=1)
    bounded = watch.new_records(stream, old, watermark="1 hour")
    assert sorted(values(_run(bounded, tmp_path, "bounded"), "id")) == ["c", "d"]


def test_watch_skips_what_was_there_and_survives_restarts(spark, tmp_path, log, values):
    path, checkpoint, seen = str(tmp_path / "log"), str(tmp_path / "state"), []

    def collect(batch, _):
        seen.extend(values(batch, "id"))

    def watch_once():
        stream = watch.stream_log(spark, path)
        watch.watch(stream, collect, checkpoint, availableNow=True).awaitTermination()

    append_log(log({"id": "a"}), path)
    watch_once()
    assert seen == []
    append_log(log({"id": "a"}, {"id": "b"}), path)
    watch_once()
    append_log(log({"id": "b"}, {"id": "c"}), path)
    watch_once()
    assert seen == ["b", "c"]


def test_batches_reach_the_consumer(spark, tmp_path, log, values):
    path, got = str(tmp_path / "log"), []
    append_log(log({"response_status": 500}, {}), path)
    stream = watch.stream_log(spark, path)
    query = watch.consume_batches(
        stream, lambda batch, i: got.extend(values(batch, "id")), str(tmp_path / "c"), "response_status = 200"
    )
    query.awaitTermination()
    assert got == ["1"]


def test_row_operators_give_the_same_on_a_stream(spark, tmp_path, log, values):
    df = log({"path": "//a/", "duration_ms": 2000.0}, {"response_status": 503, "request_body": " x "})
    path = str(tmp_path / "log")
    append_log(df, path)

    def chain(frame):
        return rules.tag(transforms.truncate(transforms.normalize(frame), 8)).select(
            "id", "path", "request_body", "changed", "truncated", "matched_tags"
        )

    streamed = _run(chain(watch.stream_log(spark, path)), tmp_path, "parity")
    assert sorted(values(streamed)) == sorted(values(chain(df)))


def test_batches_are_counted_and_limited(spark, tmp_path, log, values):
    path, got, counts = str(tmp_path / "log"), [], watch.BatchCounts()
    append_log(log({"response_status": 500}, {}, {}, {"response_status": 404}, {}), path)

    def consume(batch, i):
        got.extend(values(batch.orderBy("seq"), "id"))
        raise RuntimeError("full disk")

    watch.consume_batches(
        watch.stream_log(spark, path), consume, str(tmp_path / "c"), "response_status = 200",
        max_records=2, counts=counts, keep_going=True,
    ).awaitTermination()
    assert got == ["1", "2"]
    assert (counts.batches, counts.records, counts.filtered_out, counts.errors) == (1, 2, 2, ["full disk"])


def test_limit_holds_over_restarts_and_retries(spark, tmp_path, log, values):
    """A batch that fails is tried again and counts once; a new run goes on from the totals."""
    path, checkpoint, got, fail = str(tmp_path / "log"), str(tmp_path / "c"), [], [True]

    def consume(batch, i):
        if fail[0]:
            raise RuntimeError("full disk")
        got.extend(values(batch.orderBy("seq"), "id"))

    def run():
        counts = watch.BatchCounts()
        query = watch.consume_batches(
            watch.stream_log(spark, path), consume, checkpoint, "response_status = 200", max_records=4, counts=counts
        )
        return counts, query

    append_log(log({"id": "a"}, {"id": "b", "response_status": 500}, {"id": "c"}), path)
    counts, query = run()
    with pytest.raises(Exception, match="full disk"):
        query.awaitTermination()
    assert (counts.batches, counts.records, got) == (0, 0, [])
    fail[0] = False
    counts, query = run()
    query.awaitTermination()
    assert (counts.batches, counts.records, counts.filtered_out, got) == (1, 2, 1, ["a", "c"])
    append_log(log({"id": "d"}, {"id": "e"}, {"id": "f"}), path)
    counts, query = run()
    query.awaitTermination()
    assert (counts.batches, counts.records, got) == (2, 4, ["a", "c", "d", "e"])
    append_log(log({"id": "g"}), path)
    run()[1].awaitTermination()
    assert got == ["a", "c", "d", "e"]


def test_watch_outlives_its_consumer(spark, tmp_path, log, values):
    path, checkpoint, errors, got = str(tmp_path / "log"), str(tmp_path / "c"), [], []

    def consume(batch, i):
        if not errors:
            raise RuntimeError("down")
        got.extend(values(batch, "id"))

    for name in ("a", "b", "c"):
        append_log(log({"id": name}), path)
        stream = watch.stream_log(spark, path)
        watch.watch(stream, consume, checkpoint, errors=errors, availableNow=True).awaitTermination()
    assert errors == ["down"] and got == ["c"]
