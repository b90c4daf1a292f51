from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from callsift.operators import paging, timeseries
from callsift.plans import ordering, skew


def test_timeline(log, values):
    df = log({"timestamp": 5.0}, {"timestamp": 1.0}, {"timestamp": 1.5}, {"timestamp": 5.0})
    gaps = timeseries.timeline_gaps(df).orderBy("timestamp", "seq")
    assert values(gaps, "id", "gap_before_ms") == [("1", None), ("2", 500.0), ("0", 3500.0), ("3", 0.0)]
    assert values(timeseries.timeline_span(df)) == [(4, 4000.0)]
    assert values(timeseries.timeline_span(df.limit(1))) == [(1, 0.0)]
    assert values(timeseries.timeline_span(df.limit(0))) == [(0, 0.0)]


def test_throttle_budget_resets_per_window(log, values):
    df = log(*[{"timestamp": t} for t in (0.1, 0.2, 0.9, 1.1, 1.2, 1.3, -0.5)])
    flags = timeseries.throttle(df, 2).orderBy("seq")
    # Truncation puts the negative time into window 0, where it comes first.
    assert values(flags, "kept") == [True, False, False, True, True, False, True]
    assert sorted(values(timeseries.throttle_kept(df, 2), "id")) == ["0", "3", "4", "6"]
    assert values(timeseries.throttle_counts(df, 2)) == [(4, 3)]
    assert timeseries.throttle_kept(df, 0.001).count() == 2
    assert timeseries.throttle_kept(df, 10, window_ms=100).count() == 7
    assert timeseries.throttle_kept(df, 10, window_ms=500).count() == 7
    assert values(timeseries.throttle_counts(df.limit(0), 2)) == [(0, 0)]


def test_large_budgets_take_the_positional_path(spark, log, values):
    df = spark.range(5000).select((F.col("id") / 4000).alias("timestamp"), F.col("id").alias("seq"))
    kept = timeseries.throttle_kept(df, 1500)
    assert kept.count() == 1500 + 1000
    assert kept.agg(F.sum("seq")).first()[0] == sum(range(1500)) + sum(range(4000, 5000))


@pytest.mark.parametrize("budget", [1, 3, 40, 2000])
def test_throttle_equals_the_window_rank(spark, monkeypatch, budget):
    """Crowded, sparse and negative windows, nulls, and copies of one request on both sides of the limit."""
    monkeypatch.setattr(timeseries, "GROUP_LIMIT", 1000)
    at = F.when(F.col("n") % 3 == 0, 5.25).when(F.col("n") % 50 == 1, None).otherwise(F.col("n") % 97 / 3 - 4)
    df = spark.range(0, 9000, 1, 6).withColumnRenamed("id", "n").select(
        at.cast("double").alias("timestamp"), F.lit(None).cast("long").alias("seq"),
        F.when(F.col("n") % 3 == 0, "copy").otherwise((F.col("n") % 700).cast("string")).alias("id"),
        F.lit("body").alias("response_body"),
    )
    window = Window.partitionBy("w").orderBy("timestamp", "seq", "id")
    ranked = df.withColumn("w", (F.col("timestamp") * 1000.0 / 1000.0).cast("bigint")).withColumn(
        "kept", F.row_number().over(window) <= budget
    )
    keys = ["timestamp", "id", "kept"]
    want = {tuple(r[:3]): r[3] for r in ranked.groupBy(keys).count().collect()}
    assert {tuple(r[:3]): r[3] for r in timeseries.throttle(df, budget).groupBy(keys).count().collect()} == want


def test_throttle_ranks_narrow_rows(log):
    """No sampled sort, and the ranked windows carry no body."""
    plan = timeseries.throttle(log({}, {}), 2)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "WindowGroupLimit" in plan
    for line in plan.splitlines():
        if "WindowGroupLimit" in line:
            assert "body" not in line


@pytest.mark.parametrize("rps, window", [(0, 1000), (1, 0), (-1, 5)])
def test_throttle_config_is_checked(log, rps, window):
    with pytest.raises(ValueError, match="positive"):
        timeseries.throttle(log({}), rps, window)


def test_rate_limits(log, values):
    df = log(*[{"timestamp": float(t), "method": m} for t in range(5) for m in ("get", "GET")], {"path": "/x", "timestamp": 2.0})
    rates = timeseries.rate_limits(df, 2.0).orderBy("path")
    assert values(rates, "method", "path", "requests", "rps", "exceeds_limit") == [
        ("GET", "/api", 10, 2.5, True), ("GET", "/x", 1, 0.25, False),
    ]
    assert values(timeseries.rate_limit_violations(df, 2.5), "path") == []
    assert values(timeseries.rate_limits(df.where("path = '/x'")), "rps") == [1.0]
    assert values(timeseries.rate_limit_summary(df, 2.0)) == [(4.0, 2.0, 2, 1)]
    assert values(timeseries.rate_limit_summary(df.limit(0), 2.0)) == [(0.0, 2.0, 0, 0)]


def test_batches(log, values):
    df = log(*[{"response_status": s} for s in (200, 500, 200, 200, 500, 200, 200, 500)])
    ok = "response_status = 200"
    assert values(timeseries.batch_records(df, 2, predicate=ok).orderBy("seq"), "id", "batch_id") == [
        ("0", 0), ("2", 0), ("3", 1), ("5", 1), ("6", 2),
    ]
    assert timeseries.batch_records(df, 2, max_records=3).count() == 3
    assert values(timeseries.batch_stats(df, 2, predicate=ok)) == [(3, 5, 3)]
    # Reading stops at row 5, the first surplus match: rows 1 and 4 were filtered out.
    assert values(timeseries.batch_stats(df, 2, 3, ok)) == [(2, 3, 2)]
    assert values(timeseries.batch_stats(df, 2, 0, ok)) == [(0, 0, 0)]
    assert values(timeseries.batch_stats(df, 2, 50, ok)) == [(3, 5, 3)]
    assert values(timeseries.batch_stats(df.limit(0), 2)) == [(0, 0, 0)]
    for bad in (dict(batch_size=0), dict(max_records=-1)):
        with pytest.raises(ValueError):
            timeseries.batch_records(df, **bad)


def test_small_limits_of_batches_need_no_index_of_all_rows(log):
    df = log(*[{"response_status": 200 + i % 2} for i in range(9)])
    stats = timeseries.batch_stats(df, 2, 3, "response_status = 200")
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "AttachDistributedSequence" not in plan
    # The fourth match is the row at 6; three others come before it.
    assert [tuple(r) for r in stats.collect()] == [(2, 3, 3)]


def test_sorting_is_stable_in_both_directions(log, values):
    df = log({"duration_ms": 5.0}, {"duration_ms": None}, {"duration_ms": 5.0}, {"duration_ms": 9.0, "method": "a"})
    assert values(paging.sort_requests(df, "duration_ms"), "id") == ["1", "0", "2", "3"]
    assert values(paging.sort_requests(df, "duration_ms", "desc"), "id") == ["3", "0", "2", "1"]
    assert values(paging.sort_requests(df, "method"), "id") == ["3", "0", "1", "2"]
    assert values(paging.ranked(df, "duration_ms", "desc").orderBy("position"), "id") == ["3", "0", "2", "1"]
    for bad in (("size", "asc"), ("path", "up")):
        with pytest.raises(ValueError):
            paging.sort_requests(df, *bad)


def test_pages(log, values, monkeypatch):
    df = log(*[{} for _ in range(7)])
    for limit in (ordering.TOP_K_ROWS, 0):
        monkeypatch.setattr(paging, "TOP_K_ROWS", limit)
        assert values(paging.paginate(df, 2, 3), "id") == ["3", "4", "5"]
        assert values(paging.paginate(df, 3, 3), "id") == ["6"]
        assert paging.paginate(df, 4, 3).count() == 0
        # Copies of one record stand on several pages.
        copies = log(*[{"seq": s, "id": str(s)} for s in (0, 1, 1, 1, 1, 1, 2)])
        assert [values(paging.paginate(copies, p, 2), "id") for p in (1, 2, 3, 4)] == [["0", "1"], ["1", "1"], ["1", "1"], ["2"]]
    assert values(paging.page_meta(df, 3, 3)) == [(3, 3, 7, 3, False, True)]
    assert values(paging.page_meta(df.limit(0), 1, 3)) == [(1, 3, 0, 1, False, False)]
    for bad in ((0, 3), (1, 0)):
        with pytest.raises(ValueError):
            paging.paginate(df, *bad)


def test_trim(log, values, monkeypatch):
    df = log(*[{"timestamp": t} for t in (3.0, 1.0, 2.0, 3.0, 1.0)])
    for limit in (ordering.TOP_K_ROWS, 0):
        monkeypatch.setattr(ordering, "TOP_K_ROWS", limit)
        assert values(paging.trim(df, 2), "id") == ["0", "3"]
        assert values(paging.trim(df, 1), "id") == ["0"]
        assert values(paging.trim(df, 3, newest=False), "id") == ["1", "4", "2"]
        assert paging.trim(df, 0).count() == 0
        assert paging.trim(df, 99).count() == 5
    assert values(paging.trim_counts(df, 2)) == [(5, 2, 3)]
    with pytest.raises(ValueError):
        paging.trim(df, -1)


def _hot_frame(spark):
    """20,000 rows over 8 partitions, a third of them in one group."""
    key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500)
    return spark.range(0, 20_000, 1, 8).select(
        key.alias("key"), F.xxhash64("id").alias("at"), F.col("id").alias("row")
    )


def test_group_position_equals_the_window_rank(spark):
    df = _hot_frame(spark)
    got = ordering.with_group_position(df, ["key"], ["at"])
    rank = F.row_number().over(Window.partitionBy("key").orderBy("at")) - 1
    want = df.withColumn("want", rank)
    both = got.join(want, ["key", "at", "row"])
    assert both.count() == 20_000
    assert both.where("position <> want").count() == 0


def test_group_position_of_null_keys(spark, values):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "key string, at int")
    got = ordering.with_group_position(df, ["key"], ["at"])
    assert sorted(values(got, "key", "at", "position"), key=str) == [("a", 5, 0), (None, 1, 0), (None, 2, 1)]


def test_row_index_and_previous_cross_block_edges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK_ROWS", 64)
    df = _hot_frame(spark)
    index = F.row_number().over(Window.orderBy("at")) - 1
    before = F.lag("at").over(Window.orderBy("at"))
    want = df.select("row", index.alias("want"), before.alias("want_before"))
    got = ordering.with_row_index(df, ["at"]).join(want, "row")
    assert got.where("row_index <> want").count() == 0
    previous = ordering.with_previous(df, "at", ["at"], "before").join(want, "row")
    assert previous.count() == 20_000
    assert previous.where("not before <=> want_before").count() == 0


def test_hot_keys_are_split_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(skew, "PIECE_ROWS", 200)
    many = _hot_frame(spark)
    one = many.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("top"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.join_many_to_one(many, one, ["key"], rows="n")
        assert joined.count() == 20_000
        assert joined.where("key = -1").agg(F.min("n"), F.max("n")).first() == (6667, 6667)
        sizes = joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("rows"))
        largest, mean = sizes.agg(F.max("rows"), F.avg("rows")).first()
        assert largest < 2 * mean
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_but_one_drops_one_row_per_key(spark):
    df = _hot_frame(spark).select("key", "at")
    copies = df.unionAll(df.where("key = -1")).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    left = ordering.all_but_one(copies, ["key"])
    assert left.columns == copies.columns
    keys = copies.select("key").distinct().count()
    assert left.count() == copies.count() - keys
    sizes = copies.groupBy("key").count().join(left.groupBy("key").agg(F.count("*").alias("n")), "key")
    assert sizes.where("count - n <> 1").count() == 0


def test_ranked_windows_are_limited_before_the_shuffle(spark, log):
    plan = timeseries.throttle_kept(log({}, {}), 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
