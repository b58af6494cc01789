from __future__ import annotations

import datetime as dt


from marquetry.streaming import feed


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, i % 24), "view" if i % 2 else "click") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, event_type string")
    df.repartition(5).write.parquet(src)
    batch = {tuple(r) for r in feed.daily_counts(df, "ts", "event_type").collect()}
    stream = feed.daily_counts(feed.event_stream(spark, src, df.schema, files_per_trigger=2), "ts", "event_type")
    assert {tuple(r) for r in feed.run_available(stream, "daily").collect()} == batch
    late = feed.daily_counts(feed.event_stream(spark, src, df.schema), "ts", "event_type", late="2 days")
    assert {tuple(r) for r in feed.run_available(late, "daily_late", "update").collect()} == batch


def test_counters_follow_the_clock(spark, tmp_path):
    src, now = str(tmp_path / "e"), dt.datetime(2024, 1, 10)
    df = spark.createDataFrame([(1, now - dt.timedelta(hours=1)), (2, now - dt.timedelta(days=3)), (3, None)], "id int, ts timestamp_ntz")
    df.write.parquet(src)
    seen: list = []
    q = feed.publish_counters(feed.event_stream(spark, src, df.schema), "ts", str(tmp_path / "c"), lambda d, n: seen.append(d.collect()[0].asDict()), lambda: spark.read.parquet(src), lambda: now, availableNow=True)
    q.awaitTermination()
    assert seen[-1] == {"total": 3, "this_week": 2, "today": 1}
