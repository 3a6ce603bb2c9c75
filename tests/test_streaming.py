import os

from pyspark.sql import functions as F

from tarn.queries import QUERIES
from tarn.streaming import ingest


def _events(spark, folder):
    return ingest.event_stream(spark, f"{folder}/events.parquet*", spark.read.parquet(f"{folder}/events.parquet").schema)


def test_complete_mode_is_the_batch_result(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = ingest.to_table(ingest.tumbling(_events(spark, sf)), "t-tumbling")
    want = ingest.tumbling(batch)
    pick = lambda df: sorted((r.window_start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert pick(got) == pick(want)


def test_bad_rows_are_rejected_and_replay_is_idempotent(spark, sf, tmp_path):
    target, n = f"file://{tmp_path}/out", spark.read.parquet(f"{sf}/events.parquet").count()
    for _ in range(2):  # the second run finds all files done
        ingest.load_stream(_events(spark, sf), target, f"file://{tmp_path}/check", F.col("event_id") % 10 != 0).awaitTermination()
    loaded, rejected = spark.read.parquet(f"{target}/loaded").count(), spark.read.json(f"{target}/rejected").count()
    assert loaded + rejected == n and rejected > 0


def test_duplicates_pass_once(spark, sf):
    twice = _events(spark, sf).withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_c")
    kept = ingest.to_table(ingest.distinct_events(twice).select("event_id"), "t-dedupe", "append")
    assert kept.count() == kept.distinct().count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_replay_of_files_in_reverse_order_of_time(spark, tmp_path):
    folder, shape = tmp_path / "events.parquet", "event_id long, ts string, user_id long, event_type string, value double, props string"
    for n, month in enumerate(("09", "06", "03", "01")):  # files are read from the newest events to the oldest; lateness counts from the third on
        rows = [(100 * n + i, f"2024-{month}-{i + 1:02d} 00:00:00", i, "ab"[i % 2], 1.0, "{}") for i in range(20)]
        spark.createDataFrame(rows, shape).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        for f in folder.glob("part-*"):
            if f.stat().st_mtime > 1e9 + 1000:
                os.utime(f, (1e9 + n, 1e9 + n))
    assert {r.event_type: r.n for r in QUERIES["stream_dedupe"](spark, str(tmp_path)).collect()} == {"a": 40, "b": 40}
    stream = lambda: ingest.event_stream(spark, f"file://{folder}", spark.read.parquet(f"file://{folder}").schema)
    whole = ingest.to_table(ingest.distinct_events(stream(), late=None).select("event_id"), "t-whole", "append")
    late = ingest.to_table(ingest.distinct_events(stream(), late="2 days").select("event_id"), "t-late", "append")
    assert whole.count() == 80 > late.count() >= 40  # with a watermark what is older than it goes


def test_windows_take_late_rows_until_the_watermark(spark, tmp_path):
    folder, shape = tmp_path / "e", "event_id long, ts string, user_id long, event_type string, value double"
    days = ["01 01", "01 20", "05 00", "01 05", "09 00", "01 06", "30 00"]  # 01 05 comes after 05 00: late, but inside a week
    for n, d in enumerate(days):
        row = [(n, f"2024-01-{d[:2]} {d[3:]}:00:00", 1, "a", 1.0)]
        spark.createDataFrame(row, shape).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        for f in folder.glob("part-*"):
            if f.stat().st_mtime > 1e9 + 1000:
                os.utime(f, (1e9 + n, 1e9 + n))

    def first_day(late):
        stream = ingest.event_stream(spark, f"file://{folder}", spark.read.parquet(f"file://{folder}").schema)
        rows = ingest.to_table(ingest.tumbling(stream, late=late), "t-late", "append").collect()
        return {r.window_start.day: r.n for r in rows}[1]

    # A watermark takes effect one batch later: the event of 5 o'clock is the last that gets in.
    assert first_day("20 days") == 4 and first_day("2 days") == 3


def test_sessions_grow_over_batches(spark, tmp_path):
    folder = tmp_path / "e"
    for n, hours in enumerate(([0, 9], [5], [30])):
        rows = [(10 * n + i, f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00", 1, "a", 1.0) for i, h in enumerate(hours)]
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(f"file://{folder}")
        for f in folder.glob("part-*"):
            if f.stat().st_mtime > 1e9 + 1000:
                os.utime(f, (1e9 + n, 1e9 + n))
    stream = ingest.event_stream(spark, f"file://{folder}", spark.read.parquet(f"file://{folder}").schema)
    found = sorted((r.session_start.hour, r.n) for r in ingest.to_table(ingest.sessions(stream, late="30 days"), "t-sessions").collect())
    assert found == [(0, 3), (6, 1)]  # the event at 5 o'clock joins two sessions of the first batch


def test_rejects_say_whether_to_try_again(spark, sf, tmp_path):
    target = f"file://{tmp_path}/out"
    ingest.load_stream(_events(spark, sf), target, f"file://{tmp_path}/check", F.col("event_id") % 10 != 0, retryable=F.col("event_id") % 20 == 0).awaitTermination()
    rows = spark.read.json(f"{target}/rejected")
    assert rows.filter("retryable <> (event_id % 20 = 0)").count() == 0 and rows.filter("retryable").count() > 0


def test_freshness(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-03 00:00:00")], "event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = {r.event_type: r.stale for r in ingest.freshness(df, F.lit("2024-01-03 01:00:00").cast("timestamp")).collect()}
    assert rows == {"a": True, "b": False}


def test_files_of_a_replay_are_bounded_by_rows(spark):
    folder, files = ingest.split_table(spark.range(4000), "id", 4, "t-split", rows=100)
    per = [r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()]
    assert files == 10 and sum(per) == 4000 and max(per) <= 200
