"""Structured Streaming: windows over event time, deduplication, freshness, and idempotent loading of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.scratch import fresh_path


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive; the time column is an instant, as watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, event_type, n, total) per tumbling window. On a batch the watermark has no effect."""
    return sliding(events, width, width, late)


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", width, step).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(user_id, session_start, session_end, n): runs of a user's events with no gap that long."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def idempotency_key(*parts: str):
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def distinct_events(events: DataFrame, keys: tuple[str, ...] = ("event_type", "user_id", "event_id"), late: str | None = "2 days") -> DataFrame:
    """Events of which each idempotency key passes once, with state that the watermark bounds; events later than it are dropped.

    With ``late`` None no event is dropped for its time: a replay over files in any order, whose state holds every key.
    """
    keyed = events.withColumn("idempotency_key", idempotency_key(*keys))
    if events.isStreaming and late is not None:
        return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["idempotency_key"])
    return keyed.dropDuplicates(["idempotency_key"])


def freshness(events: DataFrame, now) -> DataFrame:
    """(event_type, newest, lag_seconds, stale): how far the newest event lies behind ``now``; stale from one day on."""
    rows = events.groupBy("event_type").agg(F.max("ts").alias("newest"))
    lag = F.unix_timestamp(now) - F.unix_timestamp("newest")
    return rows.select("event_type", "newest", lag.alias("lag_seconds"), (lag > 86_400).alias("stale"))


def load_stream(stream: DataFrame, target: str, checkpoint: str, valid, transform: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = True, retryable=None):
    """Write each batch under its own number, so that a replayed batch replaces itself; rows that aren't ``valid`` go to a reject table.

    ``retryable`` is a condition: rejects that meet it (a source that was away) are marked so, the others are final.
    """

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            ok = F.coalesce(valid, F.lit(False))
            transform(df.filter(ok)).write.mode("overwrite").parquet(f"{target}/loaded/batch={batch}")
            again = F.lit(False) if retryable is None else F.coalesce(retryable, F.lit(False))
            df.filter(~ok).withColumn("retryable", again).write.mode("overwrite").json(f"{target}/rejected/batch={batch}")
        finally:
            df.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_table(df: DataFrame, tag: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return its result, a Parquet table in the shared folder.

    Appended rows go through the file sink; a complete result replaces that of the batch before.
    """
    spark = df.sparkSession
    folder, checkpoint = fresh_path(spark, tag), fresh_path(spark, f"{tag}-state")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", folder).start()
    else:
        query = writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(folder)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(folder)


def split_table(df: DataFrame, column: str, parts: int, tag: str, rows: int = 500_000) -> tuple[str, int]:
    """(folder, files): a folder in which the rows of ``df`` lie, dealt by a hash of a column, as a replay of ``parts`` batches finds them,
    and the files a batch. Files have about ``rows`` rows, so that no task reads or writes more, however large the table."""
    folder = fresh_path(df.sparkSession, tag)
    files = max(1, -(-df.count() // (parts * rows)))
    df.repartition(parts * files, column).write.parquet(folder)
    return folder, files
