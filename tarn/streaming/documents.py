"""A stream of document versions whose table is the same in whatever order its files come, and rejected rows that are tried again."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarn.sources import commits

HELD = "version long, deleted boolean, digest string"
#: State with a time to live is kept on disk; and a run over what is there now must end, though such a state could always be cleaned again.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextlib.contextmanager
def stateful(spark: SparkSession):
    """Streams that start inside have SETTINGS; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Newest(StatefulProcessor):
    """Passes a document's row on if it is newer than all that came before: by version, deletions before others, then by content.

    The state of a document is what it was passed last; it goes when nothing newer has come for the time to live.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", HELD, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, row = (tuple(self.held.get()) if self.held.exists() else None), None
        for pdf in rows:
            top = pdf.sort_values(["version", "deleted", "digest"]).iloc[-1:]
            rank = int(top["version"].iloc[0]), bool(top["deleted"].iloc[0]), str(top["digest"].iloc[0])
            if best is None or rank > best:
                best, row = rank, top
        if row is not None:
            self.held.update(best)
            yield row

    def close(self) -> None:
        pass


def newest_versions(events: DataFrame, key: str = "doc_id", ttl_seconds: int = 7 * 86_400) -> DataFrame:
    """Of a stream (key, version long, deleted boolean, payload columns) the rows that are newer than what the stream passed on for their
    document so far, with a digest of their content.

    State is kept a document, in a state store on disk, for ``ttl_seconds`` after its last change, so its size is that of the documents
    that changed lately. Rows with a null key or version are no versions and are left out. Copies pass once. Start the query inside `stateful`.
    """
    body = [c for c in events.columns if c not in (key, "version", "deleted")]
    rows = events.filter(F.col(key).isNotNull() & F.col("version").isNotNull())
    rows = rows.withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("digest", F.sha2(F.to_json(F.struct(*body)) if body else F.lit(""), 256))
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Newest(ttl_seconds * 1000), outputStructType=rows.schema, outputMode="Append", timeMode="ProcessingTime")


def load_versions(events: DataFrame, root: str, checkpoint: str, table: str = "documents", key: str = "doc_id", ttl_seconds: int = 7 * 86_400, buckets: int = 64, once: bool = True):
    """Keep a table at ``root`` (a log of commits) at the newest version of each document of a stream.

    Each batch is one commit, in which a row only replaces an older one; so a batch that is replayed changes nothing, files may come in any
    order, and a row that outlives its document's state is still compared with the table. Deleted documents stay as marks, which
    `living` leaves out: an older version that comes later finds them.
    """

    def write(rows: DataFrame, batch: int) -> None:
        if rows.isEmpty():
            return
        ranked = rows.withColumn("rank", F.struct("version", "deleted", "digest"))
        commits.upsert(ranked, root, table, key, best="rank", buckets=buckets)

    writer = newest_versions(events, key, ttl_seconds).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    with stateful(events.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def living(spark: SparkSession, root: str, table: str = "documents") -> DataFrame:
    """The documents of `load_versions` that are not deleted."""
    return commits.read(spark, root, table).filter("NOT deleted").drop("rank", "digest", "deleted")


def _outcome(ok: Column, retryable: Column, attempts: Column, most: int) -> Column:
    return F.when(ok, "loaded").when(~retryable, "final").when(attempts >= most, "exhausted").otherwise("waiting")


def put_letters(rejects: DataFrame, root: str, key: str, now: str, first_wait_seconds: int = 60) -> commits.Snapshot:
    """Put rejected rows (key, payload columns, retryable boolean, error string) into the table of dead letters ``letters``.

    A row that may come back waits for its first retry; others are final at once. A letter that is there already keeps its attempts, so a
    replayed batch adds none.
    """
    spark = rejects.sparkSession
    at = F.lit(now).cast("timestamp")
    body = [c for c in rejects.columns if c not in ("retryable", "error")]
    new = rejects.select(
        F.col(key).cast("string").alias("letter_id"), F.to_json(F.struct(*body)).alias("payload"), F.lit(0).alias("attempts"), (at + F.make_interval(secs=F.lit(first_wait_seconds))).alias("next_try"),
        F.when(F.coalesce("retryable", F.lit(False)), "waiting").otherwise("final").alias("outcome"), F.col("error").cast("string").alias("error"),
    ).dropDuplicates(["letter_id"])
    known = commits.snapshot(spark, root).tables.get("letters")
    if known:
        new = new.join(commits.read(spark, root, "letters").select("letter_id"), "letter_id", "left_anti")
    return commits.upsert(new, root, "letters", "letter_id")


def retry_letters(
    spark: SparkSession, root: str, load: Callable[[DataFrame], DataFrame], schema: str, now: str, most: int = 5, first_wait_seconds: int = 60, longest_wait_seconds: int = 86_400
) -> dict[str, int]:
    """Try the letters again whose time has come, as a second source of the load: outcome -> number, of these.

    ``load`` gets their rows, as they were rejected, with letter_id, and returns (letter_id, ok boolean, retryable boolean, error string), a row
    each. It must load by letter_id, as an upsert does, so that a retry that is repeated after a crash loads once. Rows that fail again wait
    twice as long each time, up to the longest wait; after ``most`` attempts, or once they can't come back, they are final.
    """
    at = F.lit(now).cast("timestamp")
    letters = commits.read(spark, root, "letters")
    due = letters.filter((F.col("outcome") == "waiting") & (F.col("next_try") <= at))
    rows = due.select("letter_id", F.from_json("payload", schema).alias("p")).select("letter_id", "p.*")
    told = load(rows).select("letter_id", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("retryable", F.lit(False)).alias("again"), F.col("error").alias("new_error"))
    tried = F.col("attempts") + 1
    wait = F.least(F.lit(float(longest_wait_seconds)), first_wait_seconds * F.pow(F.lit(2.0), tried))
    # A letter that the load says nothing of has failed in a way that may pass.
    done = due.join(told, "letter_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("again", F.coalesce("again", F.lit(True)))
    done = done.select("letter_id", "payload", tried.alias("attempts"), (at + F.make_interval(secs=wait)).alias("next_try"), _outcome(F.col("ok"), F.col("again"), tried, most).alias("outcome"), F.when(F.col("ok"), F.lit(None)).otherwise(F.coalesce("new_error", "error")).alias("error"))
    from tarn.scratch import materialize

    done = materialize(done, "retried")
    commits.upsert(done, root, "letters", "letter_id")
    return {r["outcome"]: r["count"] for r in done.groupBy("outcome").count().collect()}
