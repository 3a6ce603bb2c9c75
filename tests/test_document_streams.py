"""Streams of versions, and dead letters."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tarn.sources import commits
from tarn.streaming import documents

EVENTS = "doc_id long, version long, deleted boolean, text string"


def _files(spark, folder, batches):
    """A file a batch, read in this order."""
    for n, (rows, shape) in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        for f in folder.glob("part-*"):
            if f.stat().st_mtime > 1e9 + 1000:
                os.utime(f, (1e9 + n, 1e9 + n))


def _stream(spark, folder, shape):
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_any_order_of_files_makes_the_same_table(spark, tmp_path, few_partitions):
    rows = [(1, 1, False, "a"), (1, 2, False, "b"), (1, 3, True, None), (2, 1, False, "x"), (2, 5, False, "z"), (2, 4, True, None), (3, 1, False, "p"), (3, 1, False, "q"), (3, 1, False, "p"), (4, 2, True, None), (4, 2, False, "w"), (None, 1, False, "no"), (5, None, False, "no"), (6, 1, None, "six")]
    tables = []
    for seed in (1, 2):
        r = random.Random(seed)
        order = rows[:]
        r.shuffle(order)
        folder = tmp_path / f"in{seed}"
        _files(spark, folder, [(order[i : i + 4], EVENTS) for i in range(0, len(order), 4)])
        root = f"file://{tmp_path}/out{seed}"
        documents.load_versions(_stream(spark, folder, EVENTS), root, f"file://{tmp_path}/check{seed}", buckets=2).awaitTermination()
        tables.append(sorted(map(tuple, documents.living(spark, root).select("doc_id", "version", "text").collect())))
        number = commits.snapshot(spark, root).number
        documents.load_versions(_stream(spark, folder, EVENTS), root, f"file://{tmp_path}/check{seed}", buckets=2).awaitTermination()
        assert commits.snapshot(spark, root).number == number  # nothing new
    assert tables[0] == tables[1]
    assert [(i, v) for i, v, _ in tables[0]] == [(2, 5), (3, 1), (6, 1)] and tables[0][0][2] == "z"


def test_state_goes_after_its_time_to_live(spark, tmp_path, few_partitions):
    folder, sizes = tmp_path / "in", []
    for n in range(2):
        _files(spark, folder, [([(100 * n + i, 1, False, "t") for i in range(50)], EVENTS)])
        for f in folder.glob("part-*"):
            if f.stat().st_mtime < 1e9 + 1:
                os.utime(f, (1e9 + n, 1e9 + n))
        query = documents.load_versions(_stream(spark, folder, EVENTS), f"file://{tmp_path}/out", f"file://{tmp_path}/check", ttl_seconds=1, buckets=1)
        query.awaitTermination()
        sizes.append([sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress][-1])
        time.sleep(2)
    assert commits.read(spark, f"file://{tmp_path}/out", "documents").count() == 100
    assert sizes[0] > 0 and sizes[1] <= sizes[0]  # what came first has gone


def test_letters_are_tried_again(spark, tmp_path):
    root, here = f"file://{tmp_path}/letters", f"file://{tmp_path}/table"
    rejects = spark.createDataFrame([(1, "a", True, "away"), (2, "b", True, "away"), (3, "c", False, "bad")], "doc_id long, text string, retryable boolean, error string")
    for _ in range(2):  # a replayed batch adds none
        documents.put_letters(rejects, root, "doc_id", "2024-01-01 00:00:00")
    assert commits.read(spark, root, "letters").count() == 3
    back = {1: 2}  # the source of 1 is back at its second attempt, that of 2 never
    seen = []

    def load(rows):
        found = rows.collect()
        seen.append(sorted(r.doc_id for r in found))
        good = [r for r in found if back.get(r.doc_id) == len(seen)]
        if good:
            for _ in range(2):  # as after a crash
                commits.upsert(spark.createDataFrame([(r.doc_id, r.text) for r in good], "doc_id long, text string"), here, "documents", "doc_id")
        return spark.createDataFrame([(r.letter_id, r in good, True, None if r in good else "still away") for r in found], "letter_id string, ok boolean, retryable boolean, error string")

    again = lambda now: documents.retry_letters(spark, root, load, "doc_id long, text string", now, most=3, first_wait_seconds=60, longest_wait_seconds=150)
    assert again("2024-01-01 00:00:30") == {}  # not yet
    seen.clear()
    assert again("2024-01-01 00:01:00") == {"waiting": 2}
    assert again("2024-01-01 00:02:00") == {}  # two minutes have not passed
    seen.pop()
    assert again("2024-01-01 00:03:00") == {"loaded": 1, "waiting": 1}
    assert again("2024-01-01 00:05:30") == {"exhausted": 1}  # 150 seconds are the longest wait
    assert again("2024-02-01 00:00:00") == {} and seen == [[1, 2], [1, 2], [2], []]
    assert [tuple(r) for r in commits.read(spark, here, "documents").collect()] == [(1, "a")]
    held = {r.letter_id: (r.outcome, r.attempts, r.error) for r in commits.read(spark, root, "letters").collect()}
    assert held == {"1": ("loaded", 2, None), "2": ("exhausted", 3, "still away"), "3": ("final", 0, "bad")}
