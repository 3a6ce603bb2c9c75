"""The log of commits: readers never see half of one, writers never lose one."""

import threading

import pytest
from pyspark.sql import functions as F

from tarn.sources import commits, index


def test_tables_change_together(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert commits.snapshot(spark, root) == commits.Snapshot()
    first = commits.replace(root, {"a": spark.range(3), "b": spark.range(5)})
    second = commits.replace(root, {"a": spark.range(4)})
    assert (first.number, second.number) == (1, 2)
    count = lambda name, at=None: commits.read(spark, root, name, at).count()
    assert (count("a"), count("b"), count("a", first), count("a", commits.snapshot(spark, root, 1))) == (4, 5, 3, 3)
    commits.commit(spark, root, lambda base: {"b": None})
    with pytest.raises(ValueError):
        commits.read(spark, root, "b")
    assert commits.read(spark, root, "b", second).count() == 5
    assert commits.vacuum(spark, root, keep=1) == 2 and count("a") == 4
    with pytest.raises(ValueError):
        commits.snapshot(spark, root, 1)


def test_a_number_is_taken_once(spark, tmp_path):
    path = f"file://{tmp_path}/_commits/000000000001.json"
    assert commits._create(spark, path, "{}") and not commits._create(spark, path, "[]")
    assert (tmp_path / "_commits" / "000000000001.json").read_text() == "{}"
    assert [p.name for p in (tmp_path / "_commits").iterdir() if not p.name.endswith(".crc")] == ["000000000001.json"]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root, failed = f"file://{tmp_path}/t", []

    def write(n):
        try:
            for i in range(5):
                commits.append(spark.createDataFrame([(n, i)], "n int, i int"), root, "rows")
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed and commits.snapshot(spark, root).number == 20
    assert sorted(map(tuple, commits.read(spark, root, "rows").collect())) == [(n, i) for n in range(4) for i in range(5)]


def test_a_reader_in_a_loop_never_fails(spark, tmp_path):
    root, seen, failed, done = f"file://{tmp_path}/t", [], [], threading.Event()
    two = lambda i: {"a": spark.createDataFrame([(i,)], "i int"), "b": spark.createDataFrame([(i,)], "i int")}
    commits.replace(root, two(0))

    def read():
        while not done.is_set():
            try:
                at = commits.snapshot(spark, root)
                seen.append((commits.read(spark, root, "a", at).first()[0], commits.read(spark, root, "b", at).first()[0]))
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    staged = {n: commits.stage(df, root, n) for n, df in two(-1).items()}
    for i in range(1, 101):
        commits.replace(root, two(i)) if i % 10 == 0 else commits.commit(spark, root, lambda _: staged)
    done.set()
    reader.join()
    assert not failed and len(seen) > 3 and all(a == b for a, b in seen)


def test_an_upsert_writes_touched_buckets_only(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.lit("old").alias("x"))
    before = commits.upsert(rows, root, "t", "k", buckets=16)
    after = commits.upsert(spark.createDataFrame([(7, 2, "new"), (900, 1, "new")], "k long, v int, x string"), root, "t", "k", buckets=16)
    changed = [b for b in after.tables["t"]["buckets"] if after.tables["t"]["buckets"][b] != before.tables["t"]["buckets"].get(b)]
    assert 1 <= len(changed) <= 2
    held = {r.k: r.x for r in commits.read(spark, root, "t").collect()}
    assert len(held) == 501 and held[7] == held[900] == "new" and held[8] == "old"
    # with an order, an older row does not replace a newer one, whichever comes first
    commits.upsert(spark.createDataFrame([(7, 1, "late"), (8, 3, "newer"), (8, 2, "older")], "k long, v int, x string"), root, "t", "k", best="v", buckets=16)
    held = {r.k: r.x for r in commits.read(spark, root, "t").collect()}
    assert held[7] == "new" and held[8] == "newer" and len(held) == 501


def test_loads_at_once_load_content_once(spark, tmp_path):
    root, failed = f"file://{tmp_path}/docs", []

    def load(n):
        try:
            index.load_new(spark.createDataFrame([(f"{n}-{i}", str(i)) for i in range(3)], "uri string, content_hash string"), root)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=load, args=(n,)) for n in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed and sorted(r.content_hash for r in commits.read(spark, root, "documents").collect()) == ["0", "1", "2"]


def test_a_failed_load_is_taken_back_everywhere(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    commits.replace(root, {"documents": spark.range(4).withColumnRenamed("id", "doc_id"), "chunks": spark.range(8).select((F.col("id") / 2).cast("long").alias("of"), "id")})
    index.take_back(spark, root, spark.createDataFrame([(1,), (3,)], "d long"), {"documents": "doc_id", "chunks": "of", "vectors": "id"})
    assert sorted(r.doc_id for r in commits.read(spark, root, "documents").collect()) == [0, 2]
    assert sorted(r.id for r in commits.read(spark, root, "chunks").collect()) == [0, 1, 4, 5]
