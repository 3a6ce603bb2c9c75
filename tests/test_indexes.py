"""The vector and the lexical index against whole scans, and joins by runs of characters and by bins against brute force."""

import io
import random
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import lexical_index, measures, retrieval, vector_index
from tarn.scratch import fresh_path
from tarn.sources import datasets


def _plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def _clustered(spark, n=4000, dim=16, middles=40, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(middles, dim))[r.integers(0, middles, n)] + 0.35 * r.normal(size=(n, dim))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def vectors(spark):
    return _clustered(spark)


@pytest.fixture(scope="module")
def built(spark, vectors):
    return vector_index.build(vectors, fresh_path(spark, "test-vectors"))


def _asked(df):
    return df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_every_vector_is_in_a_cell(spark, vectors, built):
    table = spark.read.parquet(f"{built.path}/vectors")
    assert table.select("id").distinct().count() == table.count() == vectors.count() == built.rows.sum() and 20 < len(built.cells) <= 63


def test_an_exact_search_is_a_whole_scan(vectors, built):
    report = []
    got = vector_index.search(built, _asked(vectors), 10, probes=3, exact=True, report=report)
    assert _rows(got) == _rows(retrieval.dense_top(_asked(vectors), vectors, 10))
    assert report[0]["more_pairs"] > 0 and report[0]["pairs"] + report[0]["more_pairs"] < report[0]["queries"] * report[0]["cells"]  # cells stay closed
    assert _rows(vector_index.search(built, _asked(vectors), 10, probes=3, exact=True, max_queries=17)) == _rows(got)


def test_recall_of_the_first_probes(vectors, built):
    want = {(q, v) for q, _, v, _ in _rows(retrieval.dense_top(_asked(vectors), vectors, 10))}
    got = {(q, v) for q, _, v, _ in _rows(vector_index.search(built, _asked(vectors), 10))}
    assert len(want & got) >= 0.95 * len(want)


def test_cells_nobody_asks_for_are_not_read(spark, vectors, built):
    one = vectors.filter("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    ids, matrix = [7], vector_index._unit(np.array([one.first()[1]], np.float64))
    wanted = np.zeros((1, len(built.cells)), bool)
    wanted[0, :2] = True
    plan = _plan(vector_index._open(built, spark, ids, matrix, wanted, 5, "bigint"))
    assert "PartitionFilters: [cell" in plan.replace("\n", " ")
    opened = vector_index._open(built, spark, ids, matrix, wanted, 5, "bigint")
    assert opened.count() > 0 and len(spark.read.parquet(f"{built.path}/vectors").filter(F.col("cell").isin([int(c) for c in built.cells[:2]])).inputFiles()) >= 2


def test_vectors_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0]), (9, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build(df, fresh_path(spark, "test-odd"))
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in vector_index.search(index, asked, 2, exact=True).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1.0), (1, 8, 1.0), (3, 1, 0.0), (3, 2, 0.0)]
    none = vector_index.build(df.limit(0), fresh_path(spark, "test-none"))
    assert vector_index.search(none, asked, 2, exact=True).collect() == []
    with pytest.raises(ValueError, match="one length"):
        vector_index.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), fresh_path(spark, "test-mixed"))


def test_a_cell_that_holds_most_rows_is_written_by_many_tasks(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 10 == 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.col("id") / 1e9)).alias("embedding"))
    index = vector_index.build(df, fresh_path(spark, "test-hot"), cells=4, rows_a_file=100)
    hot = int(index.cells[index.rows.argmax()])
    files = spark.read.parquet(f"{index.path}/vectors").filter(F.col("cell") == hot).select(F.input_file_name()).distinct().count()
    assert index.rows.sum() == 3000 and files > 5


def test_new_vectors_replace_old_ones_in_a_new_version(spark, vectors, built):
    given = spark.createDataFrame([(7, [9.0] + [0.0] * 15, 0), (9000, [9.0] + [0.1] * 15, 0)], vectors.schema)
    after = vector_index.add(built, given, fresh_path(spark, "test-added"))
    asked = spark.createDataFrame([(0, [1.0] + [0.0] * 15)], "query_id long, embedding array<float>")
    assert [r.vec_id for r in vector_index.search(after, asked, 2, exact=True).orderBy("rank").collect()] == [7, 9000]
    assert after.rows.sum() == 4001 and vector_index.load(spark, built.path).rows.sum() == 4000


# --- lexical


def _texts(spark, n=1500, seed=3):
    r = random.Random(seed)
    common, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        topic = rare[(i % 60) * 50 : (i % 60) * 50 + 50]
        rows.append((i, " ".join(r.choice(common) if r.random() < 0.5 else r.choice(topic) for _ in range(r.randint(1, 80)))))
    rows += [(n, None), (n + 1, ""), (n + 2, " .,; "), (None, "w1 r5"), (5, rows[7][1]), (n + 3, rows[7][1]), (n + 4, "w1 " * 5000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _ranked(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("window", [4, 64, 10_000])
def test_the_lexical_index_finds_what_a_scan_finds(spark, window):
    docs = _texts(spark)
    queries = [(i, f"r{i * 70} r{i * 70 + 1} r{i * 70 + 2} w{i % 30}") for i in range(40)] + [(100, "W1 w1 w2"), (101, "nothing"), (102, None), (103, ""), (104, "r5")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    index = lexical_index.build(docs, fresh_path(spark, "test-lexical"), window=window)
    report = {}
    got = _ranked(lexical_index.search(index, asked, 7, report=report))
    assert got == _ranked(retrieval.bm25_top(asked, docs, 7))
    assert report["opened"] <= report["blocks"] and (window != 4 or report["opened"] < report["blocks"] / 2)


def test_texts_are_not_read_when_a_query_is_asked(spark):
    docs = _texts(spark, 200)
    folder = fresh_path(spark, "test-lexical-texts")
    docs.write.parquet(f"{folder}-docs")
    index = lexical_index.build(spark.read.parquet(f"{folder}-docs"), folder)
    from tarn.scratch import _drop

    want = _ranked(retrieval.bm25_top(spark.createDataFrame([(1, "w1 r5")], "query_id long, text string"), spark.read.parquet(f"{folder}-docs"), 5))
    _drop(spark, f"{folder}-docs")
    again = lexical_index.load(spark, folder)
    assert again == index and _ranked(lexical_index.search(again, spark.createDataFrame([(1, "w1 r5")], "query_id long, text string"), 5)) == want


def test_an_empty_lexical_index(spark):
    index = lexical_index.build(_texts(spark, 60).limit(0), fresh_path(spark, "test-lexical-none"))
    assert lexical_index.search(index, spark.createDataFrame([(1, "a")], "query_id long, text string"), 3).collect() == []


def test_the_lexical_index_reads_each_text_once_and_moves_no_posting(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = _texts(spark, 400)
    index = lexical_index.build(docs.mapInArrow(seen, docs.schema), fresh_path(spark, "test-lexical-once"))
    assert read.value == 2 * docs.count()  # once counted, once split
    held = index.blocks(spark)
    assert held.count() == held.select("grp", "term").distinct().count()  # a term of a segment is one row


@pytest.mark.parametrize(("group", "length"), [(50, 1 << 22), (8192, 300)])
def test_segments_of_any_size_give_the_same_hits(spark, group, length):
    odd = ["\u212aelvin \u0130x", "kelvin i x", "Z\u00fcrich\u4e2d w1", "w1", "a" * 3000 + " w1", None, "", "w1 w1\tW1"]
    docs = _texts(spark, 300).unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "w1 rich"), (2, "kelvin"), (3, "i x"), (4, "z w1"), (5, "w2 w3 r60")], "query_id long, text string")
    index = lexical_index.build(docs, fresh_path(spark, "test-lexical-segments"), window=8, group=group, length=length)
    documents = index.blocks(spark).filter("term = ''").agg(F.count("*"), F.max("n"), F.sum("n")).first()
    assert documents[0] >= 6 and documents[1] <= max(group, 64)
    want = _ranked(retrieval.bm25_top(asked, docs, 5))
    assert _ranked(lexical_index.search(index, asked, 5)) == want
    assert _ranked(lexical_index.search(index, asked, 5, max_queries=2)) == want


def test_an_index_of_another_layout_is_refused(spark):
    folder = fresh_path(spark, "test-lexical-old")
    spark.createDataFrame([('{"documents": 1, "window": 64, "groups": 8, "id_type": "bigint"}',)], "value string").write.text(f"{folder}/about")
    with pytest.raises(ValueError, match="layout"):
        lexical_index.load(spark, folder)


# --- percentiles


def test_selection_does_not_depend_on_how_values_are_spread(spark):
    r = random.Random(5)
    values = [10.0 ** r.uniform(0, 18) for _ in range(3000)] + [float(r.randint(0, 9)) for _ in range(2000)] + [1e12, 1e18, -1e18, float("inf"), float("-inf"), -0.0, 0.0, 5e-324]
    values += [20.0 + i * 1e-12 for i in range(2000)]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "g string, v double")
    places = list(range(1, len(values) + 1, 37)) + [len(values)]
    found = {x.place: x.value for x in measures.order_statistics(rows, "g", "v", spark.createDataFrame([("a", p) for p in places], "g string, place long")).collect()}
    assert found == {p: sorted(values)[p - 1] for p in places}


def test_ordered_bits(spark):
    values = [float("-inf"), -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("bits", measures.ordered_bits(F.col("v")))
    rows = df.withColumn("back", measures.from_ordered_bits(F.col("bits"))).orderBy("bits").collect()
    assert [x.i for x in rows] == list(range(len(values))) and all(x.back == x.v or x.v != x.v for x in rows)
    assert spark.sql("SELECT double(-0.0) AS v").select(measures.ordered_bits(F.col("v"))).first()[0] == 0


def test_percentiles_read_the_table_a_fixed_number_of_times(spark, tmp_path):
    spark.range(2000).select((F.col("id") % 3).alias("g"), F.exp(F.col("id") / 100).alias("v")).write.parquet(f"{tmp_path}/t")
    plan = _plan(measures.latency(spark.read.parquet(f"{tmp_path}/t"), "g", "v"))
    assert plan.count("Scan parquet") <= 9


# --- runs of characters


def test_rarest_runs_meet_few_texts(spark):
    endings = [f"{x:05d} annual report of the company" for x in range(3000)]
    asked = [f"{x:05d} annual" for x in range(0, 3000, 30)] + ["company", "zzz", "of", "x"]
    short = spark.createDataFrame([(a,) for a in asked], "short string")
    long = spark.createDataFrame([(e,) for e in endings], "long string")
    found = retrieval.contained(short, long)
    n = found.count()
    matches = sorted((a, e) for a in asked for e in endings if a in e)
    assert sorted((r.short, r.long) for r in found.collect() if r.short in r.long) == matches
    assert n <= 10 * len(matches)
    per = {r.short: r["count"] for r in found.groupBy("short").count().collect()}
    assert max(v for k, v in per.items() if k[0] == "0") <= 40  # not all that end alike


def test_a_text_that_many_rows_share_is_looked_up_once(spark):
    left = spark.range(500).select("id", F.lit("same name").alias("a"))
    right = spark.createDataFrame([(1, "the same name here"), (2, "other"), (3, "same")], "j int, b string")
    assert retrieval.either_holds(left, right, "a", "b").groupBy("j").count().orderBy("j").collect() == [(1, 500), (3, 500)]


# --- ranges


def _ranges(seed, n, keys, most):
    r = random.Random(seed)
    rows = [(i, r.randrange(keys), lo := r.randrange(200), lo + r.randrange(most)) for i in range(n)]
    return rows + [(n, None, 1, 2), (n + 1, 0, None, 2), (n + 2, 0, 5, None), (n + 3, 0, 9, 3)]


@pytest.mark.parametrize("width,most", [(1, 10_000), (7, 10_000), (7, 3), (1000, 50)])
def test_overlaps_are_brute_forces(spark, width, most):
    a, b = _ranges(1, 150, 3, 30), _ranges(2, 120, 3, 30)
    left = spark.createDataFrame(a, "i int, k int, lo int, hi int")
    right = spark.createDataFrame(b, "j int, k int, lo int, hi int")
    good = lambda rows: [x for x in rows if None not in x and x[2] <= x[3]]
    want = sorted((x[0], y[0]) for x in good(a) for y in good(b) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    got = datasets.overlapping(left, right, "k", width, most)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    counts = {r.i: r.n for r in datasets.overlap_counts(left, right, "k").collect()}
    assert counts == {x[0]: sum(p == x[0] for p, _ in want) for x in a}


def test_equal_ranges_are_dealt_to_tasks_by_pairs_not_bytes(spark):
    rows = spark.createDataFrame([(i, 1, 5, 6) for i in range(300)], "i int, k int, lo int, hi int").coalesce(1)
    met = datasets.overlapping(rows, rows.withColumnRenamed("i", "j"), "k", 10, 50)
    per = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 90_000 and max(per) <= 45_000


def test_holding_by_runs_of_characters(spark):
    docs = spark.createDataFrame([(1, "aXb cd"), (2, "Xb"), (2, "no"), (None, "aXb"), (4, None), (5, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Xb"), (2, "aXb c"), (3, ""), (4, "d"), (5, ".")], "query_id long, passage string")
    got = sorted((str(r.query_id), str(r.doc_id)) for r in retrieval.holding(docs, asked).collect())
    want = sorted((str(q), str(d)) for d, t in ((1, "aXb cd"), (2, "Xb"), (2, "no"), (None, "aXb"), (5, "")) for q, p in ((1, "Xb"), (2, "aXb c"), (3, ""), (4, "d"), (5, ".")) if p in t)
    assert got == want
