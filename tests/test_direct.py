"""Operators that no registered query reaches, against values worked out by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import numbers as N
from tarn.functions import text as T
from tarn.operators import candidates, chunking, fusion, graph, measures, packing, profiling, retrieval, traces, verification
from tarn.plans import planning
from tarn.plans.registry import NoGraphCache, TableGraphStore, embedder
from tarn.sources import datasets, files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_normal_forms(spark):
    assert one(spark, T.normal_term(F.lit(" Net__Sales  x")))[0] == "net sales x"
    assert one(spark, T.folded(F.lit("Größe  ﬁn ΛΟΓΟΣ ſ")))[0] == "grösse fin λογοσ s"
    assert one(spark, T.coverage_aliases(F.lit("net_sales")))[0] == ["net sales", "net sale"]
    assert one(spark, T.stable_id("p", F.lit(1), F.lit(None)))[0] == "p_" + hashlib.sha256(b"1\x1f").hexdigest()[:32]
    assert one(spark, T.blank_to_null(F.lit("  ")))[0] is None


def test_years_and_companies(spark):
    text = F.lit("In FY2023 and 2021, not 12023, Acme Widgets Inc. (NYSE: ACM) met johnson and johnson; fordable fy2023")
    assert one(spark, T.years(text))[0] == ["2023", "2021"] and one(spark, T.period_names(text))[0] == ["FY2023", "2021"]
    assert one(spark, T.companies(text))[0] == ["Acme Widgets Inc", "ACM", "Johnson & Johnson"]
    assert one(spark, T.companies(F.lit("no names")))[0] == []


def test_strict_numbers(spark):
    text = F.lit("[c12] grew 25 bps to $3.5 mm, (1,200) or 7 percent; -2 x2 3x 4 basis points €9 5 percentage point 1 Billion")
    found = [(float(r.value), r.unit) for r in one(spark, N.strict_numbers(text))[0]]
    assert found == [(25, "basis_points"), (3.5, "million"), (-1200, None), (7, "percent"), (-2, None), (4, "basis_points"), (9, "currency"), (5, "percent"), (1, "billion")]
    match = lambda said, held: one(spark, N.strict_match(N.strict_numbers(F.lit(said))[0], N.strict_numbers(F.lit(held))))[0]
    assert match("7", "7%") and match("7%", "7 percent") and not match("7%", "7") and not match("7.1", "7.10001") and match("7.10", "7.1")


def test_integers(spark):
    got = one(spark, *[N.parse_int(F.lit(x)) for x in ("p. 1,234 of 9", "-5", "none", "x+3")], N.whole(F.lit(3.0)), N.whole(F.lit(3.5)))
    assert list(got) == [1234, -5, None, 3, 3, None]


def test_lanes():
    assert retrieval.lane_top_k(3, 7, 5) == 7 and retrieval.lane_top_k() == 1
    assert [retrieval.effective_top_k(x) for x in (None, 0, 5, 50)] == [8, 8, 5, 12]
    assert retrieval.lanes_of("dense") == retrieval.lanes_of("nonsense") == ("dense",) and retrieval.lanes_of("bm25") == ("sparse",)
    assert retrieval.lanes_of("rrf", "Metric and table") == ("dense", "sparse", "table", "metric_alias")


def test_all_terms(spark):
    df = spark.createDataFrame([("a b c", ["a", "c"]), ("a b", ["a", "c"]), ("x", [])], "t string, ts array<string>")
    assert [r[0] for r in df.select(retrieval.all_terms(F.col("t"), F.col("ts"))).collect()] == [True, False, True]


def test_bm25_and_overlap_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "c"), (4, None), (None, "a a a")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "A a the"), (11, "c b"), (12, "zz"), (13, None)], "query_id long, text string")
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256))
    idf = lambda df: np.log((5 - df + 0.5) / (df + 0.5) + 1)
    rows = {(r.query_id, r.doc_id): (r.score, r.rank) for r in retrieval.bm25_top(asked, docs, 2).collect()}
    want = {(10, 1): 2 * idf(1) * part(2, 3), (11, 2): idf(2) * part(1, 2) + idf(2) * part(1, 2), (11, 3): idf(2) * part(1, 1)}
    assert {k: v[0] for k, v in rows.items()} == {k: round(v, 6) for k, v in want.items()} and [rows[k][1] for k in want] == [1, 1, 2]
    rows = {(r.query_id, r.doc_id): (r.score, r.rank) for r in retrieval.overlap_top(asked, docs, 2).collect()}
    assert rows == {(11, 2): (1.0, 1), (11, 1): (0.5, 2)}  # of documents 1 and 3 the smaller id; a and the are left out
    blocks = retrieval.bm25_top(asked, docs, 2, max_queries=1).orderBy("query_id", "rank").collect()
    assert blocks == retrieval.bm25_top(asked, docs, 2).orderBy("query_id", "rank").collect()


def test_holding(spark):
    docs = spark.createDataFrame([(1, "One big, BIG thing here"), (2, "one big"), (3, None), (4, "big")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "big, BIG thing"), (2, "big"), (3, "ne big"), (4, "a b c"), (5, None), (6, "e big, BIG th")], "query_id long, passage string")
    assert sorted(tuple(r) for r in retrieval.holding(docs, asked).collect()) == [(1, 1), (2, 1), (2, 2), (2, 4), (3, 1), (3, 2), (6, 1)]


def test_either_holds(spark):
    names = ["", "a", "ab", "abc", "xabcx", "bc", "zzz", "cxab", None, "abcabc"]
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, a string")
    right = spark.createDataFrame([(j, n) for j, n in enumerate(names)], "j int, b string")
    want = sorted((i, j) for i, x in enumerate(names) for j, y in enumerate(names) if x and y and (x in y or y in x))
    assert sorted((r.i, r.j) for r in retrieval.either_holds(left, right, "a", "b").collect()) == want


def test_order_statistics(spark):
    r = np.random.default_rng(2)
    values = [*r.normal(size=500).tolist(), *[3.0] * 400, 1e300, -1e300, *(1 + r.random(300) * 1e-9).tolist()]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0)] * 3 + [(None, 1.0)], "g string, v double")
    wanted = spark.createDataFrame([("a", i) for i in (1, 2, 250, 600, 900, 1201, len(values))] + [("b", 2), (None, 1)], "g string, place long")
    found = {(x.g, x.place): x.value for x in measures.order_statistics(rows, "g", "v", wanted).collect()}
    assert found == {("a", i): sorted(values)[i - 1] for i in (1, 2, 250, 600, 900, 1201, len(values))} | {("b", 2): 5.0, (None, 1): 1.0}


def test_case_results(spark):
    cases = spark.createDataFrame([(1, "q", "supported", "Net  Sales", ["a", "b"]), (2, "q", "supported", None, []), (3, "q", "x", "y", None)], "case_id int, question string, expected_confidence string, expected_answer string, expected_keywords array<string>")
    runs = spark.createDataFrame([(1, "the net sales a", "supported", True, 5, None), (2, "t", "other", False, 7, "boom")], "case_id int, answer string, confidence string, cited boolean, latency_ms int, error string")
    rows = {r.case_id: tuple(r)[2:] for r in measures.case_results(cases, runs).collect()}
    assert rows == {1: ("supported", True, True, 0.5, True, 5, None), 2: (None, False, False, 0.0, None, 7, "boom"), 3: (None, False, False, 0.0, False, 0, "no run")}


def test_single_target_precision(spark):
    ranked = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "c", 1)], "query_id int, item string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id int, item string")
    assert {r.query_id: r.average_precision for r in measures.single_target_precision(ranked, relevant, relevant).collect()} == {1: 0.5, 2: 0.0}


def test_lane_scores_by_hand(spark):
    kind = "unit_text string, sparse_text string, must array<string>, should array<string>, aliases array<string>, periods array<string>, entity string, metric string, text string, company string, metrics array<string>"
    row = ("net sales of Acme", None, ["net sales"], ["growth"], ["net_sales", "turnover"], ["2020", "2021"], "Acme", "revenue", "Acme net sales 2020: the statement", "x", ["revenue"])
    r = fusion.lane_scores(spark.createDataFrame([row], kind), boost_must=True).first()
    assert (r.dense, r.bm25) == (pytest.approx(0.45 + 1.8 + 1 + 0.45), pytest.approx(1.05 + 0.25 + 0.8 + 0.5))
    assert (r.metric_alias, r.table) == (pytest.approx(0.4 + 1.2 + 0.7 + 0.35), pytest.approx(0.4 + 0.9 + 0.5 + 0.8 + 0.25))


def test_shapes(spark):
    kind = "query_id int, chunk_id string, parent_id string, rank int, text string, parent_text string, previous_text string, next_text string"
    rows = spark.createDataFrame([(1, "a", "p", 1, "ta", "tp", "", "n"), (1, "b", "p", 2, "tb", "tp", "", "n"), (1, "c", "q", 3, "tc", "tq", "o", None)], kind)
    shape = lambda name: [(r.chunk_id, r.text, r.rank) for r in fusion.shaped(rows, name).orderBy("rank").collect()]
    assert shape("child_chunk") == [("a", "ta", 1), ("b", "tb", 2), ("c", "tc", 3)]
    assert shape("parent_block") == [("p", "tp", 1), ("q", "tq", 2)] and shape("page_neighborhood") == [("p", "tp\nn", 1), ("q", "o\ntq", 2)]
    with pytest.raises(ValueError):
        fusion.shaped(rows, "other")


def test_graph_modes_and_anchors(spark):
    df = spark.createDataFrame([(2, None), (1, None), (0, None), (2, "drift")], "n int, mode string")
    assert [r[0] for r in df.select(graph.graph_mode(F.col("n"), F.col("mode"))).collect()] == ["path", "local", "unresolved", "unsupported"]
    anchors = spark.createDataFrame([("a2", 1, "c", "x"), ("a1", 1, "c", "x"), ("a3", 1, "c", "y")], "anchor_id string, object_id int, chunk_id string, text_span string")
    chunks = spark.createDataFrame([("c", "d", 0)], "chunk_id string, doc_id string, chunk_index int")
    assert graph.ground(spark.createDataFrame([(1,), (2,)], "object_id int"), anchors, chunks).count() == 2
    items = spark.createDataFrame([("i", 1, 0.5), ("i", 2, 1.0), ("j", 2, None)], "item_id string, object_id int, confidence double")
    assert {r.item_id: (r.score, r.grounding) for r in graph.graph_scores(items, anchors).collect()} == {"i": (0.75, 1.0), "j": (None, 0.0)}


def test_missing_chunks(spark):
    anchors = spark.createDataFrame([("a", "c1"), ("b", "c2")], "anchor_id string, chunk_id string")
    assert [r.anchor_id for r in graph.missing_chunks(anchors, spark.createDataFrame([("c1",)], "chunk_id string")).collect()] == ["b"]


def test_evidence_and_contexts(spark):
    ev = spark.createDataFrame([(1, "c", 2, "t2", "bm25"), (1, "c", 1, "t1", "dense"), (1, "d", 3, "t3", "dense")], "query_id int, chunk_id string, rank int, text string, source string")
    rows = {r.chunk_id: (r.rank, r.text, r.sources) for r in packing.dedupe_evidence(ev).collect()}
    assert rows == {"c": (1, "t1", ["bm25", "dense"]), "d": (3, "t3", ["dense"])}
    types = spark.createDataFrame([([],), (["a", None, "a"],), (["a", "b"],)], "t array<string>")
    assert [r[0] for r in types.select(packing.source_type(F.col("t"))).collect()] == ["text_chunk", "a", "mixed"]
    contexts = spark.createDataFrame([("t", 2, "late", ["x"]), ("t", 1, None, ["y"])], "table_id string, source_order int, name string, columns array<string>")
    row = candidates.merge_contexts(contexts).first()
    assert row.name == "late" and row["columns"] == ["y"]
    hits = spark.createDataFrame([(1, "c", "dense", "t1", "u0", 2), (1, "c", "dense", "t1", "u0", 2), (1, "c", "bm25", "t1", "u0", 1)], "query_id int, chunk_id string, lane string, task_id string, unit_id string, rank int")
    assert [x.lane for x in fusion.lane_attribution(hits).first().lanes] == ["bm25", "dense"]
    events = traces.retrieval_events(spark.createDataFrame([(1, "c", 1, 0.5)], "query_id int, chunk_id string, rank int, score double")).first()
    assert (events.event, events.value) == ("evidence", 0.5)


def test_labels_metadata_and_scores(spark):
    df = spark.createDataFrame([("SQL",), ("other",), (None,)], "p string")
    assert [r[0] for r in df.select(candidates.safe_provider(F.col("p"))).collect()] == ["sql", "hybrid", "hybrid"]
    nested = '{"a": {"Text": "x", "k": [1, {"summary": "y", "z": "é"}]}, "description": 1}'
    got = spark.createDataFrame([(nested,), (None,), ("no json",)], "m string").select(candidates.safe_json(F.col("m"))).collect()
    assert [r[0] for r in got] == ['{"a": {"k": [1, {"z": "é"}]}}', None, None]
    scores = spark.createDataFrame([(None, 0.2, 0.9, None), (None, 0.4, None, None)], "rerank_score double, fusion_score double, dense_score double, lexical_score double")
    assert scores.agg(candidates.block_score()).first()[0] == 0.4 and scores.limit(0).agg(candidates.block_score()).first()[0] == 0.0
    blocks = spark.createDataFrame([("text_chunk", "p"), ("text_chunk", None), ("table", "p")], "source_type string, parent_id string")
    assert [r.source_type for r in candidates.promote_parents(blocks).collect()] == ["parent_block", "text_chunk", "table"]


def test_answers(spark):
    ev = spark.createDataFrame([(1, "c1", "t1"), (1, "c2", "t2")], "query_id int, citation_id string, text string")
    said = spark.createDataFrame([("a", 1, "x [c2] y [c1] z [c2] [c9]")], "answer_id string, query_id int, text string")
    assert [(r.position, r.citation_id) for r in verification.answer_citations(said, ev).orderBy("position").collect()] == [(0, "c2"), (1, "c1")]
    assert one(spark, verification.final_confidence(F.lit(" "), F.lit(None).cast("string"), F.lit("x"), F.lit("y")))[0] == "x"
    rows = spark.createDataFrame([("insufficient", "supported"), ("supported", "partial"), ("supported", "supported")], "confidence string, verdict string")
    assert [(r.unsupported_answer, r.false_insufficient) for r in verification.critic_flags(rows).collect()] == [(False, True), (True, False), (False, False)]
    assert verification.redact(rows.withColumn("n", F.lit(None).cast("string")), ["verdict", "n"]).first().asDict() == {"confidence": "insufficient", "verdict": "[redacted]", "n": None}


def test_plans_and_caches(spark):
    tasks = spark.createDataFrame([("a", "ready"), ("b", "skipped_non_executable"), ("c", "ok")], "task_id string, status string")
    assert sorted(r.task_id for r in planning.executable(tasks).collect()) == ["a", "c"]
    assert planning.canonical({"b": [2, 1], "a": {"d": 1, "c": None}}) == '{"a":{"c":null,"d":1},"b":[2,1]}'
    answers = spark.createDataFrame([(1, "supported"), (2, "insufficient")], "id int, confidence string")
    assert [r.id for r in planning.admit(answers).collect()] == [1]


def test_cached_answers(spark, tmp_path):
    cache = planning.QueryCache(spark, f"file://{tmp_path}/cache")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "key string")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert cache.get(keys, now).collect() == []
    at = lambda *rows: spark.createDataFrame(rows, "key string, answer string, confidence string, c string, e string").select("key", "answer", "confidence", F.col("c").cast("timestamp").alias("created_at"), F.col("e").cast("timestamp").alias("expires_at"))
    cache.put(at(("a", "old", "supported", "2024-01-01 00:00:00", None), ("b", "gone", "supported", "2024-01-01 00:00:00", "2024-01-01 12:00:00"), ("c", "weak", "insufficient", "2024-01-01 00:00:00", None)))
    cache.put(at(("a", "new", "supported", "2024-01-01 01:00:00", "2024-01-03 00:00:00"), ("d", "other", "supported", "2024-01-01 00:00:00", None)))
    assert [tuple(r) for r in cache.get(keys, now).collect()] == [("a", "new", "supported")]
    later = F.lit("2024-01-04 00:00:00").cast("timestamp")
    assert [tuple(r) for r in cache.get(keys, later).collect()] == [("a", "old", "supported")]


def test_graph_stores(spark):
    edges = spark.createDataFrame([("a", "b", "1", 0.9), ("b", "c", "2", 0.5)], "source string, target string, edge_id string, confidence double")
    store = TableGraphStore(edges, spark.createDataFrame([("a", "Alpha", ["al"])], "entity_id string, name string, aliases array<string>"))
    assert [r.entity_id for r in store.entities(spark.createDataFrame([("ALPHA",)], "term string")).collect()] == ["a"]
    assert sorted(r.other for r in store.neighbours(spark.createDataFrame([("b",)], "node string")).collect()) == ["a", "c"]
    assert [r.mid for r in store.paths(spark.createDataFrame([("a", "c")], "start string, goal string")).collect()] == ["b"]
    assert NoGraphCache().get("k") is None and NoGraphCache().put("k", edges) is None


def test_chunks_stay_on_their_page(spark):
    pages = spark.createDataFrame([(1, 2, "c d"), (1, 1, "a b\n\nc d e"), (2, None, "x"), (3, 1, None)], "doc_id int, page int, text string")
    rows = chunking.chunk_pages(pages, 3, 0).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.page, r.chunk_index, r.text) for r in rows] == [(1, 1, 0, "a b"), (1, 1, 1, "c d e"), (1, 2, 2, "c d"), (2, None, 0, "x")]


def test_document_hints(spark):
    docs = spark.createDataFrame([(1, "http://x/Annual-Report_2020.pdf?v=1"), (2, "ab"), (3, "")], "doc_id int, name string")
    hints = spark.createDataFrame([(1, "report 2020"), (2, "a/b/ANNUALREPORT2020PDF.bak#p"), (3, "xaby"), (4, "a"), (5, " "), (6, "2021")], "case_id int, hint string")
    assert sorted(tuple(r) for r in datasets.hinted_documents(hints, docs).collect()) == [(1, 1), (2, 1), (3, 2), (4, 1), (4, 2)]


def test_evidence_is_exploded(spark):
    kind = "case_id int, evidence array<struct<doc_name:string,full_page:string,evidence:string,raw_page:int>>"
    rows = datasets.explode_evidence(spark.createDataFrame([(1, [("d", "f", "e", 3), ("g", None, "h", 4)]), (2, []), (3, None)], kind)).collect()
    assert [(r.case_id, r.position, r.doc_name, r.raw_page) for r in rows] == [(1, 0, "d", 3), (1, 1, "g", 4)]


def test_row_locators_spread_rows_of_one_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = profiling.row_locators(spark.range(4000).withColumn("a", F.lit(1)), "t", ["a"], ["id"])
        per = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per) == 4000 and max(per) <= 2000
        assert sorted(r.row_index for r in found.collect()) == list(range(1, 4001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_locators_of_uneven_orders(spark):
    rows = [(i % 3, None if i % 50 == 0 else i, "x") for i in range(2000)] + [(0, None, "y")] * 3
    df = spark.createDataFrame(rows, "a int, b int, c string")
    found = sorted(r.row_index for r in profiling.row_locators(df.repartition(7), "t", ["a", "b"], ["a", "b", "c"]).collect())
    assert found == list(range(1, 2004))
    first, again = ({(r.row_index, r.row_hash) for r in profiling.row_locators(df.repartition(n), "t", ["a", "b"], ["a", "b", "c"]).collect()} for n in (2, 9))
    assert first == again
    assert profiling.row_locators(df.limit(0), "t", ["a"], ["b"]).collect() == []


def test_embedder(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = [r[0] for r in df.select(embedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], F.col("t"))).collect()]
    assert got[0] == [2.0, 1.0]


def test_titles_and_suffixes(spark):
    assert one(spark, T.title(F.lit("x\n # Head  \n## no"), F.lit("f")), T.title(F.lit("## no"), F.lit("f"))) == ("Head", "f")
    assert files.column_names(["A b", "", "a-B", None]) == ["a_b", "column_2", "a_b_2", "column_4"]
