import json

import pytest
from pyspark.sql import functions as F

from tarn.operators import candidates, traces
from tarn.plans.registry import Registry, planned, scorer
from tarn.sources import datasets, graph_fixture

RUN = {
    "query_id": "q1", "question": "x", "status": "executed", "latency_ms": 5.0, "plan": {"plan_id": "p", "units": [{"unit_id": "u0", "purpose": "original", "text": "x"}]},
    "tasks": [{"task_id": "t1", "unit_id": "u0", "provider": "hybrid", "status": "ready"}], "candidates": [{"chunk_id": "c1", "lane": "bm25", "rank": 1, "score": 2.0}, {"chunk_id": "c2", "lane": "dense", "rank": 1, "score": 1.0}],
    "blocks": [], "answer": {"text": "y", "confidence": "supported"}, "citations": [{"citation_id": "c1", "block_id": "b"}], "stages": [{"stage": "plan", "latency_ms": 1.0}],
}


def test_traces_flatten_and_come_back(spark):
    runs = traces.parse(spark.createDataFrame([(json.dumps(RUN),), ("broken",)], "value string"))
    tables = traces.flatten(runs)
    assert {n: df.count() for n, df in tables.items()} == {"runs": 1, "answers": 1, "units": 1, "tasks": 1, "candidates": 2, "blocks": 0, "citations": 1, "stages": 1}
    record = traces.fetch(tables, spark.createDataFrame([("q1",), ("q2",)], "query_id string")).collect()
    assert len(record) == 1 and [c.chunk_id for c in record[0].candidates] == ["c1", "c2"] and record[0].blocks is None
    stages = traces.stage_table(tables["stages"], tables["runs"]).orderBy("position").collect()
    assert [s.stage for s in stages] == list(traces.STAGES) and stages[0].latency_ms == 1.0 and stages[1].latency_ms == 0.0
    assert all(df.count() == 0 for df in traces.reset(tables).values())


def test_reasons_and_report(spark):
    cases = spark.createDataFrame([(1, True, 1.0, "a", "a", None), (2, False, 0.5, "a", "b", "boom")], "case_id int, hit boolean, keyword_share double, confidence string, expected_confidence string, error string")
    rows = {r.case_id: r.reasons for r in traces.failure_reasons(cases).collect()}
    assert rows == {1: [], 2: ["error", "source_missed", "keywords_missed", "confidence_differs"]}
    assert traces.markdown(spark.createDataFrame([("m", 1)], "mode string, n int"), "mode").splitlines()[-1] == "| m | 1 |"
    three = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "mode string, n int")
    assert traces.markdown(three, "mode", most=2).splitlines()[-2:] == ["| b | 2 |", "Only the first 2 rows are shown."]


def test_results_become_candidates(spark):
    cands = spark.createDataFrame([(1, "a", 3)], "query_id int, chunk_id string, dense_rank int")
    ev = spark.createDataFrame([(1, "x", 1), (2, "y", 4)], "query_id int, chunk_id string, rank int")
    rows = {(r.query_id, r.chunk_id): r.local_rank for r in candidates.from_results(cands, ev, "graph").collect()}
    assert rows == {(1, "a"): 3, (2, "y"): 4}


def test_metadata_policies(spark):
    df = spark.createDataFrame([({"a": "", "b": "1"}, {"a": "2", "b": "3", "text": "t"})], "x map<string,string>, y map<string,string>")
    r = df.select(candidates.merge_first(F.col("x"), F.col("y")).alias("f"), candidates.merge_last(F.col("x"), F.col("y")).alias("l"), candidates.safe_metadata(F.col("y")).alias("s")).first()
    assert r.f == {"a": "2", "b": "1", "text": "t"} and r.l == {"a": "2", "b": "3", "text": "t"} and "text" not in r.s
    rows = spark.createDataFrame([(1, {"k": "a"}), (1, {"k": "b", "z": ""})], "id int, metadata map<string,string>")
    assert candidates.merge_lists(rows, ["id"]).first().metadata == {"k": ["a", "b"]}


def test_parent_traces(spark):
    c = spark.createDataFrame([(1, "p", "c1", 2, 0.5), (1, "p", "c2", 1, 0.4)], "query_id int, parent_id string, chunk_id string, final_rank int, rerank_score double")
    c = candidates.with_missing(c, {"rerank_rank": "int", "fusion_rank": "int", "fusion_score": "double", "dense_score": "double", "lexical_score": "double"})
    lanes = spark.createDataFrame([(1, "c1", "dense", 1), (1, "c2", "dense", 1), (1, "c2", "bm25", 2)], "query_id int, chunk_id string, lane string, rank int")
    row = candidates.parent_traces(c, lanes).first()
    assert (row.best_child, row.score, len(row.lanes)) == ("c2", 0.5, 2)


def test_task_context_by_either_key(spark):
    c = spark.createDataFrame([(1, "t1", "u9"), (1, None, "u2"), (1, "t7", "u7")], "query_id int, task_id string, unit_id string")
    t = spark.createDataFrame([(1, "t1", "u1", "a"), (1, "t2", "u2", "b")], "query_id int, task_id string, unit_id string, purpose string")
    assert sorted(str(r.purpose) for r in candidates.task_context(c, t).collect()) == ["None", "a", "b"]


def _graph(**changes):
    anchor = [{"anchor_id": "a1", "chunk_id": "c1", "text_span": "x"}]
    g = {
        "schema_version": graph_fixture.VERSION, "graph_version": "g1", "entities": [{"entity_id": "e1", "canonical_name": "One", "metadata": {"hub": "true"}, "anchors": anchor}, {"entity_id": "e2", "canonical_name": "Two", "anchors": []}],
        "relationships": [{"relationship_id": "r1", "source_entity_id": "e1", "target_entity_id": "e2", "confidence": 0.5, "anchors": []}], "communities": [],
    }
    return g | changes


def test_graph_files(spark, tmp_path):
    chunks = spark.createDataFrame([("c1",)], "chunk_id string")

    def load(graph):
        (tmp_path / "g.json").write_text(json.dumps(graph))
        return graph_fixture.load(spark, str(tmp_path / "g.json"))

    out = f"file://{tmp_path}/store"
    assert graph_fixture.store(*load(_graph()), out, chunks) == "loaded"
    assert graph_fixture.store(*load(_graph()), out, chunks) == "unchanged"
    other = _graph(corpus_version="2")
    with pytest.raises(graph_fixture.GraphError, match="another graph"):
        graph_fixture.store(*load(other), out, chunks)
    assert graph_fixture.store(*load(other), out, chunks, replace=True) == "replaced"
    with pytest.raises(graph_fixture.GraphError, match="unknown keys"):
        load(_graph(colour=1))
    with pytest.raises(graph_fixture.GraphError, match="version"):
        load(_graph(schema_version="9"))
    bad = _graph(relationships=[{"relationship_id": "r1", "source_entity_id": "e1", "target_entity_id": "zz", "confidence": 0.5, "anchors": []}])
    with pytest.raises(graph_fixture.GraphError, match="unknown target_entity_id r1"):
        graph_fixture.store(*load(bad), out, chunks)
    with pytest.raises(graph_fixture.GraphError, match="missing chunk a1"):
        graph_fixture.store(*load(_graph()), out, chunks.filter("false"))


def test_pages(spark):
    pages = spark.createDataFrame([("d", 1, "alpha beta"), ("d", 2, "alpha beta gamma"), ("d", 3, "other")], "doc_id string, page int, text string")
    cases = spark.createDataFrame([(1, "d", None, "alpha beta", 9), (2, "d", "ALPHA  beta gamma", "x", None), (3, "d", None, "nothing", 1)], "case_id int, doc_id string, full_page string, evidence string, raw_page int")
    rows = {r.case_id: (r.page, r.score) for r in datasets.infer_pages(cases, pages).collect()}
    assert rows == {1: (1, 80), 2: (2, 100)}
    found = spark.createDataFrame([(0,)], "p int").select(datasets.page_candidates(F.col("p"), F.lit("ambiguous")), datasets.pages_in(F.lit("pp. 12-14, 20"))).first()
    assert found[0] == [0, 1] and found[1] == [12, 14, 20]


def test_cases_are_built(spark):
    docs = spark.createDataFrame([("d1", "Annual Report.pdf")], "doc_id string, doc_name string")
    pages = spark.createDataFrame([("d1", 4, "sales grew")], "doc_id string, page int, text string")
    rows = spark.createDataFrame([(1, "annual_report.PDF", "q?", None, "sales grew", 3), (2, "none", "q?", None, "x", 7)], "case_id int, doc_name string, question string, full_page string, evidence string, raw_page int")
    found = {r.case_id: (r.doc_id, r.page) for r in datasets.build_cases(rows, docs, pages).collect()}
    assert found == {1: ("d1", 4), 2: (None, 7)}


def test_yaml(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("- id: a\n  question: q\n")
    assert datasets.read_yaml(spark, str(tmp_path / "c.yaml")) == [{"id": "a", "question": "q"}]


def test_registry(spark):
    r = Registry()
    r.add("reranker", "length", lambda pairs: [float(len(t)) for _, t in pairs])
    df = spark.createDataFrame([("q", "abc"), ("q", None)], "q string, t string")
    assert [x[0] for x in df.select(scorer(lambda: r.get("reranker", "length"), F.col("q"), F.col("t"))).collect()] == [3.0, 0.0]
    with pytest.raises(KeyError, match="length"):
        r.get("reranker", "other")
    with pytest.raises(KeyError):
        r.add("nonsense", "a", 1)


def test_planner_retries():
    tries = []

    def model(prompt):
        tries.append(prompt)
        return {"n": len(tries)}

    assert planned(model, lambda p: [] if p["n"] == 2 else ["bad"], "q") == {"n": 2} and "bad" in tries[1]
    assert planned(model, lambda p: ["bad"], "q") is None
