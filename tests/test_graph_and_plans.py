import pytest
from pyspark.sql import functions as F

from tarn.operators import graph, measures, verification
from tarn.plans import planning

EDGE = "source string, target string, edge_id string, confidence double"


def _edges(spark, *rows):
    return spark.createDataFrame(list(rows), EDGE)


def test_direct_and_two_hop_paths(spark):
    e = _edges(spark, ("a", "b", "1", 0.9), ("b", "c", "2", 0.5), ("a", "c", "3", 0.1), ("c", "d", "4", 1.0))
    pairs = spark.createDataFrame([("a", "c")], "start string, goal string")
    rows = graph.paths(pairs, e).orderBy("rank").collect()
    assert [(r.hops, r.mid, r.score) for r in rows] == [(1, None, 0.1), (2, "b", pytest.approx(0.7))]


def test_most_paths_are_kept_after_ranking(spark):
    e = _edges(spark, *[("a", f"m{i}", f"x{i}", i / 10) for i in range(5)], *[(f"m{i}", "z", f"y{i}", i / 10) for i in range(5)])
    rows = graph.paths(spark.createDataFrame([("a", "z")], "start string, goal string"), e, most=2).orderBy("rank").collect()
    assert [r.mid for r in rows] == ["m4", "m3"]


def test_degree_cap(spark):
    e = _edges(spark, *[("h", f"n{i:02}", f"e{i:02}", 0.5) for i in range(30)])
    rows = graph.neighbours(spark.createDataFrame([("h",)], "node string"), e).collect()
    assert len(rows) == 25 and all(r.truncated and r.degree == 30 for r in rows) and max(r.other for r in rows) == "n24"
    assert [r.node for r in graph.hubs(e).collect()] == ["h"]


def test_neighbours_of_a_type(spark):
    e = _edges(spark, ("a", "b", "1", 1.0), ("a", "c", "2", 1.0))
    kinds = spark.createDataFrame([("b", "x"), ("c", "y")], "node string, type string")
    assert [r.other for r in graph.neighbours(spark.createDataFrame([("a",)], "node string"), e, type_of=kinds, wanted="y").collect()] == ["c"]


def test_entities(spark):
    names = spark.createDataFrame([(1, "Große AG", ["grosse"]), (2, "Other", ["og"])], "entity_id int, name string, aliases array<string>")
    terms = spark.createDataFrame([("grosse ag",), ("OG",), ("oth",), ("",)], "term string")
    rows = {(r.term, r.entity_id): r.score for r in graph.resolve_entities(terms, names).collect()}
    assert rows[("grosse ag", 1)] == 1.0 and rows[("OG", 2)] == 0.95 and rows[("oth", 2)] == 0.75 and ("", 1) not in rows


def test_first_cascade_wins(spark):
    a = spark.createDataFrame([(1, "x")], "query_id int, e string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "query_id int, e string")
    assert {(r.query_id, r.e) for r in graph.first_resolved(a, b).collect()} == {(1, "x"), (2, "z")}


def test_verdicts(spark):
    ev = spark.createDataFrame([(1, "e1", "alpha beta"), (1, "e2", "alpha"), (2, "e3", "none"), (3, "e4", "free")], "query_id int, evidence_id string, text string")
    an = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "x")], "query_id int, anchor string")
    rows = {r.query_id: r.verdict for r in verification.evidence_verdict(verification.anchor_support(ev, an)).collect()}
    assert rows == {1: "supported", 2: "insufficient", 3: "supported"}


def test_conflicts_need_single_numbers(spark):
    rows = [(1, 1, "it was 5%", "full"), (1, 2, "it was 7%", "full"), (2, 1, "1 and 2", "full"), (2, 2, "3", "full"), (3, 1, "5%", "full"), (3, 2, "7%", "partial")]
    ev = spark.createDataFrame(rows, "query_id int, rank int, text string, support string")
    conflicts = verification.numeric_conflicts(ev)
    assert {r.query_id: r.conflict for r in conflicts.collect()} == {1: True, 2: False, 3: False}
    verdicts = verification.evidence_verdict(ev.select("query_id", "support"), conflicts)
    assert {r.query_id: r.verdict for r in verdicts.collect()} == {1: "contradicted", 2: "supported", 3: "supported"}


def test_citation_metadata(spark):
    kind = "query_id int, citation_id string, document_id string, chunk_id string, page_start int, page_end int"
    ev = spark.createDataFrame([(1, "c1", "d", "k", 3, None)], kind)
    said = spark.createDataFrame([("a", 1, " C1 ", "d", "k", 3, None), ("b", 1, "c1", "e", "k", 4, 5), ("c", 1, "c9", "e", None, None, None)], "answer_id string, " + kind)
    assert [(r.answer_id, r.mismatches) for r in verification.citation_metadata(said, ev).collect()] == [("b", ["document_id", "page_start", "page_end"])]


def test_citations_are_checked(spark):
    ev = spark.createDataFrame([(1, "c1", "grew 5 units")], "query_id int, citation_id string, text string")
    an = spark.createDataFrame([("a", 1, "5 [c1]"), ("b", 1, "6 [c1]"), ("c", 1, "x [c9]"), ("d", 1, "x")], "answer_id string, query_id int, text string")
    rows = {r.answer_id: r.status for r in verification.citation_check(an, ev).collect()}
    assert rows == {"a": "supported", "b": "warning", "c": "unsupported", "d": "unsupported"}


def test_coverage_uses_aliases(spark):
    wanted = spark.createDataFrame([(1, "metric", "net_sales"), (1, "metric", "ebit")], "query_id int, kind string, value string")
    row = verification.coverage(wanted, spark.createDataFrame([(1, "Net sale of")], "query_id int, text string")).first()
    assert row.covered == ["net_sales"] and row.missing == ["ebit"]


def test_longest_metric_alias(spark):
    q = spark.createDataFrame([(1, "operating cash flow and capex"), (2, "cash")], "query_id int, text string")
    rows = {(r.query_id, r.metric) for r in planning.metric_mentions(q, planning.ontology(spark)).collect()}
    assert rows == {(1, "operating_cash_flow"), (1, "capital_expenditure")}  # no metric is named "cash" alone
    q = spark.createDataFrame([(1, "R&D, total assets and EPS; the salesman's cash_equivalents")], "query_id int, text string")
    rows = planning.metric_mentions(q, planning.ontology(spark)).orderBy("rank").collect()
    assert [(r.metric, r.alias) for r in rows] == [("cash_and_cash_equivalents", "cash equivalents"), ("total_assets", "total assets"), ("eps", "eps"), ("r_and_d_expense", "r&d")]


def test_metrics_are_read_and_canonical(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("a_b:\n  aliases: [Alpha, beta rate]\nc:\n  canonical_name: see\n  aliases: []\n")
    metrics = planning.read_metrics(spark, str(tmp_path / "m.yaml"))
    assert metrics == {"a_b": ("Alpha", "beta rate"), "see": ()} and len(planning.METRICS) == 17
    terms = spark.createDataFrame([("ALPHA",), ("Beta_rate",), ("a b",), ("x",)], "term string")
    assert {(r.term, r.metric) for r in planning.canonical_metric(planning.ontology(spark, metrics), terms).collect()} == {("ALPHA", "a_b"), ("Beta_rate", "a_b"), ("a b", "a_b")}


def test_plan_units(spark):
    q = spark.createDataFrame([(1, "revenue in 2020")], "query_id int, text string")
    units = planning.plan_units(q, planning.metric_mentions(q, planning.ontology(spark))).orderBy("unit_id").collect()
    assert [(u.purpose, u.weight) for u in units] == [("original", 1.0), ("metric_alias", 1.5), ("period_anchor", 1.2)]
    assert units[1].lane_weights == {"bm25": 1.2, "metric_alias": 1.5}


def test_plan_grounding(spark):
    plans = spark.createDataFrame([(1, "sales of ACME", ["acme"], [], ["sales"], [1.0]), (2, "x", ["acme"], ["2020"], [], [-1.0])], "query_id int, text string, entities array<string>, periods array<string>, terms array<string>, weights array<double>")
    rows = {r.query_id: r.reasons for r in planning.validate_plan(plans).collect()}
    assert rows == {1: [], 2: ["ungrounded_entities", "ungrounded_periods", "negative_weight"]}


def test_router_isolates_failures(spark):
    def good(tasks):
        return tasks.select("task_id")

    def bad(tasks):
        raise RuntimeError("down")

    tasks = spark.createDataFrame([("t1", "good", "ready"), ("t2", "bad", "ready"), ("t3", "good", "skipped_non_executable")], "task_id string, provider string, status string")
    rows, status = planning.Router({"good": good, "bad": bad}).run(tasks)
    assert [r.task_id for r in rows.collect()] == ["t1"] and status == {"good": "planned", "bad": "failed: RuntimeError"}


def test_cache_keys():
    key = planning.cache_key(" What  is X?", {"top_k": 3, "request_id": "a"})
    assert key == planning.cache_key("what is x?", {"request_id": "b", "top_k": 3}) != planning.cache_key("what is x?", {"top_k": 4})
    assert [planning.cache_policy(o) for o in (None, "bypass", "off", "on")] == ["enabled", "bypassed", "disabled", "enabled"]


def test_hits_are_monotone(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 4), (2, "c", 2)], "query_id int, item string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "z"), (2, "c"), (3, "q")], "query_id int, item string")
    rows = {r.query_id: r for r in measures.retrieval_metrics(ranked, relevant, spark.createDataFrame([(1,), (2,), (3,)], "query_id int")).collect()}
    assert (rows[1].reciprocal_rank, rows[1].average_precision) == (0.25, 0.125)
    assert rows[2].average_precision == 0.5 and rows[3].first_rank is None
    assert all(not r.hit_1 or r.hit_3 for r in rows.values())


def test_status_rollup(spark):
    rows = spark.createDataFrame([(1, "executed"), (1, "failed"), (2, "executed"), (2, "empty"), (3, "skipped"), (4, "failed")], "query_id int, status string")
    assert {r.query_id: r.status for r in measures.rollup_status(rows).collect()} == {1: "partial", 2: "executed", 3: "skipped", 4: "failed"}


def test_rates_ignore_nulls(spark):
    df = spark.createDataFrame([(True,), (None,), (False,)], "x boolean")
    assert df.select(measures.rate(F.col("x"))).first()[0] == 0.5
    assert df.filter("x IS NULL").select(measures.rate(F.col("x"))).first()[0] is None


def test_degrees_read_edges_once(spark):
    edges = spark.range(10).selectExpr("id % 3 AS source", "id % 4 AS target", "cast(id AS string) AS edge_id", "1.0D AS confidence")
    found = graph.degrees(edges)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    pairs = [(i % 3, i % 4) for i in range(10)]
    want = {n: sum((s == n) + (t == n and s != t) for s, t in pairs) for n in range(4)}
    assert {r.node: r.degree for r in found.collect()} == want
