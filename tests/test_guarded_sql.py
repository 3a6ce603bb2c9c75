from concurrent.futures import ThreadPoolExecutor

import pytest

from tarn.plans import guarded_sql as G
from tarn.queries import ALLOWED, REFUSED

TABLE = G.TableContext("orders", {"o_orderkey": "bigint", "o_orderpriority": "string", "o_orderstatus": "string", "o_totalprice": "double"})


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    v = G.check(spark, G._counted(sql), TABLE)
    assert not v.ok and any(not passed for passed in v.checks.values())


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    assert G.check(spark, G._counted(sql), TABLE).reasons == []


def test_limit_is_capped(spark):
    assert G.check(spark, "SELECT o_orderkey FROM orders LIMIT 500", TABLE).limit == 100
    assert G.check(spark, "SELECT o_orderkey FROM orders", TABLE).limit == 100


@pytest.mark.parametrize(
    "question,sql",
    [
        ("count per o_orderpriority", "SELECT COUNT(*) AS row_count FROM orders"),
        ("average o_totalprice by o_orderpriority", "SELECT o_orderpriority, SUM(o_totalprice) AS sum_o_totalprice FROM orders GROUP BY o_orderpriority ORDER BY sum_o_totalprice DESC LIMIT 5"),
        ("highest o_totalprice", "SELECT MAX(o_totalprice) AS max_o_totalprice FROM orders"),
        ("top 3 o_totalprice", "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 3"),
        ("what is o_orderstatus", "SELECT o_orderstatus FROM orders LIMIT 1"),
    ],
)
def test_questions(question, sql):
    assert G.compile_question(question, TABLE) == sql


def test_extract_sql():
    assert G.extract_sql("Sure:\n```sql\nSELECT a FROM t; DROP x\n```") == "SELECT a FROM t"
    assert G.extract_sql("SQLQuery: SELECT b FROM t") == "SELECT b FROM t"
    assert G.extract_sql("no statement") is None


def test_identifiers():
    assert G.safe_identifiers(["Revenue ($)", "Revenue", "2020", "select", "größe"]) == {"Revenue ($)": "revenue", "Revenue": "revenue_2", "2020": "c_2020", "select": "select_col", "größe": "gru" + "f6" + "u" + "df" + "e"}


def test_answer(spark):
    df = spark.createDataFrame([(1, "a", "F", 2.0), (2, "b", "O", 5.0)], "o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double")
    outcome, sql, rows = G.answer(df, "total o_totalprice", TABLE)
    assert outcome == "executed" and rows[0][0] == 7.0
    assert G.answer(df, "hello", TABLE)[0] == "skipped_intent"
    assert G.answer(df, "total", TABLE, compiler=lambda q, t: "SELECT * FROM orders")[0] == "refused"
    assert G.answer(df, "total", TABLE, compiler=lambda q, t: None)[0] == "compile_failed"
    assert G.evidence("q", sql, rows, ["s"])["policy"] == "pinned"


def test_views_of_the_caller_stay(spark):
    spark.range(3).createOrReplaceTempView("orders")
    df = spark.createDataFrame([(1, "from orders", "F", 2.0), (2, "b", "O", 5.0)], "o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double")
    with ThreadPoolExecutor(4) as pool:
        runs = [pool.submit(G.run, df.filter(df.o_orderkey == i % 2 + 1), "SELECT orders.o_orderkey FROM `orders` WHERE o_orderpriority <> 'x from orders'", TABLE) for i in range(8)]
        assert [r.result().collect()[0][0] for r in runs] == [1, 2] * 4
    assert spark.table("orders").count() == 3 and not [t.name for t in spark.catalog.listTables() if t.name.startswith("guarded_")]
    spark.catalog.dropTempView("orders")


def test_a_statement_sees_nothing_of_the_caller(spark):
    spark.range(3).createTempView("secret")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    try:
        got = G.run(df, "SELECT k FROM t WHERE v = 'b'", G.TableContext("t", {"k": "int", "v": "string"}))
        assert [r.k for r in got.collect()] == [2]
        assert not got.sparkSession.catalog.tableExists("secret") and spark.catalog.tableExists("secret")
        assert not any(t.name.startswith("guarded_") for t in spark.catalog.listTables("global_temp"))
        with pytest.raises(ValueError, match="refused"):
            G.run(df, "SELECT id FROM secret", G.TableContext("t", {"k": "int"}))
    finally:
        spark.catalog.dropTempView("secret")


def test_typed_tables(spark):
    raw = spark.createDataFrame([("(1,200.50)", "12.9", "Yes", "é"), ("", "x", "0", ""), ("7%", None, "maybe", " a ")], "`Net $` string, `2020` string, ok string, note string")
    rows, table = G.typed_table(raw, "my table", {"Net $": "number", "2020": "INT", "ok": "boolean", "note": "string"})
    assert table.name == "my_table" and table.columns == {"net": "double", "c_2020": "bigint", "ok": "boolean", "note": "string"}
    assert [tuple(r) for r in rows.collect()] == [(-1200.5, 12, True, "é"), (None, None, False, None), (7.0, None, None, " a ")]


def test_plain_conditions(spark):
    assert G.plain_where("o_orderkey >= 3 AND o_orderstatus like 'F%'", TABLE) == [("o_orderkey", ">=", "3"), ("o_orderstatus", "like", "'F%'")]
    assert G.plain_where("", TABLE) == []
    for bad in ("o_orderkey = 1 or o_orderkey = 2", "o_comment = 'x'", "o_orderkey in (1)", "lower(o_orderstatus) = 'f'", "o_orderkey = o_totalprice"):
        with pytest.raises(ValueError):
            G.plain_where(bad, TABLE)
    df = spark.createDataFrame([(1, "F"), (2, "O"), (3, None)], "o_orderkey long, o_orderstatus string")
    assert [r[0] for r in G.filter_plain(df, "o_orderkey != 1 and o_orderstatus = 'O'", TABLE).collect()] == [2]
    assert G.filter_plain(df, "o_orderstatus = null", TABLE).count() == 0


def test_textual_check_and_ledger(spark):
    assert G.textual_check("SELECT a FROM t") == [] and G.textual_check("SELECT a FROM t WHERE b = 'x; drop -- y'") == []
    assert set(G.textual_check("DELETE FROM t; -- x")) == {"single_statement", "no_comments", "select_only", "no_forbidden_words"}
    v = G.check(spark, "SELECT upper(o_orderstatus) FROM orders", TABLE)
    assert set(v.checks) == set(G.CHECKS) and [c for c, ok in v.checks.items() if not ok] == ["allowed_functions"]


def test_tables_are_routed(spark):
    df = spark.createDataFrame([(1, "a", "F", 2.0)], "o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double")
    parts = spark.createDataFrame([(3, 4.0)], "p_size long, p_price double")
    tables = {"orders": (df, TABLE), "part": (parts, G.TableContext("part", {"p_size": "bigint", "p_price": "double"}))}
    assert G.answer_among(tables, "total p_price of part")[:2] == ("executed", "part")
    assert G.answer_among(tables, "hello")[0] == "skipped_intent" and G.answer_among({}, "total x")[0] == "no_table"
    assert G.answer_among(tables, "how many people live there")[0] == "no_table"
    assert G.answer_among({"a": (df, TABLE), "b": (df, TABLE)}, "total o_totalprice")[0] == "ambiguous_table"


def test_intents_and_texts():
    assert G.intent("How many rows?") == (True, "aggregate") and G.intent("top items") == (True, "ranking") and G.intent("hello") == (False, "none")
    assert G.result_text([(1, None), (2, "x")], ["a", "b"]) == "a: 1; b: None\na: 2; b: x"


def test_caps(spark):
    rows, truncated = G.fetch(spark.range(10), max_rows=3)
    assert len(rows) == 3 and truncated
    with pytest.raises(ValueError):
        G.fetch(spark.range(10), max_bytes=2)
