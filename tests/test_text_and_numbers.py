import pytest
from pyspark.sql import functions as F

from tarn.functions import numbers as N
from tarn.functions import text as T


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s"))).first()[0]


@pytest.mark.parametrize("text,n", [("", 1), ("a b, c", 4), ("你好 world", 3), ("it's well-known", 4), ("é", 1), (None, 1)])
def test_token_count(spark, text, n):
    assert _one(spark, text, T.token_count) == n


@pytest.mark.parametrize("text,lang", [("", "zh"), ("hello", "en"), ("你好 a", "zh"), ("你 a b", "en")])
def test_language(spark, text, lang):
    assert _one(spark, text, T.language) == lang


def test_phrases_touch_no_letters(spark):
    rows = spark.createDataFrame([("operating cash flow", "cash"), ("cashier", "cash"), ("a (cash)", "cash"), ("c++ is", "c++")], "t string, p string")
    assert [r[0] for r in rows.select(T.has_phrase(F.col("t"), F.col("p"))).collect()] == [True, False, True, True]


@pytest.mark.parametrize("text,q", [("Q3 2020", "Q3"), ("the third quarter", "Q3"), ("3Q", "Q3"), ("in the 3rd Quarter", "Q3"), ("1st quarter", "Q1"), ("year", None)])
def test_quarter(spark, text, q):
    assert _one(spark, text, T.quarter) == q


def test_citations(spark):
    assert _one(spark, "x [c2] y [c1][c2] [d1]", T.citations) == ["c2", "c1"]
    assert _one(spark, "x [C2] y [c1][c2]", lambda t: T.citations(t, any_case=True)) == ["c2", "c1"]


def test_folding_of_every_letter(spark):
    letters = [c for c in map(chr, range(0x20000)) if c.casefold() != c]
    rows = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(letters)], "i int, t string")
    got = {r.i: r.f for r in rows.select("i", T.folded(F.col("t")).alias("f")).collect()}
    assert {c: got[i] for i, c in enumerate(letters) if got[i] != f"x{c.casefold()}y"} == {}


@pytest.mark.parametrize("text,n", [("1,234.5", 1234.5), ("(3)", -3.0), ("$5", 5.0), ("5%", 5.0), ("—", None), ("x", None), ("1_0", None), ("inf", None)])
def test_parse_number(spark, text, n):
    assert _one(spark, text, N.parse_number) == n


def test_numbers_in_text(spark):
    found = _one(spark, "rose 5% to $(1.5) and 3 million", N.extract_numbers)
    assert [(r.value, r.scaled, r.unit) for r in found] == [(5.0, 5.0, "%"), (1.5, 1.5, ""), (3.0, 3e6, "")] or [(r.value, r.scaled) for r in found][2] == (3.0, 3e6)


def test_numbers_match(spark):
    rows = spark.createDataFrame([(0.05, "5%"), (3e6, "3 million"), (3.0, "3 million"), (7.0, "8")], "e double, t string")
    assert [r[0] for r in rows.select(N.numbers_match(F.col("e"), N.extract_numbers(F.col("t")))).collect()] == [True, True, True, False]


@pytest.mark.parametrize("text,day", [("2024-02-29", "2024-02-29"), ("02/03/2020", "2020-02-03"), ("2020", "2020-01-01"), ("2020-13-01", None), ("x", None)])
def test_parse_date(spark, text, day):
    found = _one(spark, text, N.parse_date)
    assert (str(found) if found else None) == day
