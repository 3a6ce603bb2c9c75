import random
import re

import pytest
from pyspark.sql import functions as F

from tarn.operators import packing


def _pack(spark, texts, budget, blocks, truncate=True):
    df = spark.createDataFrame([(1, i, i + 1, t) for i, t in enumerate(texts)], "query_id int, block_id int, rank int, text string")
    return packing.pack(df, budget, blocks, truncate).orderBy("rank").collect()


def test_no_budget_drops_all(spark):
    assert [r.drop_reason for r in _pack(spark, ["a b", "c"], 0, 5)] == ["token_budget"] * 2


def test_last_block_is_cut(spark):
    rows = _pack(spark, ["a b c", "d e f g", "h"], 5, 5)
    assert rows[0].tokens == 3 and rows[1].included and rows[1].tokens <= 2
    assert sum(r.tokens for r in rows) <= 5


def test_skipping_lets_smaller_blocks_in(spark):
    rows = _pack(spark, ["a b c", "d e f g", "h"], 4, 5, truncate=False)
    assert [r.included for r in rows] == [True, False, True] and rows[1].drop_reason == "token_budget"


def test_block_cap(spark):
    assert [r.drop_reason for r in _pack(spark, ["a", "b", "c"], 10, 2)] == [None, None, "max_blocks"]


def _tokens(text: str) -> int:
    return max(1, sum(len(re.findall(p, text)) for p in ("[一-鿿]", r"[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)?", r"[^\w\s]")))


def _cut(text: str, budget: int) -> str:
    """The cut in plain Python."""
    if budget <= 0:
        return ""
    if _tokens(text) <= budget:
        return text
    limit = max(1, len(text) * budget // _tokens(text))
    while True:
        cut, limit = text[:limit].rstrip(), max(1, limit * 4 // 5)
        if not cut or cut == text[:limit].rstrip() or _tokens(cut) <= budget:
            return cut


CASES = [
    ("a b c d", 9, "a b c d"), ("a b c d", 0, ""), ("", 0, ""), ("", 3, ""),
    ("a b c d", 2, "a b"),  # 7 * 2 / 4 = 3 characters
    ("word " * 4, 2, "word word"),  # 20 * 2 / 4 = 10 characters
    ("long-word a . . . .", 2, "long-"),  # 19 * 2 / 7 = 5 characters; a word and a mark
    ("a.b.c.d.                ", 3, "a.b"),  # 9, 7, 5, 4 and 3 characters
    ("...." + " " * 40 + "x" * 4, 3, "...."),  # 28 and 22 characters: the same four marks
]


def _native(spark, rows):
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "i int, t string, b int")
    return [r[0] for r in df.orderBy("i").select(packing.truncated(F.col("t"), packing.tokens_of(F.col("t")), F.col("b"))).collect()]


def test_truncated(spark):
    assert _native(spark, [(t, b) for t, b, _ in CASES]) == [cut for *_, cut in CASES] == [_cut(t, b) for t, b, _ in CASES]


def test_truncated_is_plain_pythons(spark):
    r = random.Random(4)
    letters = ["a", "b", "-", "'", ".", " ", " ", "\n", "\u00a0", "\u2003", "漢", "é", "7", "_", "😀", "\u0301", "\x1c", "$"]
    rows = [("".join(r.choice(letters) for _ in range(r.randint(0, 120))), r.randint(-1, 25)) for _ in range(1500)] + [("word, " * 5000, 7), ("x" * 50_000 + " y", 1), (" " * 3000 + "x y z", 2)]
    assert _native(spark, rows) == [_cut(t, b) for t, b in rows]


@pytest.mark.parametrize("truncate", [True, False])
def test_packing_is_plain_pythons(spark, truncate):
    r = random.Random(8)
    rows = [(q, i, r.choice([1, 2, 3, 4, 5]), r.choice([None, "", " "]) if r.random() < 0.15 else " ".join(r.choice(["word", "x.", "漢", "a-b"]) for _ in range(r.randint(1, 30)))) for q in range(40) for i in range(r.randint(1, 12))]
    want = []
    for q in range(40):
        left, used = 60, 0
        for _, i, rank, text in sorted((x for x in rows if x[0] == q), key=lambda x: (x[2], x[1])):
            n, reason, out = _tokens(text or ""), None, text
            if used >= 4:
                reason = "max_blocks"
            elif n > left:
                out = _cut(text or "", left) if truncate else ""
                n, reason = (_tokens(out), None) if out else (0, "token_budget")
            if reason is None:
                used, left = used + 1, left - n
            want.append((q, i, rank, 0 if reason else n, reason is None, reason, None if reason else out))
    packed = packing.pack(spark.createDataFrame(rows, "query_id int, block_id int, rank int, text string"), 60, 4, truncate)
    assert sorted(map(str, map(tuple, packed.collect()))) == sorted(map(str, want))
    assert "Python" not in packed._jdf.queryExecution().toString() and "Pandas" not in packed._jdf.queryExecution().toString()
