import numpy as np
import pytest
from compare import same

from tarn.operators import retrieval
from tarn.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_citations_of_all_documents(spark, tmp_path):
    texts = [(0, "a", "x [c2] y [c1][c2] [d1]"), (1, " ", "[c30]"), (2, "a", "no mark [c]"), (3, "a", None), (4, None, "late " * 5000 + "[c7]")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.source, r.marks) for r in QUERIES["citations_extract"](spark, str(tmp_path)).collect()}
    assert rows == {0: ("a", ["c2", "c1"]), 1: (None, ["c30", "c1", "c3"]), 2: ("a", ["c2", "c3"]), 4: (None, ["c7", "c4", "c3"])}


def test_every_document_is_a_case_of_page_inference(spark, tmp_path):
    body = "".join(f"word{i} " for i in range(80))  # over 300 characters
    texts = [(0, body + "one"), (1, body + "two"), (2, body + "two"), (8, "Short  text"), (9, "more than the short text"), (13, body + "two"), (14, None), (15, " ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = {r.case_id: (r.page, r.score) for r in QUERIES["page_inference"](spark, str(tmp_path)).collect()}
    assert rows == {0: (0, 80), 1: (1, 80), 2: (1, 80), 8: (8, 80), 9: (9, 80), 13: (3, 80)}  # pages at most one apart tie


def test_query_vectors_grow_with_the_table_and_come_in_blocks(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1200, 8)).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    best = {i: sorted(range(1200), key=lambda j: (-scores[i, j], j))[:10] for i in range(0, 1200, 50)}
    pick = lambda rows: {(r.query_id, r.rank): r.vec_id for r in rows.collect()}
    want = {(i, n): j for i, js in best.items() for n, j in enumerate(js, 1)}
    assert pick(QUERIES["dense_topk"](spark, str(tmp_path))) == want
    asked = df.filter("vec_id % 50 = 0").select(df.vec_id.alias("query_id"), "embedding")
    assert pick(retrieval.dense_top(asked, df, 10, max_queries=7)) == want
    metrics = {r.query_id: (r.first_rank, r.average_precision) for r in QUERIES["hit_mrr_map"](spark, str(tmp_path)).collect()}
    for i, js in best.items():
        at = [n for n, j in enumerate(js, 1) if j % 7 == i % 7]
        expected = sum(j % 7 == i % 7 for j in range(1200))
        assert metrics.pop(i) == (min(at), round(sum(k / n for k, n in enumerate(at, 1)) / expected, 6))
    assert not metrics


def test_failure_buckets_take_fused_and_reranked_ranks(spark, tmp_path):
    from tarn.queries import Tables, _first_ranks

    # Case 5: BM25 has the gold document first; of vectors, only others have one.
    texts = [(i, "gamma beta alpha" + " filler" * 2000) for i in range(30)] + [(40, "alpha beta gamma")] + [(i, "alpha beta alpha beta") for i in range(50, 80)] + [(i, "other words") for i in range(100, 300)]
    vectors = [(i, [1.0, i / 1000], 0) for i in (0, 1, 5)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    docs = [(i, x, "en", "s", len(x)) for i, x in texts]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "alpha beta gamma"), (11, "absent")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {(r.case_id, r["mode"]) for r in _first_ranks(Tables(spark, str(tmp_path))).collect() if r.first_rank}
    assert got == {(5, "bm25"), (5, "hybrid"), (5, "rerank")}
    buckets = QUERIES["failure_buckets"](spark, str(tmp_path))
    assert {r.bucket: r.n for r in buckets.collect()} == {"dense_missed_bm25_hit": 1, "both_dense_and_hybrid_missed": 1}
    same(buckets, ORACLE_SQL["failure_buckets"], str(tmp_path))
