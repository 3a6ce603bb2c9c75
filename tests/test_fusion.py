import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.operators import fusion

HIT = "query_id int, chunk_id string, lane string, rank int, lane_weight double, unit_weight double"


def test_weights_and_contributions(spark):
    hits = [(1, "a", "dense", 1, 1.0, 1.0), (1, "b", "dense", 2, 1.0, 1.0), (1, "b", "table", 1, 1.5, 2.0)]
    rows = {r.chunk_id: r for r in fusion.weighted_rrf(spark.createDataFrame(hits, HIT), k=0).collect()}
    assert rows["b"].score == pytest.approx(3.5) and rows["b"].rank == 1 and rows["b"].contributions == 2
    assert rows["a"].score == pytest.approx(1.0) and rows["a"].rank == 2


def test_one_hit_at_k_60(spark):
    row = fusion.weighted_rrf(spark.createDataFrame([(1, "a", "dense", 1, 1.0, 1.0)], HIT)).first()
    assert row.score == pytest.approx(1 / 61, abs=1e-9)


def test_bad_weights(spark):
    with pytest.raises(ValueError):
        fusion.weighted_rrf(spark.createDataFrame([], HIT), k=-1)
    with pytest.raises(Exception, match="negative"):
        fusion.weighted_rrf(spark.createDataFrame([(1, "a", "dense", 1, -1.0, 1.0)], HIT)).collect()


def test_ties_go_by_lane_rank_then_id(spark):
    hits = [(1, c, "dense", 1, 1.0, 1.0) for c in "cab"]
    assert [r.chunk_id for r in fusion.weighted_rrf(spark.createDataFrame(hits, HIT)).orderBy("rank").collect()] == ["a", "b", "c"]


def test_bands(spark):
    rows = [(1, "a", None, "ranked", 1.0, 1.0, 1), (1, "b", None, "pinned", 1.0, 1.0, 9), (1, None, "p", "supporting", 1.0, 1.0, 1), (1, "c", None, "ranked", 1.0, 1.0, 2), (1, None, None, "ranked", 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, parent_id string, policy string, unit_weight double, lane_weight double, local_rank int")
    assert [(r.item, r.policy) for r in fusion.fuse_providers(df, 1).orderBy("rank").collect()] == [("b", "pinned"), ("a", "ranked"), ("p", "supporting")]


@settings(max_examples=5, deadline=None)
@given(st.permutations(list(range(8))))
def test_order_of_hits_does_not_matter(spark, order):
    hits = [(1, f"c{i % 3}", ("dense", "bm25")[i % 2], i + 1, 1.0, 1.0) for i in range(8)]
    found = lambda xs: fusion.weighted_rrf(spark.createDataFrame(xs, HIT)).orderBy("rank").collect()
    assert found([hits[i] for i in order]) == found(hits)
