"""Fusing ranked lanes: weighted reciprocal ranks within and across providers, merging candidates, bands, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import normal_term, token_set

RRF_K = 60
LAST = 1_000_000_000
#: Weights of lanes that have none of their own.
LANE_WEIGHTS = {"dense": 1.0, "bm25": 1.1, "metric_alias": 1.6, "table": 1.4}
BANDS = {"pinned": 0, "ranked": 1, "supporting": 2}


def checked_weight(w: Column) -> Column:
    return F.when(w < 0, F.raise_error(F.lit("a fusion weight is negative"))).otherwise(F.coalesce(w, F.lit(1.0)))


def weighted_rrf(hits: DataFrame, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, contributions, dense_rank, lexical_rank, rank) for hits with lane and rank.

    Optional columns lane_weight, unit_weight and candidate_weight multiply; a lane that two tasks ran counts twice.
    Ties: lane rank of the best contribution, then dense rank, lexical rank, id. One aggregate with map-side sums.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    weight = F.lit(1.0)
    for name in ("lane_weight", "unit_weight", "candidate_weight"):
        if name in hits.columns:
            weight = weight * checked_weight(F.col(name))
    part = hits.withColumn("part", weight / (k + F.col("rank")))
    fused = part.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("part"), 9).alias("score"),
        F.count("*").alias("contributions"),
        F.max(F.struct(F.round("part", 9).alias("part"), (-F.col("rank")).alias("neg"))).alias("best"),
        F.min(F.when(F.col("lane") == "dense", F.col("rank"))).alias("dense_rank"),
        F.min(F.when(F.col("lane") == "bm25", F.col("rank"))).alias("lexical_rank"),
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), (-F.col("best.neg")).asc(), F.coalesce("dense_rank", F.lit(LAST)).asc(), F.coalesce("lexical_rank", F.lit(LAST)).asc(), F.col("chunk_id").asc()
    )
    ranked = fused.withColumn("rank", F.row_number().over(order)).drop("best")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def local_rank(*ranks: str) -> Column:
    """A provider's own rank of a candidate: the first of the given rank columns that is there."""
    return F.coalesce(*[F.col(r) for r in ranks])


def fuse_providers(candidates: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """(query_id, item, policy, score, rank): ranks of providers are fused, then bands are put in order.

    candidates: query_id, chunk_id, parent_id, policy, unit_weight, lane_weight, local_rank. The item is the chunk, else
    its parent. Pinned items come first, then the ``limit`` best ranked ones, then supporting ones.
    """
    keyed = candidates.withColumn("item", F.coalesce("chunk_id", "parent_id")).filter("item IS NOT NULL")
    part = checked_weight(F.col("unit_weight")) * checked_weight(F.col("lane_weight")) / (k + F.col("local_rank"))
    band = F.coalesce(F.create_map(*[F.lit(x) for p in BANDS.items() for x in p])[F.col("policy")], F.lit(1))
    fused = keyed.groupBy("query_id", "item").agg(F.round(F.sum(part), 9).alias("score"), F.min(band).alias("band"), F.min("local_rank").alias("first"))
    inside = Window.partitionBy("query_id", "band").orderBy(F.col("score").desc(), F.col("first").asc(), F.col("item").asc())
    kept = fused.withColumn("at", F.row_number().over(inside)).filter((F.col("band") != 1) | (F.col("at") <= limit))
    whole = Window.partitionBy("query_id").orderBy("band", "at")
    policy = F.element_at(F.array(*[F.lit(x) for x in BANDS]), F.col("band") + 1)
    return kept.select("query_id", "item", policy.alias("policy"), "score", F.row_number().over(whole).alias("rank"))


def merge_candidates(hits: DataFrame) -> DataFrame:
    """One row per query and chunk of lane hits (lane, rank, score): sources, best rank, best score, first lane."""
    return hits.groupBy("query_id", "chunk_id").agg(
        F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("sources"),
        F.min("rank").alias("best_rank"),
        F.max("score").alias("best_score"),
        F.min_by("lane", F.struct("rank", "lane")).alias("first_lane"),
    )


def lane_attribution(hits: DataFrame) -> DataFrame:
    """Distinct (lane, task, unit, rank) of each query and chunk, as one list in that order."""
    one = F.struct("lane", "task_id", "unit_id", "rank")
    return hits.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set(one)).alias("lanes"))


def best_per_group(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order; the group limit is applied before the shuffle too."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_n = 1").drop("_n")


def lexical_rerank_score(query: Column, text: Column, entities: Column, periods: Column, metrics: Column, noise: Column) -> Column:
    """0.25 overlap + entity + 0.55 periods + 1.4 metric - noise, each a share or a flag."""
    q, t = token_set(query), token_set(text)
    shared = F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))
    low = F.lower(text)
    flag = lambda xs: F.exists(xs, lambda x: low.contains(F.lower(x))).cast("int")
    share = F.when(F.size(periods) > 0, F.size(F.filter(periods, lambda x: low.contains(F.lower(x)))) / F.size(periods)).otherwise(F.lit(0.0))
    return F.round(0.25 * shared + flag(entities) + 0.55 * share + 1.4 * flag(metrics) - noise, 6)


#: Words that the token sets of lane scores leave out.
LANE_STOP_WORDS = ("the", "and", "for", "what", "were", "was", "did", "than", "how", "much")


def lane_scores(pairs: DataFrame, boost_must: bool = False) -> DataFrame:
    """The given pairs with columns dense, bm25, metric_alias and table: the deterministic lane scores of a unit against a text.

    pairs: unit_text, sparse_text, must, should, aliases, periods (arrays), entity, metric, and text, company, metrics (array).
    Each score is a sum of shared tokens (0.15, 0.35, 0.2, 0.2 each) and of what the text names: dense 1.8 for the expected
    metric, 1.0 for the entity, 0.45 a period; bm25 0.25 a period, 0.8 for the entity, and with ``boost_must`` 0.5 a must
    term; metric_alias 1.2 an alias, 0.7 for the entity, 0.35 a period; table 0.9 for a number, 0.5 for a statement, 0.8
    for the metric, 0.25 a period.
    """
    blob = normal_term(F.col("text"))
    tokens = lambda t: token_set(normal_term(t), LANE_STOP_WORDS)
    shared = lambda t: F.size(F.array_intersect(tokens(t), tokens(F.col("text"))))
    held = lambda terms: F.size(F.filter(F.array_distinct(F.transform(F.col(terms), normal_term)), lambda x: (x != "") & blob.contains(x)))
    asked = F.concat_ws(" ", F.array_join("must", " "), F.array_join("should", " "))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    entity = flag(blob.contains(normal_term(F.col("entity"))) | (F.col("company") == F.col("entity")))
    metric = flag(F.array_contains("metrics", F.col("metric")))
    periods = F.size(F.filter("periods", lambda p: blob.contains(p)))
    number = flag(F.col("text").rlike(r"\b\d[\d,.]*\b"))
    statement = flag(blob.contains("cash flow") | blob.contains("statement"))
    scores = {
        "dense": 0.15 * shared(F.col("unit_text")) + 1.8 * metric + 1.0 * entity + 0.45 * periods,
        "bm25": 0.35 * shared(F.coalesce("sparse_text", "unit_text")) + 0.25 * periods + 0.8 * entity + (0.5 * held("must") if boost_must else F.lit(0.0)),
        "metric_alias": 0.2 * shared(asked) + 1.2 * held("aliases") + 0.7 * entity + 0.35 * periods,
        "table": 0.2 * shared(asked) + 0.9 * number + 0.5 * statement + 0.8 * metric + 0.25 * periods,
    }
    return pairs.withColumns({lane: F.round(score, 6) for lane, score in scores.items()})


SHAPES = ("child_chunk", "parent_block", "page_neighborhood")


def shaped(candidates: DataFrame, shape: str) -> DataFrame:
    """Candidates (query_id, chunk_id, parent_id, rank, text, parent_text, previous_text, next_text) in a shape, ranked anew.

    child_chunk leaves them; the others keep each parent's first candidate, with the parent's text, or that between the
    texts of the pages before and after it.
    """
    if shape not in SHAPES:
        raise ValueError(f"unknown shape {shape}")
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    if shape == "child_chunk":
        return candidates.select("query_id", "chunk_id", "text", F.lit("text_chunk").alias("source_type"), F.row_number().over(order).alias("rank"))
    whole = F.col("parent_text") if shape == "parent_block" else F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in ("previous_text", "parent_text", "next_text")])
    first = best_per_group(candidates, ["query_id", "parent_id"], [F.col("rank").asc(), F.col("chunk_id").asc()])
    return first.select("query_id", F.col("parent_id").alias("chunk_id"), whole.alias("text"), F.lit(shape).alias("source_type"), F.row_number().over(order).alias("rank"))


def rerank(candidates: DataFrame, score: Column, top_k: int) -> DataFrame:
    """The ``top_k`` first by fusion rank get a score (computed after that cut) and a new rank: score, fusion rank, id."""
    cut = candidates.filter(F.col("rank") <= top_k).withColumnRenamed("rank", "fusion_rank").withColumn("rerank_score", score)
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("fusion_rank").asc(), F.col("chunk_id").asc())
    return cut.withColumn("rank", F.row_number().over(order))
