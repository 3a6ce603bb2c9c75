"""Candidates between providers, fusion and evidence: adapting, provenance, merging of metadata, traces per parent."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.fusion import local_rank

RANKS = ("final_rank", "rerank_rank", "fusion_rank", "lane_rank", "dense_rank", "lexical_rank")
PROVIDERS = ("hybrid", "graph", "sql")
#: Keys whose values are texts of graph objects and never leave the provider.
UNSAFE_KEYS = ("description", "text", "text_span", "summary", "raw_text")


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with null columns of the given types where they are missing."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def from_results(candidates: DataFrame, evidence: DataFrame, provider: str) -> DataFrame:
    """Candidates of a provider's results: its candidates where a query has any, else its evidence; with a local rank
    (the first known rank, else the position) and the provider's name."""
    candidates = with_missing(candidates, {r: "int" for r in RANKS})
    bare = evidence.join(candidates.select("query_id").distinct(), "query_id", "left_anti")
    rows = candidates.unionByName(bare.withColumnRenamed("rank", "final_rank"), allowMissingColumns=True)
    order = Window.partitionBy("query_id").orderBy(F.coalesce(*RANKS).asc_nulls_last(), "chunk_id")
    rows = rows.withColumn("position", F.row_number().over(order))
    return rows.withColumn("local_rank", local_rank(*RANKS, "position")).withColumn("provider", F.lit(provider))


def safe_provider(label: Column, fallback: str = "hybrid") -> Column:
    """A provider's label if it is a known one, else the fallback."""
    return F.when(F.lower(label).isin(*PROVIDERS), F.lower(label)).otherwise(fallback)


def safe_metadata(metadata: Column, unsafe: tuple[str, ...] = UNSAFE_KEYS) -> Column:
    return F.map_filter(metadata, lambda k, v: ~F.lower(k).isin(*unsafe))


def safe_json(metadata: Column, unsafe: tuple[str, ...] = UNSAFE_KEYS) -> Column:
    """A JSON text without the unsafe keys and their values at any depth, in objects and in lists; null if it isn't JSON."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def clean(x):
            if isinstance(x, dict):
                return {k: clean(v) for k, v in x.items() if k.lower() not in unsafe}
            return [clean(v) for v in x] if isinstance(x, list) else x

        def one(text):
            try:
                return None if text is None else json.dumps(clean(json.loads(text)), ensure_ascii=False)
            except ValueError:
                return None

        for s in parts:
            yield s.map(one)

    return run(metadata)


def merge_first(a: Column, b: Column) -> Column:
    """Union of two maps; where both have a key, the first non-empty value holds."""
    empty = lambda v: v.isNull() | (v == "")
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,string>")), F.coalesce(b, F.create_map().cast("map<string,string>")), lambda k, x, y: F.when(empty(x), y).otherwise(x))


def merge_last(a: Column, b: Column) -> Column:
    """Union of two maps; the second's values hold."""
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,string>")), F.coalesce(b, F.create_map().cast("map<string,string>")), lambda k, x, y: F.coalesce(y, x))


def merge_lists(rows: DataFrame, by: list[str], metadata: str = "metadata") -> DataFrame:
    """Per group, each metadata key with its distinct non-empty values, sorted."""
    long = rows.select(*by, F.explode(metadata).alias("key", "value")).filter("value IS NOT NULL AND value <> ''")
    per = long.groupBy(*by, "key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values")))).alias("metadata"))


def block_score() -> Column:
    """A block's retrieval score in an aggregate: the best rerank score, else fusion, dense, lexical, else 0."""
    return F.coalesce(F.max("rerank_score"), F.max("fusion_score"), F.max("dense_score"), F.max("lexical_score"), F.lit(0.0))


def parent_traces(candidates: DataFrame, contributions: DataFrame) -> DataFrame:
    """(query_id, parent_id, best_child, score, lanes): a parent's best child and the distinct contributions of all its children."""
    order = F.struct(*[F.coalesce(F.col(r), F.lit(1_000_000_000)) for r in ("final_rank", "rerank_rank", "fusion_rank")], "chunk_id")
    best = candidates.groupBy("query_id", "parent_id").agg(F.min_by("chunk_id", order).alias("best_child"), block_score().alias("score"))
    lanes = candidates.select("query_id", "parent_id", "chunk_id").join(contributions, ["query_id", "chunk_id"])
    lanes = lanes.groupBy("query_id", "parent_id").agg(F.array_sort(F.collect_set(F.struct("lane", "rank"))).alias("lanes"))
    return best.join(lanes, ["query_id", "parent_id"], "left")


def merge_contexts(rows: DataFrame) -> DataFrame:
    """One context per table_id: the first non-empty name and columns in order of source."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_order")))
    return rows.groupBy("table_id").agg(first("name").alias("name"), first("columns").alias("columns"))


def task_context(candidates: DataFrame, tasks: DataFrame) -> DataFrame:
    """Candidates with the purpose of their task, found by task_id or else by unit_id."""
    by_task = tasks.select("task_id", F.col("purpose").alias("_by_task")).dropDuplicates(["task_id"])
    by_unit = tasks.groupBy("query_id", "unit_id").agg(F.min("purpose").alias("_by_unit"))
    rows = candidates.join(by_task, "task_id", "left").join(by_unit, ["query_id", "unit_id"], "left")
    return rows.withColumn("purpose", F.coalesce("_by_task", "_by_unit")).drop("_by_task", "_by_unit")


def block_allowance(candidates: DataFrame, top_k: int) -> DataFrame:
    """(query_id, max_blocks): the ranked ones asked for, and all that are pinned or supporting."""
    return candidates.groupBy("query_id").agg((F.lit(top_k) + F.count_if(F.col("policy") != "ranked")).cast("long").alias("max_blocks"))


def promote_parents(blocks: DataFrame) -> DataFrame:
    """Source type of blocks: a text chunk that has a parent is shown as that parent's block."""
    promoted = (F.col("source_type") == "text_chunk") & F.col("parent_id").isNotNull()
    return blocks.withColumn("source_type", F.when(promoted, "parent_block").otherwise(F.col("source_type")))
