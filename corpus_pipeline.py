"""A corpus pipeline: toxic documents go, then copies, then near copies; sources are mixed and texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarn.llm.common import text_batches
from tarn.llm.exact_dedup import drop_copies
from tarn.llm.jaccard import one_of_each
from tarn.llm.mixing import mixed_rows
from tarn.llm.segment_sampling import sample_segmentations
from tarn.llm.toxicity import drop_toxic
from tarn.scratch import materialize, scope, sweep
from tarn.session import ship


def _stage(step):
    """A stage whose intermediate tables live until the next stage is called: by then its result has been written."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        text_batches(spark)
        sweep(spark, "pipeline")
        with scope("pipeline"):
            return step(spark, docs, sf_dir)

    return run


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3 stay, each row by itself: null and empty texts have the score of no evidence,
    repeated rows all stay or all go, ids of any kind do not matter, an empty table gives none."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


@_stage
def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, of rows that repeat id and text one. Null texts equal empty ones; a null
    id is smaller than any; an empty table gives none."""
    return drop_copies(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose sets of 5-word shingles are linked by a Jaccard similarity of 0.8 or more, the smallest id stays. Texts
    without words (null, empty, blank) link with nothing; rows with a null id stay; an empty table gives none."""
    return one_of_each(docs, width=5, threshold=(4, 5))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near to their target weights; a document is repeated up to three times. A null source is one of its own, a
    null text has no words, rows that share an id are taken together; an empty table gives none."""
    return mixed_rows(docs)


@_stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each row (fewer if it has no two): doc_id, sample, ids, scores, and whether they decode to the
    text. A null or empty text has one without ids; repeated rows repeat their samples; an empty table gives none."""
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES = [("toxicity", toxic), ("exact dedup", copies), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("SentencePiece sampling", encoded)]

#: The toxicity models and the sampled segmentations have no SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs
