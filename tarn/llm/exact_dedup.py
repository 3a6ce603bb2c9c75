"""Exact deduplication by two-pass Bloom filtering: only rows whose text may repeat are shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .repeats import may_repeat, repeat_filter


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalize: Callable[[Column], Column] | None = None,
    max_filter_bytes: int = 64 << 20,
) -> DataFrame:
    """`exact_groups_and_filter` without the filter."""
    return exact_groups_and_filter(docs, id_col, text_col, normalize, max_filter_bytes)[0]


def exact_groups_and_filter(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalize: Callable[[Column], Column] | None = None,
    max_filter_bytes: int = 64 << 20,
) -> tuple[DataFrame, object]:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if their SHA-256 after ``normalize`` (default: no change) is. The row with the largest id stays.
    A null text counts as empty. A null id is smaller than any other; of rows that share text and id, exactly one is
    kept. An empty table gives no rows. Other columns are never read, so their names can't clash.

    Plan: hash every text once in the JVM and write (id, hash); two passes over those narrow rows find the hashes
    that may repeat; only these are aggregated (with map-side combining, so a hot text is a row per task) and joined
    back, a join between two written tables that adaptive execution can split if one text holds a third of the rows.
    All other rows go straight to the result. The filter, for ``may_repeat(xxhash64(sha as binary), ...)``, lets callers
    who read the texts again keep rows apart that can't have copies.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if normalize is not None:
        text = F.coalesce(normalize(text), F.lit(""))
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.monotonically_increasing_id().alias("rid"))
    hashed = materialize(hashed, "hashes")
    key = F.xxhash64("sha")
    held = repeat_filter(hashed.select(key.alias("k")), hashed.count(), max_bytes=max_filter_bytes)
    flagged = hashed.withColumn("again", may_repeat(key, held))
    alone = flagged.filter(~F.col("again"))
    maybe = materialize(flagged.filter("again").drop("again"), "maybe-repeated")

    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "rid")).alias("best")
    groups = maybe.groupBy("sha").agg(best, F.count("*").alias("group_size")).filter("group_size > 1")
    groups = materialize(groups.select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size"), "repeated")
    joined = maybe.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    through = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
    return through.unionByName(joined), held


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that `exact_groups` keeps.

    Texts that the filter knows to be alone stay where they are; the others meet the ids that are dropped, and rows
    that repeat both id and text are made one.
    """
    groups, held = exact_groups_and_filter(docs, id_col, text_col)
    dropped = groups.filter((F.col("doc_id") < F.col("keep_id")) | (F.col("doc_id").isNull() & F.col("keep_id").isNotNull()))
    sha, again = fresh(docs, "sha"), fresh(docs, "again")
    gone, gone_sha = fresh(docs, "gone"), fresh(docs, "gone_sha")
    dropped = dropped.select(F.col("doc_id").alias(gone), F.unhex("text_sha256").alias(gone_sha))
    rows = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    rows = rows.withColumn(again, may_repeat(F.xxhash64(sha), held))
    hit = F.col(id_col).eqNullSafe(F.col(gone)) & (F.col(sha) == F.col(gone_sha))
    kept = rows.filter(F.col(again)).join(dropped, hit, "left_anti").dropDuplicates([id_col, sha])
    return rows.filter(~F.col(again)).unionByName(kept).drop(sha, again)
