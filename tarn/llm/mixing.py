"""Mixing sources to target weights by hash-threshold histograms: no sort, and every rerun takes the same documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

#: The hash of a row has LEVELS digits of DIGIT bits; a histogram is made of one digit at a time.
LEVELS, DIGIT = 4, 12
#: Tables of sources up to this many rows (of a few numbers each) are broadcast; beyond it, the join shuffles.
BROADCAST_SOURCES = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def row_hash(id_col: str, seed: str) -> Column:
    """48 bits of md5(seed:id); a null id hashes as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, LEVELS * DIGIT // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) for a table (source, source_size) with one row per source.

    Sources in order of code points, null last, have the weights in turn. Together they get ``share`` of all sizes;
    a target stops at ``most`` times its source's size and what is above goes to the others by weight, until none
    is above. That fixed point is found directly: in order of size over weight, the first sources stop at their cap
    as long as the level that the others would get is above their own.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("at", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("at")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("left_w"))
    )
    # The level of the first source that isn't capped holds for all after it.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), "at", "level"))).over(everything)
    ranked = ranked.withColumn("found", level["level"])
    target = F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("found")))
    return ranked.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _on_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Inner join on a null-safe source; the column source stays that of ``rows``."""
    other = per_source.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(other) if few else other, rows.source.eqNullSafe(F.col("_s"))).drop("_s")


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    most: float = 3.0,
    seed: str = "mix",
    size: Column | None = None,
) -> tuple[DataFrame, DataFrame, bool]:
    """(rows: doc_id, source, size, u; plan: one row per source with its threshold; whether the plan can be broadcast)."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)) if size is None else size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.cast("long").alias("size"), row_hash(id_col, seed).alias("u"))
    rows = materialize(rows, "sizes")

    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio).cast("long")
    plan = source_targets(sizes, weights, share, most).withColumn("whole", whole)
    # pre: the digits of the threshold found so far; budget: what of the target that prefix leaves.
    plan = plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("pre", F.lit(0).cast("long"))
    plan = materialize(plan, "targets")
    few = plan.count() <= BROADCAST_SOURCES

    digit_sum = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        inside = _on_source(rows, plan.select("source", "pre"), few).filter(F.shiftright("u", shift + DIGIT) == F.col("pre"))
        histogram = inside.groupBy("source", F.shiftright("u", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.sum("size").alias("n"))
        before = F.coalesce(F.sum("n").over(digit_sum), F.lit(0))
        ends = _on_source(histogram.withColumn("before", before), plan.select("source", "budget"), few)
        ends = ends.filter(F.col("before") + F.col("n") > F.col("budget")).groupBy("source").agg(F.min(F.struct("digit", "before", "n")).alias("end"))
        ends = ends.withColumnRenamed("source", "_s")
        plan = plan.join(F.broadcast(ends) if few else ends, plan.source.eqNullSafe(F.col("_s")), "left").drop("_s")
        # No bucket ends the budget: it holds all rows of the source (only rounding gets here); the last hash is then inside.
        plan = plan.select(
            *[c for c in plan.columns if c not in ("pre", "budget", "end", "n")],
            (F.col("pre") * (1 << DIGIT) + F.coalesce(F.col("end.digit"), F.lit((1 << DIGIT) - 1))).alias("pre"),
            (F.col("budget") - F.coalesce(F.col("end.before"), F.lit(0))).alias("budget"),
            F.coalesce(F.col("end.n"), F.lit(0)).alias("n"),
        )
        plan = materialize(plan, "thresholds")
    # On the boundary hash itself: in if that leaves less of the budget unfilled than it overshoots.
    plan = plan.withColumn("also", (F.col("budget") > 0) & (F.col("n") - F.col("budget") < F.col("budget")))
    return rows, plan, few


def _copies(most: float) -> Column:
    copies = F.col("whole") + F.when((F.col("u") < F.col("pre")) | (F.col("also") & (F.col("u") == F.col("pre"))), 1).otherwise(0)
    return F.least(copies, F.lit(int(most))).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    most: float = 3.0,
    seed: str = "mix",
    size: Column | None = None,
) -> DataFrame:
    """One row per input row: (doc_id, size, source_size, target, taken); ``taken`` counts repeats, 0: not in the mix.

    A source whose target is at least its size takes all documents floor(target / size) times. What is then left of
    the target is a budget for one copy more: documents whose hash is under the source's threshold. Thresholds come
    from a histogram of sizes by hash digit; only the bucket in which the budget ends is refined by the next digit, so
    a smaller budget always takes a subset of what a larger one takes. The document on the boundary is taken if that
    brings the source nearer to its target; documents that share a hash (a repeated id) are taken together.

    Null texts have size 0, null sources are a source, null ids hash as empty text; an empty table gives no rows.
    The window over sources reads one row per source; histograms have at most 2**DIGIT rows per source.
    """
    rows, plan, few = mix_plan(docs, id_col, text_col, source_col, weights, share, most, seed, size)
    joined = _on_source(rows, plan, few).withColumn("copies", _copies(most))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", most: float = 3.0, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, as often as `mix` takes them; rows it doesn't take are gone."""
    _, plan, few = mix_plan(docs, id_col, text_col, source_col, seed=seed, most=most, **options)
    theirs, cut, u, copy = (fresh(docs, n) for n in ("mix_source", "mix_plan", "mix_hash", "mix_copy"))
    own = plan.select(F.col("source").alias(theirs), F.struct("whole", "pre", "also").alias(cut))
    rows = docs.withColumn(u, row_hash(id_col, seed))
    rows = rows.join(F.broadcast(own) if few else own, F.col(source_col).eqNullSafe(F.col(theirs)))
    below = (F.col(u) < F.col(cut)["pre"]) | (F.col(cut)["also"] & (F.col(u) == F.col(cut)["pre"]))
    copies = F.least(F.col(cut)["whole"] + F.when(below, 1).otherwise(0), F.lit(int(most)))
    copies = F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.select(*[F.col(c) for c in docs.columns], F.explode(copies).alias(copy)).drop(copy)
