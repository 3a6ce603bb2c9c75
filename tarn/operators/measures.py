"""Retrieval metrics, answer metrics, latency and status summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.retrieval import small
from tarn.scratch import materialize

KS = (1, 3, 5, 10)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, cases: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(query_id, first_rank, hit_1.., reciprocal_rank, average_precision) for every case.

    ranked: query_id, item, rank; relevant: query_id, item. Average precision counts the first hit of each relevant
    item, over the number of relevant items (at least 1). With ``expected`` (query_id, expected) those numbers are given,
    and ``relevant`` need only hold items that are ranked.
    """
    hits = ranked.join(relevant.select("query_id", "item").distinct(), ["query_id", "item"]).groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    hits = hits.withColumn("precision", nth / F.col("rank"))
    per = hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.sum("precision").alias("total"))
    if expected is None:
        expected = relevant.select("query_id", "item").distinct().groupBy("query_id").agg(F.count("*").alias("expected"))
    rows = cases.select("query_id").distinct().join(per, "query_id", "left").join(expected, "query_id", "left")
    out = [F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias(f"hit_{k}") for k in KS]
    ap = F.coalesce(F.col("total"), F.lit(0.0)) / F.greatest(F.lit(1), F.coalesce("expected", F.lit(0)))
    return rows.select("query_id", "first_rank", *out, F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(ap, 6).alias("average_precision"))


def rate(flag: Column) -> Column:
    """Share of true among rows where the flag isn't null; null without any."""
    return F.try_divide(F.count_if(flag).cast("double"), F.count(flag))


RADIX = 16  # bits that a pass looks at: a histogram of at most 2^16 cells per group


def ordered_bits(value: Column) -> Column:
    """A double's 64 bits as a long in the order of doubles: NaN last, both zeros equal; null stays null."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(value.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits))


def from_ordered_bits(bits: Column) -> Column:
    """The double of `ordered_bits`."""
    plain = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), plain).cast("double")


def order_statistics(rows: DataFrame, by: str, value: str, wanted: DataFrame) -> DataFrame:
    """(by, place, value): the ``place``-th smallest value (from 1) of each group, for a table ``wanted`` (by, place).

    Radix selection: the values' bits, in the order of doubles, are written once beside their groups. A pass counts the next RADIX bits of
    those rows whose higher bits are some place's, and so finds that place's next bits; after 64 / RADIX passes they are its value. How many
    passes there are does not depend on how values are spread. Counts combine map-side and windows run over the cells of one
    histogram, so no group is ever in one task, however large or uneven. Null values have no place.
    """
    bits = rows.select(F.col(by).alias("g"), ordered_bits(F.col(value)).alias("bits")).filter("bits IS NOT NULL")
    return _selected(materialize(bits, "ordered-bits"), wanted.select(F.col(by).alias("g"), "place")).withColumnRenamed("g", by)


def _selected(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, place, value) of a written table (g, bits)."""
    wanted = wanted.select("g", "place", F.col("place").alias("left"), F.lit(None).cast("long").alias("prefix"))
    for shift in range(64 - RADIX, -1, -RADIX):
        counted = rows.withColumn("part", F.shiftright("bits", shift))
        if shift < 64 - RADIX:
            # Rows that share the higher bits of a place; their groups and prefixes are as many as places at most.
            places = wanted.select(F.col("g").alias("og"), F.col("prefix").alias("op")).distinct()
            here = counted.g.eqNullSafe(places.og) & (F.shiftright("bits", shift + RADIX) == places.op)
            counted = counted.join(small(places), here, "left_semi")
        above = F.shiftright("part", RADIX) if shift < 64 - RADIX else F.lit(0).cast("long")
        cells = counted.groupBy("g", "part").agg(F.count("*").alias("n")).withColumn("above", above)
        before = Window.partitionBy("g", "above").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumnRenamed("g", "hg")
        same = wanted.g.eqNullSafe(cells.hg) & (F.coalesce(wanted.prefix, F.lit(0)) == F.col("above"))
        met = wanted.join(cells, same & (F.col("left") > F.col("before")) & (F.col("left") <= F.col("before") + F.col("n")))
        wanted = materialize(met.select("g", "place", (F.col("left") - F.col("before")).alias("left"), F.col("part").alias("prefix")), "places")
    return wanted.select("g", "place", from_ordered_bits(F.col("prefix")).alias("value"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: rows, mean (whole milliseconds, as the reports have it), bounds, p50 and p95 by both definitions.

    Nearest rank takes the value at place ceil(p n); linear interpolates between the places around 1 + p (n - 1). The
    values at those places are exact, by `order_statistics`. The table is read once; what is written of it, a group and a value a
    row, is read once for the totals and once for each pass.
    """
    rows = materialize(rows.filter(F.col(value).isNotNull()).select(by, value, ordered_bits(F.col(value)).alias("_bits")), "latencies")
    totals = rows.groupBy(by).agg(F.count("*").alias("n"), F.floor(F.avg(value)).cast("long").alias("avg_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))
    # In per cents and whole numbers, so that no place hangs on how a share is rounded.
    places = {p: {"rank": F.greatest(F.ceil(F.col("n") * p / 100), F.lit(1)), "low": F.floor((F.col("n") - 1) * p / 100) + 1, "high": F.ceil((F.col("n") - 1) * p / 100) + 1} for p in (50, 95)}
    every = F.array(*[x.cast("long") for ps in places.values() for x in ps.values()])
    totals = materialize(totals, "latency-totals")
    wanted = totals.select(F.col(by).alias("g"), F.explode(F.array_distinct(every)).alias("place"))
    found = _selected(rows.select(F.col(by).alias("g"), F.col("_bits").alias("bits")), wanted).withColumnRenamed("g", by)
    values = found.groupBy(F.col(by).alias("_by")).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("at"))
    joined = totals.join(values, totals[by].eqNullSafe(F.col("_by")))
    at = lambda x: F.element_at("at", x.cast("long"))
    out = []
    for p, x in places.items():
        share = (F.col("n") - 1) * p / 100 - F.floor((F.col("n") - 1) * p / 100)
        out += [at(x["rank"]).alias(f"p{p}_rank"), F.round(at(x["low"]) + (at(x["high"]) - at(x["low"])) * share, 6).alias(f"p{p}_linear")]
    return joined.select(by, "n", "avg_ms", "min_ms", "max_ms", out[0], out[2], out[1], out[3])


def mean_known(value: Column) -> Column:
    """Mean of values that are neither null nor NaN."""
    return F.avg(F.when(~F.isnan(value), value))


def group_counts(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return rows.groupBy(F.coalesce(key.cast("string"), F.lit("unknown")).alias(name)).agg(F.count("*").alias("n"))


#: States a run can end in, in order of precedence.
STATES = ("executed", "partial", "failed", "empty", "skipped")


def rollup_status(tasks: DataFrame) -> DataFrame:
    """(query_id, status): executed if all executable tasks are, partial if some, else failed, empty or skipped."""
    some = lambda s: F.bool_or(F.col("status") == s)
    return tasks.groupBy("query_id").agg(
        F.when(some("executed") & (some("failed") | some("partial")), "partial")
        .when(some("partial"), "partial")
        .when(some("executed"), "executed")
        .when(some("failed"), "failed")
        .when(some("empty"), "empty")
        .otherwise("skipped")
        .alias("status")
    )


def failure_buckets(by_mode: DataFrame) -> DataFrame:
    """(bucket, n) from one row per case and mode (case_id, mode, first_rank): where one mode finds what another misses."""
    wide = by_mode.groupBy("case_id").pivot("mode", ["dense", "bm25", "hybrid", "rerank"]).agg(F.min("first_rank"))
    d, b, h, r = (F.col(c) for c in ("dense", "bm25", "hybrid", "rerank"))
    names = F.array_compact(
        F.array(
            F.when(d.isNull() & b.isNotNull(), "dense_missed_bm25_hit"),
            F.when(h.isNotNull() & r.isNull(), "hybrid_found_reranker_lost"),
            F.when(r < h, "reranker_improved_rank"),
            F.when(d.isNull() & h.isNull(), "both_dense_and_hybrid_missed"),
        )
    )
    return wide.select(F.explode(names).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def presence_rates(rows: DataFrame, components: list[str]) -> DataFrame:
    """(component, hits, total, rate): for boolean columns, nulls not counted."""
    long = rows.unpivot([], components, "component", "present")
    return long.groupBy("component").agg(F.count_if("present").alias("hits"), F.count("present").alias("total"), F.round(rate(F.col("present")), 6).alias("rate"))


def single_target_precision(ranked: DataFrame, relevant: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, average_precision) where only the first relevant item counts: its reciprocal rank, 0 without any."""
    rows = retrieval_metrics(ranked, relevant, cases, relevant.select("query_id").distinct().withColumn("expected", F.lit(1)))
    return rows.select("query_id", F.col("reciprocal_rank").alias("average_precision"))


def gold_contains(answer: Column, expected: Column) -> Column:
    """Whether an answer holds the expected one, both folded and with single blanks; null without an expectation, false without an answer."""
    from tarn.functions.text import folded

    want = folded(expected)
    return F.when(F.coalesce(want, F.lit("")) == "", F.lit(None)).otherwise(F.coalesce(folded(answer).contains(want), F.lit(False)))


def case_results(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per case (case_id, question, expected_confidence, expected_answer, expected_keywords), with its run (case_id,
    answer, confidence, cited, latency_ms, error; cited: whether an expected source was cited) or without.

    A case whose run failed, or that has none, has a row too: no hits, a keyword share of 0, and the error.
    """
    rows = cases.join(runs.dropDuplicates(["case_id"]), "case_id", "left")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("answer").isNull(), "no run")
    good = error.isNull()
    return rows.select(
        "case_id",
        "question",
        F.when(good, F.col("confidence")).alias("actual_confidence"),
        F.coalesce(good & F.col("cited"), F.lit(False)).alias("source_hit"),
        F.coalesce(good & (F.col("confidence") == F.col("expected_confidence")), F.lit(False)).alias("confidence_hit"),
        F.when(good, keyword_share(F.col("answer"), F.col("expected_keywords"))).otherwise(0.0).alias("keyword_share"),
        gold_contains(F.when(good, F.col("answer")), F.col("expected_answer")).alias("gold_contains"),
        F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"),
        error.alias("error"),
    )


def keyword_share(text: Column, keywords: Column) -> Column:
    """Share of keywords that a text holds; null without keywords."""
    low = F.lower(text)
    return F.try_divide(F.size(F.filter(keywords, lambda k: low.contains(F.lower(k)))).cast("double"), F.size(keywords))


def eval_summary(rows: DataFrame) -> DataFrame:
    """One row for a run (case_id, hit, keyword_share, latency_ms, tokens): counts, means with null latency as 0, failures."""
    return rows.agg(
        F.count("*").alias("cases"),
        F.count_if("hit").alias("hits"),
        F.round(mean_known(F.col("keyword_share")), 6).alias("avg_keyword"),
        F.round(F.avg(F.coalesce("latency_ms", F.lit(0.0))), 6).alias("avg_latency"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count_if(~F.coalesce("hit", F.lit(False))).alias("failures"),
    )
