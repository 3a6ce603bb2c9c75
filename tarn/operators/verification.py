"""Checking evidence and answers: anchors, coverage, conflicts of numbers, citations, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.numbers import extract_numbers
from tarn.functions.text import citations, coverage_aliases


def anchor_support(evidence: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query_id, evidence_id, found, total, support): anchors (query_id, anchor) that a text (query_id, evidence_id, text) holds."""
    rows = evidence.join(anchors, "query_id", "left")
    hit = F.lower("text").contains(F.lower(F.col("anchor")))
    per = rows.groupBy("query_id", "evidence_id").agg(F.count_if(hit).alias("found"), F.count("anchor").alias("total"))
    return per.withColumn("support", F.when(F.col("found") == F.col("total"), "full").when(F.col("found") > 0, "partial").otherwise("none"))


def numeric_conflicts(evidence: DataFrame) -> DataFrame:
    """(query_id, conflict) of evidence (query_id, rank, text, support): two fully supporting texts with exactly one number each,
    of one unit, that differ from the first."""
    one = evidence.filter("support = 'full'").withColumn("numbers", extract_numbers(F.col("text"))).filter("size(numbers) = 1")
    one = one.select("query_id", "rank", F.col("numbers")[0]["scaled"].alias("value"), F.col("numbers")[0]["unit"].alias("unit"))
    first = one.groupBy("query_id", "unit").agg(F.min_by("value", "rank").alias("first"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return first.groupBy("query_id").agg(F.bool_or(F.col("lo") != F.col("hi")).alias("conflict"))


def evidence_verdict(support: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """(query_id, verdict): contradicted, supported, partial or insufficient; without anchors a query is supported."""
    per = support.groupBy("query_id").agg(
        F.bool_or(F.col("support") == "full").alias("full"), F.bool_or(F.col("support") == "partial").alias("some")
    )
    if conflicts is not None:
        per = per.join(conflicts, "query_id", "left")
    clash = F.coalesce("conflict", F.lit(False)) if conflicts is not None else F.lit(False)
    return per.select("query_id", F.when(clash, "contradicted").when(F.col("full"), "supported").when(F.col("some"), "partial").otherwise("insufficient").alias("verdict"))


def citation_check(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, cited, invalid, numbers_missing, status) of answers (answer_id, query_id, text) against evidence
    (query_id, citation_id, text): without citations or with invalid ones unsupported; numbers that no cited text has warn."""
    marks = answers.select("answer_id", "query_id", F.explode(citations(F.col("text"))).alias("citation_id"))
    found = marks.join(evidence.select("query_id", "citation_id", F.col("text").alias("source")), ["query_id", "citation_id"], "left")
    per = found.groupBy("answer_id").agg(
        F.count("*").alias("cited"), F.count_if(F.col("source").isNull()).alias("invalid"), F.flatten(F.collect_list(F.transform(extract_numbers(F.coalesce("source", F.lit(""))), lambda x: x["scaled"]))).alias("held")
    )
    bare = F.regexp_replace("text", r"\[c\d+\]", " ")
    rows = answers.join(per, "answer_id", "left").withColumn("said", F.transform(extract_numbers(bare), lambda x: x["scaled"]))
    missing = F.size(F.array_except("said", F.coalesce("held", F.array().cast("array<double>"))))
    cited, invalid = F.coalesce("cited", F.lit(0)), F.coalesce("invalid", F.lit(0))
    status = F.when((cited == 0) | (invalid > 0), "unsupported").when(missing > 0, "warning").otherwise("supported")
    return rows.select("answer_id", cited.alias("cited"), invalid.alias("invalid"), missing.alias("numbers_missing"), status.alias("status"))


def citation_metadata(citations: DataFrame, evidence: DataFrame, fields: tuple[str, ...] = ("document_id", "chunk_id", "page_start", "page_end")) -> DataFrame:
    """(answer_id, citation_id, mismatches): of citations (answer_id, query_id, citation_id and fields) that name a piece of evidence
    (query_id, citation_id and fields), the fields that say something else than it; fields a citation leaves out don't count."""
    theirs = evidence.select("query_id", F.lower("citation_id").alias("citation_id"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = citations.withColumn("citation_id", F.lower(F.trim("citation_id"))).join(theirs, ["query_id", "citation_id"])
    wrong = [F.when(F.col(f).isNotNull() & ~F.col(f).cast("string").eqNullSafe(F.col(f"_{f}").cast("string")), f) for f in fields]
    return rows.select("answer_id", "citation_id", F.array_compact(F.array(*wrong)).alias("mismatches")).filter("size(mismatches) > 0")


def answer_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, position, citation_id, text) in the order in which answers cite."""
    marks = answers.select("answer_id", "query_id", F.posexplode(citations(F.col("text"))).alias("position", "citation_id"))
    return marks.join(evidence.select("query_id", "citation_id", "text"), ["query_id", "citation_id"]).select("answer_id", "position", "citation_id", "text")


def coverage(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, kind, covered, missing): items (query_id, kind, value) that the query's text holds in one of their forms."""
    rows = wanted.join(texts.select("query_id", F.lower("text").alias("t")), "query_id", "left")
    hit = F.exists(coverage_aliases(F.col("value")), lambda a: F.coalesce(F.col("t").contains(a), F.lit(False)))
    by = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("value"))))
    return rows.groupBy("query_id", "kind").agg(by(hit).alias("covered"), by(~hit).alias("missing"))


def final_confidence(*given: Column) -> Column:
    """The first non-blank of the overrides and the generated value."""
    return F.coalesce(*[F.nullif(F.trim(g), F.lit("")) for g in given])


def critic_flags(rows: DataFrame) -> DataFrame:
    """unsupported_answer: answered without support; false_insufficient: refused though evidence supports."""
    answered = F.col("confidence") != "insufficient"
    return rows.withColumn("unsupported_answer", answered & (F.col("verdict") != "supported")).withColumn("false_insufficient", ~answered & (F.col("verdict") == "supported"))


def redact(df: DataFrame, columns: list[str], mark: str = "[redacted]") -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(mark)) for c in columns})
