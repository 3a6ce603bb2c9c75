"""Traces of query runs as tables: flattening, fetching, lane metrics, stages, retrieval events, reports, resets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One run as it is logged; all nested lists become tables of their own.
TRACE = (
    "query_id string, question string, status string, latency_ms double, plan struct<plan_id string, units array<struct<unit_id string, purpose string, text string>>>, "
    "tasks array<struct<task_id string, unit_id string, provider string, status string>>, candidates array<struct<chunk_id string, lane string, rank int, score double>>, "
    "blocks array<struct<block_id string, chunk_id string, included boolean, drop_reason string, tokens int>>, answer struct<text string, confidence string>, "
    "citations array<struct<citation_id string, block_id string>>, stages array<struct<stage string, latency_ms double>>"
)
#: Stages of a run, in order.
STAGES = ("plan", "route", "retrieve", "fuse", "rerank", "pack", "generate", "verify")
LISTS = {"units": "plan.units", "tasks": "tasks", "candidates": "candidates", "blocks": "blocks", "citations": "citations", "stages": "stages"}


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Runs from lines of JSON; lines that don't parse have no query_id and are left out."""
    return lines.select(F.from_json(column, TRACE).alias("t")).select("t.*").filter("query_id IS NOT NULL")


def flatten(runs: DataFrame) -> dict[str, DataFrame]:
    """runs, answers, and a table per nested list with query_id and position."""
    out = {"runs": runs.select("query_id", "question", "status", "latency_ms", F.col("plan.plan_id").alias("plan_id")), "answers": runs.filter("answer IS NOT NULL").select("query_id", "answer.*")}
    for name, path in LISTS.items():
        out[name] = runs.select("query_id", F.posexplode(F.col(path)).alias("position", "x")).select("query_id", "position", "x.*")
    return out


def fetch(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """The runs asked for, each as one record with its lists in order again."""
    record = tables["runs"].join(ids.select("query_id").distinct(), "query_id", "left_semi")
    for name in LISTS:
        rows = tables[name].join(ids.select("query_id").distinct(), "query_id", "left_semi")
        fields = [c for c in rows.columns if c != "query_id"]
        record = record.join(rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)), "query_id", "left")
    return record


def lane_metrics(events: DataFrame) -> DataFrame:
    """(lane, n, total_ms, max_ms) of lane events (lane, latency_ms); for the reranker the longest call counts."""
    return events.groupBy("lane").agg(
        F.count("*").alias("n"), F.round(F.when(F.first("lane") == "reranker", F.max("latency_ms")).otherwise(F.sum("latency_ms")), 6).alias("total_ms"), F.max("latency_ms").alias("max_ms")
    )


def stage_table(stages: DataFrame, ids: DataFrame) -> DataFrame:
    """(query_id, stage, position, latency_ms) with every stage for every run, 0 where nothing was logged."""
    every = ids.select("query_id", F.posexplode(F.array(*map(F.lit, STAGES))).alias("position", "stage"))
    logged = stages.groupBy("query_id", "stage").agg(F.sum("latency_ms").alias("latency_ms"))
    return every.join(logged, ["query_id", "stage"], "left").withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0.0)))


def retrieval_events(evidence: DataFrame) -> DataFrame:
    """Evidence rows as events, one each."""
    return evidence.select("query_id", F.lit("evidence").alias("event"), "chunk_id", "rank", F.col("score").alias("value"))


def failure_reasons(cases: DataFrame) -> DataFrame:
    """(case_id, reasons) for cases (case_id, hit, keyword_share, confidence, expected_confidence, error)."""
    checks = (
        F.when(F.col("error").isNotNull(), "error"),
        F.when(~F.coalesce("hit", F.lit(False)), "source_missed"),
        F.when(F.col("keyword_share") < 1, "keywords_missed"),
        F.when(F.col("confidence") != F.col("expected_confidence"), "confidence_differs"),
    )
    return cases.select("case_id", F.array_compact(F.array(*checks)).alias("reasons"))


def ablation(cases: DataFrame, modes: dict[str, DataFrame], relevant: DataFrame) -> DataFrame:
    """(mode, cases, hit_1.., mrr, map): all modes' rankings (query_id, item, rank) measured against the same cases in one job."""
    from tarn.operators.measures import KS, retrieval_metrics

    rows = None
    for mode, ranked in modes.items():
        m = retrieval_metrics(ranked, relevant, cases).withColumn("mode", F.lit(mode))
        rows = m if rows is None else rows.unionByName(m)
    hits = [F.round(F.avg(F.col(f"hit_{k}").cast("double")), 6).alias(f"hit_{k}") for k in KS]
    return rows.groupBy("mode").agg(F.count("*").alias("cases"), *hits, F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("average_precision"), 6).alias("map"))


def markdown(summary: DataFrame, order: str, most: int = 1000) -> str:
    """A summary as a Markdown table of its first ``most`` rows; a last line says if there are more."""
    columns = summary.columns
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    rows = summary.orderBy(order).limit(most + 1).collect()
    lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + [f"Only the first {most} rows are shown."] * (len(rows) > most))


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables without rows."""
    return {n: df.limit(0) for n, df in tables.items()}
