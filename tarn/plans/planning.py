"""Query plans: a deterministic planner, its grounding checks, tasks, metric ontology, provider routing, cache keys."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.text import has_phrase, normal_term, years

#: Metric -> other names.
METRICS = {
    "capital_expenditure": ("capital expenditure", "capital expenditures", "capex", "capital spending", "purchases of property, plant and equipment", "additions to property, plant and equipment"),
    "revenue": ("revenue", "revenues", "net sales", "sales", "total revenue", "net revenue"),
    "net_income": ("net income", "net earnings", "net loss", "net income attributable"),
    "operating_income": ("operating income", "income from operations", "operating profit"),
    "gross_profit": ("gross profit", "gross margin dollars"),
    "total_assets": ("total assets", "assets"),
    "total_liabilities": ("total liabilities", "liabilities"),
    "shareholders_equity": ("shareholders equity", "stockholders equity", "total equity"),
    "cash_and_cash_equivalents": ("cash and cash equivalents", "cash equivalents"),
    "operating_cash_flow": ("operating cash flow", "cash flow from operations", "net cash provided by operating activities", "net cash from operating activities"),
    "free_cash_flow": ("free cash flow", "fcf"),
    "r_and_d_expense": ("research and development", "research and development expense", "r&d", "r and d"),
    "sga_expense": ("selling general and administrative", "sg&a", "sga", "selling administrative"),
    "long_term_debt": ("long-term debt", "long term debt", "debt securities"),
    "inventory": ("inventory", "inventories"),
    "dividends": ("dividends", "cash dividends", "dividends paid"),
    "eps": ("earnings per share", "eps", "diluted eps", "basic eps"),
}


def read_metrics(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """Metrics of a YAML file: a mapping of names to entries with canonical_name and aliases."""
    from tarn.sources.datasets import read_yaml

    found = read_yaml(spark, path) or {}
    if not isinstance(found, dict):
        raise ValueError("metrics must be a mapping")
    return {str((v or {}).get("canonical_name") or k): tuple(map(str, (v or {}).get("aliases") or ())) for k, v in found.items()}


def ontology(spark: SparkSession, metrics: dict[str, tuple[str, ...]] = METRICS) -> DataFrame:
    """(metric, alias, place): aliases in normal form in the order in which they are tried; a name is its own first alias."""
    rows = [(m, " ".join(a.lower().replace("_", " ").split()), i) for m, others in metrics.items() for i, a in enumerate((m, *others))]
    return spark.createDataFrame([r for r in rows if r[1]], "metric string, alias string, place int")


def canonical_metric(names: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, metric): the metric that a term (in any spelling of blanks, underscores and case) is a name of."""
    first = names.groupBy("alias").agg(F.min("metric").alias("metric"))  # an alias has one metric
    return terms.select("term", normal_term(F.col("term")).alias("alias")).join(F.broadcast(first), "alias").select("term", "metric")


def metric_mentions(texts: DataFrame, names: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, metric, alias, rank) of the metrics that a text names: of each metric the first alias that stands there as a
    whole phrase; metrics with longer aliases come first, then by name."""
    t = texts.select(F.col(id_col).alias("query_id"), normal_term(F.col(text_col)).alias("t"))
    hits = t.join(F.broadcast(names), has_phrase(F.col("t"), F.col("alias")))  # the ontology is a fixed list
    first = hits.groupBy("query_id", "metric").agg(F.min_by("alias", "place").alias("alias"))
    order = Window.partitionBy("query_id").orderBy(F.length("alias").desc(), "metric")
    return first.withColumn("rank", F.row_number().over(order))


def plan_units(queries: DataFrame, mentions: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, unit_id, purpose, text, weight, lane_weights) of the deterministic planner.

    The original text has weight 1.0; each metric adds a unit with its alias (1.5; bm25 1.2, metric_alias 1.5), and
    years add one that anchors the period (1.2; bm25 1.3).
    """
    q = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text"))
    weights = lambda **w: F.create_map(*[F.lit(x) for p in w.items() for x in p])
    first = q.select("query_id", F.lit(0).alias("o"), F.lit("original").alias("purpose"), "text", F.lit(1.0).alias("weight"), weights(dense=1.0).alias("lane_weights"))
    metric = q.join(mentions, "query_id").select(
        "query_id", F.lit(1).alias("o"), F.lit("metric_alias").alias("purpose"), F.concat_ws(" ", F.col("text"), F.translate("metric", "_", " ")).alias("text"), F.lit(1.5).alias("weight"), weights(bm25=1.2, metric_alias=1.5).alias("lane_weights")
    )
    period = q.withColumn("ys", years(F.col("text"))).filter("size(ys) > 0").select(
        "query_id", F.lit(2).alias("o"), F.lit("period_anchor").alias("purpose"), F.concat_ws(" ", F.col("text"), F.array_join("ys", " ")).alias("text"), F.lit(1.2).alias("weight"), weights(bm25=1.3).alias("lane_weights")
    )
    rows = first.unionByName(metric).unionByName(period)
    order = Window.partitionBy("query_id").orderBy("o", "text")
    return rows.withColumn("unit_id", F.concat(F.lit("u"), (F.row_number().over(order) - 1).cast("string"))).drop("o")


#: Providers that can run a unit.
PROVIDERS = ("hybrid", "graph", "sql")


def unit_tasks(units: DataFrame) -> DataFrame:
    """One task per unit: ready if a provider can run it (hybrid if none is named), else skipped."""
    named = F.coalesce("provider", F.lit("hybrid")) if "provider" in units.columns else F.lit("hybrid")
    status = F.when(named.isin(*PROVIDERS), "ready").otherwise("skipped_non_executable")
    return units.withColumn("provider", named).withColumn("status", status).withColumn("task_id", F.concat_ws(":", F.col("query_id").cast("string"), "unit_id"))


def executable(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status").isin("ready", "supported", "ok", "enabled"))


def ungrounded(query_text: Column, terms: Column) -> Column:
    """Terms of a plan that the question doesn't hold."""
    return F.filter(terms, lambda t: ~normal_term(query_text).contains(normal_term(t)))


def validate_plan(plans: DataFrame) -> DataFrame:
    """(query_id, reasons) for plans (query_id, text, entities, periods, terms, weights): empty if all is grounded and sound."""
    checks = [F.when(F.size(ungrounded(F.col("text"), F.col(c))) > 0, f"ungrounded_{c}") for c in ("entities", "periods", "terms")]
    checks.append(F.when(F.exists("weights", lambda w: w < 0), "negative_weight"))
    return plans.select("query_id", F.array_compact(F.array(*checks)).alias("reasons"))


class Router:
    """Runs tasks by provider. A provider is a function from tasks to candidates, both DataFrames; one that fails when its
    plan is built gives a status row and leaves the others alone."""

    def __init__(self, providers: dict[str, Callable[[DataFrame], DataFrame]]):
        self.providers = dict(providers)

    def register(self, name: str, provider: Callable[[DataFrame], DataFrame]) -> None:
        self.providers[name] = provider

    def run(self, tasks: DataFrame) -> tuple[DataFrame | None, dict[str, str]]:
        """(candidates of all providers as one lazy union, status of each provider)."""
        found, status = None, {}
        ready = executable(tasks)
        for name, provider in self.providers.items():
            try:
                rows = provider(ready.filter(F.col("provider") == name)).withColumn("provider", F.lit(name))
                rows.schema  # noqa: B018  an unsound plan fails here
                status[name] = "planned"
            except Exception as e:
                status[name] = f"failed: {type(e).__name__}"
                continue
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        return found, status


def canonical(value) -> str:
    """JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


#: Parts of a request that don't change its answer.
VOLATILE = ("request_id", "trace_id", "timestamp", "latency_ms")


def cache_key(question: str, config: dict) -> str:
    text = re.sub(r"\s+", " ", question).strip().lower()
    return hashlib.sha256(canonical({"q": text, "c": {k: v for k, v in config.items() if k not in VOLATILE}}).encode()).hexdigest()


def cache_policy(option: str | bool | None, default: bool = True) -> str:
    if option in ("bypass", "refresh"):
        return "bypassed"
    on = default if option is None else option in (True, "on", "enabled", "true", "1")
    return "enabled" if on else "disabled"


def live_entries(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired; without a time of expiry they never do."""
    return cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


class QueryCache:
    """Answers by key in a Parquet table: each put adds a row, and the newest row of a key that hasn't expired is its answer."""

    KIND = "key string, answer string, confidence string, created_at timestamp, expires_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, answers: DataFrame) -> None:
        """Add those of the answers (the columns of KIND) that are worth keeping."""
        admit(answers).select("key", "answer", "confidence", "created_at", "expires_at").write.mode("append").parquet(self.path)

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        """(key, answer, confidence) of the keys that have a live answer."""
        try:
            held = self.spark.read.schema(self.KIND).parquet(self.path)
        except AnalysisException:  # nothing was put yet
            held = self.spark.createDataFrame([], self.KIND)
        live = live_entries(held, now).join(keys.select("key").distinct(), "key", "left_semi")
        newest = live.groupBy("key").agg(F.max_by(F.struct("answer", "confidence"), F.struct("created_at", "answer")).alias("x"))
        return newest.select("key", "x.answer", "x.confidence")


def admit(answers: DataFrame) -> DataFrame:
    """Answers worth caching: those the evidence supports."""
    return answers.filter(F.col("confidence") == "supported")
