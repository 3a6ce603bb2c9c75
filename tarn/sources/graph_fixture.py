"""Loading a versioned graph from JSON: structure is checked on load, references by anti-joins, replays by hash."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.graph import DEGREE_CAP, degrees

VERSION = "graph-tables-1"
KEYS = {"schema_version", "graph_version", "corpus_version", "metadata", "entities", "relationships", "communities"}
ANCHOR = "anchors array<struct<anchor_id string, chunk_id string, text_span string>>"
SCHEMA = (
    "schema_version string, graph_version string, corpus_version string, metadata map<string,string>, "
    f"entities array<struct<entity_id string, canonical_name string, entity_type string, aliases array<string>, description string, metadata map<string,string>, {ANCHOR}>>, "
    f"relationships array<struct<relationship_id string, source_entity_id string, target_entity_id string, relation_type string, confidence double, description string, metadata map<string,string>, {ANCHOR}>>, "
    "communities array<struct<community_id string, level int, summary string, metadata map<string,string>>>"
)


class GraphError(ValueError):
    pass


def content_hash(text: str) -> str:
    return hashlib.sha256(json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def load(spark: SparkSession, path: str, version: str = VERSION) -> tuple[dict[str, DataFrame], str]:
    """(tables, hash) of one graph file: entities, relationships, anchors, communities, hubs. GraphError says what is wrong."""
    text = spark.read.text(path, wholetext=True).first()[0]
    top = json.loads(text)
    if unknown := set(top) - KEYS:
        raise GraphError(f"unknown keys: {sorted(unknown)}")
    if top.get("schema_version") != version:
        raise GraphError("unsupported schema version")
    one = spark.read.schema(SCHEMA).json(path, multiLine=True)
    rows = lambda name: one.select("graph_version", F.explode(name).alias("x")).select("graph_version", "x.*")
    entities, relationships, communities = rows("entities"), rows("relationships"), rows("communities")
    anchors = None
    for kind, df, key in (("entity", entities, "entity_id"), ("relationship", relationships, "relationship_id")):
        part = df.select(F.lit(kind).alias("kind"), F.col(key).alias("object_id"), F.explode("anchors").alias("a")).select("kind", "object_id", "a.*")
        anchors = part if anchors is None else anchors.unionByName(part)
    edges = relationships.select(F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target"), F.col("relationship_id").alias("edge_id"), "confidence")
    flagged = entities.filter(F.lower(F.col("metadata")["hub"]) == "true").select(F.col("entity_id").alias("node"))
    hubs = degrees(edges).filter(F.col("degree") > DEGREE_CAP).select("node").unionByName(flagged).distinct()
    return {"entities": entities.drop("anchors"), "relationships": relationships.drop("anchors"), "anchors": anchors, "communities": communities, "hubs": hubs}, content_hash(text)


def problems(tables: dict[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """(problem, id): duplicate ids, relationships to unknown entities, anchors on unknown chunks, a graph without a hub."""
    e, r, a = tables["entities"], tables["relationships"], tables["anchors"]
    twice = lambda df, key, name: df.groupBy(key).count().filter("count > 1").select(F.lit(name).alias("problem"), F.col(key).alias("id"))
    known = e.select(F.col("entity_id").alias("known"))
    loose = lambda c: r.join(known, F.col(c) == F.col("known"), "left_anti").select(F.lit(f"unknown {c}").alias("problem"), F.col("relationship_id").alias("id"))
    missing = a.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select(F.lit("missing chunk").alias("problem"), F.col("anchor_id").alias("id"))
    no_hub = tables["hubs"].agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("no hub").alias("problem"), F.lit("").alias("id"))
    parts = [twice(e, "entity_id", "duplicate entity"), twice(r, "relationship_id", "duplicate relationship"), twice(a.withColumn("k", F.concat_ws(":", "kind", "anchor_id")), "k", "duplicate anchor")]
    out = parts[0]
    for p in [*parts[1:], loose("source_entity_id"), loose("target_entity_id"), missing, no_hub]:
        out = out.unionByName(p)
    return out


def store(tables: dict[str, DataFrame], digest: str, path: str, chunks: DataFrame, replace: bool = False) -> str:
    """Write a version's tables under ``path``: loaded, unchanged (same hash) or replaced; another hash without ``replace`` is an error."""
    spark = chunks.sparkSession
    found = problems(tables, chunks).limit(20).collect()
    if found:
        raise GraphError("; ".join(f"{p.problem} {p.id}".strip() for p in found))
    version = tables["entities"].select("graph_version").first()
    base = f"{path}/graph_version={version[0] if version else 'none'}"
    try:
        old = spark.read.text(f"{base}/hash").first()[0]
    except Exception:
        old = None
    if old == digest:
        return "unchanged"
    if old and not replace:
        raise GraphError("this version holds another graph")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/hash")
    return "replaced" if old else "loaded"
