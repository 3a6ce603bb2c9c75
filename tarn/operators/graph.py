"""Graph retrieval: degree-capped neighbourhoods, paths of at most two hops, entity resolution, grounding on chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import folded

DEGREE_CAP, MAX_PATHS, CHUNKS_PER_OBJECT = 25, 20, 3


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other, edge_id, confidence): each edge (source, target, edge_id, confidence) from both ends; loops once."""
    there = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "edge_id", "confidence")
    back = edges.filter("source <> target").select(F.col("target").alias("node"), F.col("source").alias("other"), "edge_id", "confidence")
    return there.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges at each node, loops once. Edges are read once, and only their ends."""
    ends = F.when(F.col("source") != F.col("target"), F.array("source", "target")).otherwise(F.array("source"))
    return edges.select(F.explode(ends).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, flagged: DataFrame | None = None, cap: int = DEGREE_CAP) -> DataFrame:
    """Nodes over the degree cap or flagged as hubs."""
    found = degrees(edges).filter(F.col("degree") > cap).select("node")
    return found if flagged is None else found.unionByName(flagged.select("node")).distinct()


def _capped(sides: DataFrame, cap: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.col("confidence").desc(), F.col("edge_id").asc())
    return sides.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap)


def neighbours(seeds: DataFrame, edges: DataFrame, cap: int = DEGREE_CAP, type_of: DataFrame | None = None, wanted: str | None = None) -> DataFrame:
    """(node, other, edge_id, confidence, rank, degree, truncated) of the seeds' strongest edges; seeds: one column node.

    With ``wanted``, only neighbours whose entity type (``type_of``: node, type) is that one.
    """
    sides = undirected(edges).join(seeds.select("node").distinct(), "node", "left_semi")
    if wanted is not None:
        right = type_of.filter(F.col("type") == wanted).select(F.col("node").alias("other"))
        sides = sides.join(right, "other", "left_semi")
    degree = sides.groupBy("node").agg(F.count("*").alias("degree"))
    kept = _capped(sides, cap).join(degree, "node")
    return kept.select("node", "other", "edge_id", "confidence", F.col("n").alias("rank"), "degree", (F.col("degree") > cap).alias("truncated"))


def paths(pairs: DataFrame, edges: DataFrame, cap: int = DEGREE_CAP, most: int = MAX_PATHS) -> DataFrame:
    """(start, goal, hops, mid, edge1, edge2, score, rank): undirected paths of one and two hops for pairs (start, goal).

    Each hop follows a node's ``cap`` strongest edges. The two edges differ, a path doesn't pass its goal, and the
    score is the mean confidence. The ``most`` best per pair stay: hops, score, edge ids.
    """
    sides = undirected(edges)
    first = _capped(sides.join(pairs.select(F.col("start").alias("node")).distinct(), "node", "left_semi"), cap).drop("n")
    one = pairs.join(first, (pairs.start == first.node) & (pairs.goal == first.other))
    one = one.select("start", "goal", F.lit(1).alias("hops"), F.lit(None).cast(dict(sides.dtypes)["node"]).alias("mid"), F.col("edge_id").alias("edge1"), F.lit(None).cast(dict(edges.dtypes)["edge_id"]).alias("edge2"), F.col("confidence").alias("score"))
    step = pairs.join(first, pairs.start == first.node).filter("other <> goal AND other <> start")
    step = step.select("start", "goal", F.col("other").alias("mid"), F.col("edge_id").alias("edge1"), F.col("confidence").alias("c1"))
    second = _capped(sides.join(step.select(F.col("mid").alias("node")).distinct(), "node", "left_semi"), cap)
    second = second.select(F.col("node").alias("mid"), F.col("other").alias("end"), F.col("edge_id").alias("edge2"), F.col("confidence").alias("c2"))
    two = step.join(second, "mid").filter("end = goal AND edge1 <> edge2")
    two = two.select("start", "goal", F.lit(2).alias("hops"), "mid", "edge1", "edge2", ((F.col("c1") + F.col("c2")) / 2).alias("score"))
    order = Window.partitionBy("start", "goal").orderBy(F.col("hops").asc(), F.col("score").desc(), F.col("edge1").asc(), F.col("edge2").asc_nulls_first())
    return one.unionByName(two).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def resolve_entities(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, entity_id, score, rank) of terms against entities (entity_id, name, aliases).

    1.0 for the canonical name, 0.95 for an alias, 0.75 and 0.70 if one contains the other. Exact matches join on the
    folded name; only terms without one are compared by containment, and only with names that share a run of characters.
    """
    from tarn.operators.retrieval import either_holds

    t = terms.select("term", folded(F.col("term")).alias("key")).distinct()
    forms = names.select("entity_id", "name", F.lit(True).alias("canonical"), folded(F.col("name")).alias("form"))
    alias = names.select("entity_id", "name", F.explode("aliases").alias("a")).select("entity_id", "name", F.lit(False).alias("canonical"), folded(F.col("a")).alias("form"))
    forms = forms.unionByName(alias).filter("form <> ''")
    exact = t.join(forms, t.key == forms.form).select("term", "entity_id", "name", F.when(F.col("canonical"), 1.0).otherwise(0.95).alias("score"))
    open_terms = t.join(exact.select("term").distinct(), "term", "left_anti")
    part = either_holds(forms, open_terms, "form", "key")
    part = part.select("term", "entity_id", "name", F.when(F.col("canonical"), 0.75).otherwise(0.70).alias("score"))
    best = exact.unionByName(part).groupBy("term", "entity_id", "name").agg(F.max("score").alias("score"))
    order = Window.partitionBy("term").orderBy(F.col("score").desc(), folded(F.col("name")).asc(), F.col("entity_id").asc())
    return best.select("term", "entity_id", "score", F.row_number().over(order).alias("rank"))


def first_resolved(*cascades: DataFrame) -> DataFrame:
    """Of resolutions in order of precedence (query_id, ...), each query's rows from the first that has any."""
    rows = None
    for i, c in enumerate(cascades):
        c = c.withColumn("priority", F.lit(i))
        rows = c if rows is None else rows.unionByName(c)
    first = rows.groupBy("query_id").agg(F.min("priority").alias("priority"))
    return rows.join(first, ["query_id", "priority"], "left_semi")


def graph_mode(entities: Column, requested: Column) -> Column:
    """path with two entities or more, local with one; modes that look at the whole graph are not supported."""
    return F.when(requested.isin("global", "community", "drift"), "unsupported").when(entities >= 2, "path").when(entities == 1, "local").otherwise("unresolved")


def ground(objects: DataFrame, anchors: DataFrame, chunks: DataFrame, cap: int = CHUNKS_PER_OBJECT) -> DataFrame:
    """(object_id, chunk_id, doc_id, rank): up to ``cap`` chunks per graph object, by chunk index and anchor id.

    anchors: anchor_id, object_id, chunk_id, and if known text_span; chunks: chunk_id, doc_id, chunk_index. Of anchors of one
    object on the same span of the same chunk the first by id counts. Objects without anchors yield nothing.
    """
    same = ["object_id", "chunk_id", *[c for c in ("text_span",) if c in anchors.columns]]
    if "text_span" in anchors.columns:
        anchors = anchors.groupBy(*same).agg(F.min("anchor_id").alias("anchor_id"))
    at = anchors.dropDuplicates(["anchor_id", *same]).join(objects.select("object_id").distinct(), "object_id", "left_semi").join(chunks, "chunk_id")
    order = Window.partitionBy("object_id").orderBy("chunk_index", "anchor_id")
    return at.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select("object_id", "chunk_id", "doc_id", "rank")


def graph_scores(objects: DataFrame, anchors: DataFrame) -> DataFrame:
    """(item_id, score, grounding) of graph items (item_id, object_id, confidence; a row per edge): the mean confidence, and 1.0
    if any of an item's objects has an anchor, else 0.0."""
    held = anchors.select("object_id").distinct().withColumn("_held", F.lit(1.0))
    rows = objects.join(held, "object_id", "left")
    return rows.groupBy("item_id").agg(F.round(F.avg("confidence"), 9).alias("score"), F.coalesce(F.max("_held"), F.lit(0.0)).alias("grounding"))


def backfill_version(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships (relationship_id, source, target, graph_version) whose missing version is that of both their ends, where
    each end (entity_id, graph_version) has exactly one version and they agree; others stay as they are."""
    one = entities.filter("graph_version IS NOT NULL").groupBy("entity_id").agg(F.min("graph_version").alias("v"), F.count_distinct("graph_version").alias("n")).filter("n = 1").select("entity_id", "v")
    rows = relationships.join(one.select(F.col("entity_id").alias("source"), F.col("v").alias("_s")), "source", "left")
    rows = rows.join(one.select(F.col("entity_id").alias("target"), F.col("v").alias("_t")), "target", "left")
    agreed = F.when(F.col("_s") == F.col("_t"), F.col("_s"))
    return rows.select("relationship_id", "source", "target", F.coalesce("graph_version", agreed).alias("graph_version"))


def in_scope(objects: DataFrame, anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Objects with an anchor on one of ``chunks``."""
    return objects.join(anchors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), "object_id", "left_semi")


def missing_chunks(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Anchors whose chunk isn't there."""
    return anchors.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
