"""Writing index tables and artifacts: versions, duplicates skipped, and a log of commits that says what is current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators import lexical_index, vector_index
from tarn.scratch import materialize
from tarn.sources import commits


def new_documents(incoming: DataFrame, known: DataFrame, key: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(to load, skipped as duplicates): content already known, or seen before among the incoming rows (by uri)."""
    order = Window.partitionBy(key).orderBy("uri")
    rows = incoming.withColumn("_n", F.row_number().over(order)).join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    fresh = F.col("_known").isNull() & (F.col("_n") == 1)
    return rows.filter(fresh).drop("_n", "_known"), rows.filter(~fresh).drop("_n", "_known")


def dedupe_records(rows: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first record of each key, keys whose records differ)."""
    body = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c not in order])), 256)
    marked = rows.withColumn("_h", body).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    clash = marked.groupBy(*key).agg(F.count_distinct("_h").alias("versions")).filter("versions > 1")
    return marked.filter("_n = 1").drop("_h", "_n"), clash


def write_index(chunks: DataFrame, path: str, version: str, id_col: str = "chunk_id", text_col: str = "text") -> None:
    """A version's chunks and their lexical index, in one commit of the log at ``path``; a rerun gives the version new tables, and readers of
    the old ones keep them."""
    spark = chunks.sparkSession
    stored = commits.stage(chunks, path, f"chunks-{version}")
    rows = spark.read.schema(chunks.schema).parquet(f"{path}/{stored['folders'][0]}")
    folder = f"data/lexical-{version}-{uuid.uuid4().hex[:16]}"
    lexical_index.build(rows, f"{path}/{folder}", id_col, text_col)
    lexical = {"kind": "lexical", "folders": [folder]}
    commits.commit(spark, path, lambda _: {f"chunks-{version}": stored, f"lexical-{version}": lexical})


def promote(spark: SparkSession, path: str, version: str) -> None:
    """Make a version current if its tables are there; the pointer is a part of the commit, so it moves in one step."""

    def change(base: commits.Snapshot) -> dict:
        for table in ("chunks", "lexical"):
            if f"{table}-{version}" not in base.tables:
                raise ValueError(f"version {version} has no table {table}")
        return {"current": {"version": version}}

    commits.commit(spark, path, change)


def current(spark: SparkSession, path: str) -> str:
    return commits.snapshot(spark, path).tables["current"]["version"]


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, version: str | None = None, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank): BM25 over a version's chunks (the current one's, if none is named), from its index alone."""
    at = commits.snapshot(spark, path)
    version = version or at.tables["current"]["version"]
    index = lexical_index.load(spark, f"{path}/{at.tables[f'lexical-{version}']['folders'][0]}")
    return lexical_index.search(index, queries, k, id_col=id_col)


def write_vectors(vectors: DataFrame, path: str, version: str, id_col: str = "chunk_id", vec_col: str = "embedding") -> None:
    """Upsert unit vectors by id into a version's table: ids that are given replace their old vectors, others stay.

    Vectors are normalised once here, so that scoring is a product; null and zero vectors have no row of their own, and leave what
    their id has. Point ids are hashes of the chunk's id, so that a replay writes the same points. Only the buckets of the given
    ids are written anew.
    """
    from tarn.functions.text import stable_id

    norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    given = vectors.select(F.col(id_col), F.col(vec_col).alias("v"), norm.alias("norm")).filter("norm > 0")
    rows = given.select(id_col, stable_id("point", F.col(id_col)).alias("point_id"), F.transform("v", lambda x: x.cast("double") / F.col("norm")).alias("unit")).dropDuplicates([id_col])
    commits.upsert(materialize(rows, "given-vectors"), path, f"vectors-{version}", id_col)


def build_vector_index(spark: SparkSession, path: str, version: str, id_col: str = "chunk_id", **parameters) -> vector_index.VectorIndex:
    """An inverted-file index of a version's vectors as they are now, named by the next commit; `search_vectors` uses the newest."""
    folder = f"data/cells-{version}-{uuid.uuid4().hex[:16]}"
    made = vector_index.build(commits.read(spark, path, f"vectors-{version}"), f"{path}/{folder}", id_col=id_col, vec_col="unit", **parameters)
    commits.commit(spark, path, lambda _: {f"cells-{version}": {"kind": "cells", "folders": [folder]}})
    return made


def search_vectors(spark: SparkSession, path: str, version: str, queries: DataFrame, k: int, id_col: str = "chunk_id", **parameters) -> DataFrame:
    """(query_id, id, score, rank): a version's nearest vectors by cosine, through its index; see `vector_index.search`."""
    at = commits.snapshot(spark, path)
    made = vector_index.load(spark, f"{path}/{at.tables[f'cells-{version}']['folders'][0]}")
    return vector_index.search(made, queries, k, id_col=id_col, **parameters)


def load_new(incoming: DataFrame, path: str, key: str = "content_hash") -> DataFrame:
    """Append the documents whose content isn't in the table ``documents`` at ``path`` yet; (status, n) of what was loaded and skipped.

    Loads at the same time don't load the same content twice: the one that commits later looks again at what is known.
    """
    spark, counts = incoming.sparkSession, {}

    def change(base: commits.Snapshot) -> dict:
        old = base.tables.get("documents")
        known = commits.read(spark, path, "documents", base) if old else incoming.limit(0)
        fresh, skipped = new_documents(incoming, known, key)
        new = commits.stage(fresh, path, "documents")
        counts["loaded"] = spark.read.schema(fresh.schema).parquet(f"{path}/{new['folders'][0]}").count()
        counts["skipped_duplicate"] = skipped.count()
        return {"documents": old | {"folders": old["folders"] + new["folders"]} if old else new}

    commits.commit(spark, path, change)
    return spark.createDataFrame([(s, n) for s, n in counts.items() if n], "status string, n long")


def discard(spark: SparkSession, path: str, version: str) -> bool:
    """Take a version's tables out, as after a failed load, in one commit; whether it had any. Their folders go with `commits.vacuum`."""
    names = [f"{t}-{version}" for t in ("chunks", "lexical", "vectors", "cells")]
    found = [n for n in names if n in commits.snapshot(spark, path).tables]
    if found:
        commits.commit(spark, path, lambda _: dict.fromkeys(names))
    return bool(found)


def take_back(spark: SparkSession, path: str, document_ids: DataFrame, tables: dict[str, str]) -> commits.Snapshot:
    """Compensate a failed load: the rows of some documents leave several tables (name -> the column of the document's id) in one commit."""

    def change(base: commits.Snapshot) -> dict:
        gone = document_ids.select(F.col(document_ids.columns[0]).alias("_gone")).distinct()
        present = {n: c for n, c in tables.items() if n in base.tables}
        return {n: commits.stage(commits.read(spark, path, n, base).join(gone, F.col(c) == F.col("_gone"), "left_anti"), path, n) for n, c in present.items()}

    return commits.commit(spark, path, change)


MATERIALIZE = ("none", "facts", "full")


def write_artifacts(records: dict[str, DataFrame], path: str, policy: str = "full", keys: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Record sets as JSON lines and CSV, and a manifest with their counts; ``facts`` keeps tables and facts, ``none`` the manifest only.

    Of records that share a key (``keys``: set -> columns) the first by content stays; how many keys differ in content is in
    the manifest. All of it is one commit of the log at ``path``, under the names of the sets, those with ``_csv``, and ``manifest``: a
    reader (`commits.read`) finds all of it or what was there before.
    """
    if policy not in MATERIALIZE:
        raise ValueError(f"unknown policy {policy}")
    kept = {"none": (), "facts": ("tables", "facts"), "full": tuple(records)}[policy]
    counts, conflicts = {}, {}
    spark = next(iter(records.values())).sparkSession
    staged = {}
    for name, df in records.items():
        if keys and name in keys:
            marked = df.withColumn("_body", F.to_json(F.struct(*df.columns)))
            first, clash = dedupe_records(marked, keys[name], ["_body"])
            conflicts[name] = marked.groupBy(*keys[name]).agg(F.count_distinct("_body").alias("n")).filter("n > 1").count()
            df = first.drop("_body")
        if name in kept:
            flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
            staged[name] = commits.stage(df, path, name, "json")
            staged[f"{name}_csv"] = commits.stage(flat, path, f"{name}_csv", "csv", header=True)
            df = spark.read.schema(df.schema).json(f"{path}/{staged[name]['folders'][0]}")
        counts[name] = df.count()
    manifest = {"schema_version": "1", "policy": policy, "counts": counts, "conflicts": conflicts}
    staged["manifest"] = commits.stage(spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1), path, "manifest", "text")
    commits.commit(spark, path, lambda _: staged)
    return counts
