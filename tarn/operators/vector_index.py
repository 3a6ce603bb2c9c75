"""An inverted-file index of vectors: cells around centroids are partitions of a table, and a search opens few of them.

Each cell keeps how far its members lie from its centroid. That bounds the cosine of a query with any member, so that a search can
tell which closed cells could still matter and open just those: the result is then the one of a whole scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators.retrieval import _best, query_blocks
from tarn.scratch import materialize
from tarn.session import ship, spread

MOST_CELLS = 4096
#: Rows of the fit at most, those with the smallest hashes of their ids: a bounded sample, whatever the table's size.
SAMPLE = 65_536
ROWS_A_FILE = 500_000
#: A score is rounded to six places, and a bound of doubles may be off in its last ones.
SLACK = 1e-6


@dataclass
class VectorIndex:
    """What a search needs beside the table of cells: a row of facts a cell, at most MOST_CELLS of them."""

    path: str
    cells: np.ndarray  # numbers of the cells that have rows
    centroids: np.ndarray  # their unit centroids
    angles: np.ndarray  # the largest angle between a centroid and a member
    rows: np.ndarray
    probes: int  # cells that a query opens first


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if hasattr(column, "tolist") else list(column), np.float64)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of a sample by spherical k-means, starting from evenly spread rows; cells that run empty take the rows
    that fit their own centroid worst."""
    x = _unit(sample)
    centroids = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        scores = x @ centroids.T
        own = scores.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = x[np.argsort(scores.max(axis=1), kind="stable")[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def fit_probes(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, asked: int = 256) -> int:
    """How many nearest cells hold the share ``recall`` of the k nearest neighbours, within the sample, of some of its rows.

    Neighbours in a sample lie farther away than those in the whole table, in later cells if anything.
    """
    x = _unit(sample)
    rows = np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)
    scores = x[rows] @ x.T
    scores[np.arange(len(rows)), rows] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : max(0, min(k, len(x) - 1))]
    place = np.argsort(np.argsort(-(x[rows] @ centroids.T), axis=1, kind="stable"), axis=1)
    own = (x @ centroids.T).argmax(axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel() + 1)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1


def _assigned(centroids: np.ndarray):
    def run(batches):
        for b in batches:
            if len(b):
                scores = _unit(_matrix(b["v"])) @ centroids.T
                cell = scores.argmax(axis=1)
                b["cell"], b["angle"] = cell.astype(np.int32), np.arccos(np.clip(scores[np.arange(len(b)), cell], -1, 1))
                yield b

    return run


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding", rows_a_file: int = ROWS_A_FILE, recall: float = 0.97, fitted: VectorIndex | None = None) -> VectorIndex:
    """Write every vector into its cell (``path/vectors``, partitioned by cell) and a table of the cells (``path/cells``).

    Centroids are fitted on a sample of at most ``sample`` rows, unless those of a ``fitted`` index are taken over; all rows are assigned.
    Without a number there are about as many cells as the root of the rows, at most MOST_CELLS. How many cells a query opens follows
    from the share ``recall`` of neighbours to be found (`fit_probes`). A cell's rows are dealt to as many files as they fill, so a cell that holds a third of the
    table is written by many tasks. Null, empty and zero vectors and those with null or non-finite components have no row; all others
    must have one length. The folder must be new: readers of another version keep theirs.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(usable)
    kinds = dict(rows.dtypes)
    if fitted is not None:
        centroids, probes = fitted.centroids, fitted.probes
    else:
        cells = max(1, min(cells or round(rows.count() ** 0.5), MOST_CELLS))
        taken = rows.orderBy(F.xxhash64("id"), "v").select("v").limit(min(sample, max(64 * cells, 1024))).toPandas()
        if len({len(v) for v in taken["v"]}) > 1:
            raise ValueError("vectors of an index have one length")
        matrix = _matrix(taken["v"])
        centroids = fit_centroids(matrix, cells) if len(taken) else np.zeros((0, 1))
        probes = fit_probes(matrix, centroids, recall) if len(taken) else 1
    schema = f"id {kinds['id']}, v {kinds['v']}, cell int, angle double"
    dealt = materialize(spread(rows).mapInPandas(_assigned(centroids), schema), "cells")
    facts = dealt.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("angle")).orderBy("cell").toPandas()
    # A row a cell, so the table that deals rows to files has a proven size.
    files = spark.createDataFrame([(int(c), max(1, -(-int(k) // rows_a_file))) for c, k in zip(facts["cell"], facts["rows"], strict=True)], "cell int, files int")
    salted = dealt.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("id", "v"), F.col("files")))
    tasks = int(max(1, min(sum(max(1, -(-int(k) // rows_a_file)) for k in facts["rows"]), 20_000)))
    salted.repartition(tasks, "cell", "file").select("id", "v", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    about = [(int(c), centroids[c].tolist(), float(a), int(k), probes) for c, a, k in zip(facts["cell"], facts["angle"], facts["rows"], strict=True)]
    spark.createDataFrame(about, "cell int, centroid array<double>, angle double, rows long, probes int").coalesce(1).write.parquet(f"{path}/cells")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """A written index: the facts of its cells."""
    about = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
    return VectorIndex(path, about["cell"].to_numpy(np.int32), _matrix(about["centroid"]) if len(about) else np.zeros((0, 1)), about["angle"].to_numpy(np.float64), about["rows"].to_numpy(np.int64), int(about["probes"].max()) if len(about) else 1)


def bounds(index: VectorIndex, queries: np.ndarray) -> np.ndarray:
    """What the cosine of a query (a unit row) with any member of a cell is at most."""
    away = np.arccos(np.clip(queries @ index.centroids.T, -1, 1)) - index.angles
    return np.where(away > 0, np.cos(np.maximum(away, 0)), 1.0)


def _open(index: VectorIndex, spark: SparkSession, ids: list, matrix: np.ndarray, wanted: np.ndarray, k: int, query_kind: str) -> DataFrame:
    """(query_id, id, score): each task's k best per query, where ``wanted`` (query x cell) says who looks where. Cells nobody asks for are
    not read: the condition is on the partition column."""
    held = spark.sparkContext.broadcast((ids, matrix, wanted, {int(c): i for i, c in enumerate(index.cells)}))
    table = spark.read.parquet(f"{index.path}/vectors")
    asked = [int(c) for c in index.cells[wanted.any(axis=0)]]
    kind = dict(table.dtypes)["id"]

    def score(batches):
        import pandas as pd

        ids, q, wanted, at = held.value
        best = None
        for b in batches:
            for cell, part in b.groupby("cell"):
                who = np.flatnonzero(wanted[:, at[int(cell)]])
                s = np.round(q[who] @ _unit(_matrix(part["v"])).T, 6)
                if s.shape[1] > k:  # what ties with the k-th stays until ids decide
                    keep = s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    row, col = np.nonzero(keep)
                else:
                    row, col = np.nonzero(np.ones(s.shape, bool))
                found = who[row], s[row, col], part["id"].to_numpy()[col]
                best = _best(*(found if best is None else (np.concatenate(x) for x in zip(best, found, strict=True))), k)
        if best is not None:
            yield pd.DataFrame({"query_id": [ids[i] for i in best[0]], "id": best[2], "score": best[1]})

    return table.filter(F.col("cell").isin(asked) if asked else F.lit(False)).mapInPandas(score, f"query_id {query_kind}, id {kind}, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, query_id: str = "query_id", vec_col: str = "embedding", id_col: str = "vec_id", max_queries: int = 4096, report: list[dict] | None = None
) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors by cosine in double precision, ties by id.

    A query opens the ``probes`` cells (the index's own number if none is given) whose centroids are nearest. That is approximate; with ``exact`` it then opens every further cell whose
    bound reaches the k-th score found so far, and the result is that of a whole scan. ``report`` gets, for each block of
    queries, how many cells were opened, and how many queries were shown to be exact by the first probes alone. Zero queries score 0
    everywhere and null ones find nothing.

    Queries come in blocks; a block goes to every task, tasks send their k best per query.
    """
    spark = queries.sparkSession
    ship(spark)
    kind = dict(queries.dtypes)[query_id]
    found = []
    for rows in query_blocks(queries.filter(F.col(vec_col).isNotNull()).select(query_id, vec_col), query_id, max_queries):
        if not rows or not len(index.cells):
            continue
        ids, matrix = [r[0] for r in rows], _unit(np.array([r[1] for r in rows], np.float64))
        near = np.argsort(-(matrix @ index.centroids.T), axis=1, kind="stable")[:, : probes or index.probes]
        wanted = np.zeros((len(ids), len(index.cells)), bool)
        np.put_along_axis(wanted, near, True, axis=1)
        hits = _ranked(_open(index, spark, ids, matrix, wanted, k, kind), k)
        hits = materialize(hits, "probed")
        # one number a query of the block
        least = {r[0]: (r["n"], r["least"]) for r in hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect()}
        floor = np.array([least[i][1] if i in least and least[i][0] >= k else -np.inf for i in ids])
        more = ~wanted & (bounds(index, matrix) + SLACK >= floor[:, None])
        if report is not None:
            report.append({"queries": len(ids), "cells": len(index.cells), "opened": int(wanted.any(axis=0).sum()), "certain": int((~more.any(axis=1)).sum()), "pairs": int(wanted.sum()), "more_pairs": int(more.sum()) if exact else 0})
        if exact and more.any():
            hits = _ranked(hits.drop("rank").unionByName(_open(index, spark, ids, matrix, more, k, kind)), k)
        found.append(hits)
    if not found:
        empty = spark.read.parquet(f"{index.path}/vectors") if len(index.cells) else None
        own = dict(empty.dtypes)["id"] if empty is not None else "long"
        return spark.createDataFrame([], f"query_id {kind}, {id_col} {own}, score double, rank int")
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)


def add(index: VectorIndex, vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    """A new version at ``path``: ids that are given replace their old vectors, others stay; the old version stays as it was.

    Centroids are those of the index: fit anew when the cells have become uneven.
    """
    spark = vectors.sparkSession
    if not len(index.cells):
        return build(vectors, path, id_col=id_col, vec_col=vec_col)
    old = spark.read.parquet(f"{index.path}/vectors").select("id", "v")
    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    kept = old.join(given.select("id").distinct(), "id", "left_anti")
    fields = {f.name: f.dataType for f in old.schema.fields}
    return build(kept.unionByName(given.select(F.col("id").cast(fields["id"]), F.col("v").cast(fields["v"]))), path, id_col="id", vec_col="v", fitted=index)
