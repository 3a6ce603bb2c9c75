"""Centroid clustering with Elkan's bounds: triangle inequalities say which distances need not be computed.

State of each vector (its cluster, an upper bound to its centroid, a lower bound to every centroid) is a table beside the vector,
written anew each round. Bounds are 32-bit numbers rounded to the safe side and pruning is strict, so that a distance that
could be smaller or equal is always computed, in whole numbers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.scratch import _drop, scratch
from tarn.session import spread

from .whitening import by_length, usable

STATE = "id {id}, x array<int>, cluster int, upper float, lower array<float>, distance long, size long, sums array<long>, computed long, kind int"
#: Components up to here: a squared distance of 64 of them fits in a long.
MOST = 1 << 27


@dataclass
class Model:
    centroids: np.ndarray  # k rows of whole numbers
    sizes: list[int] = field(default_factory=list)
    inertias: list[int] = field(default_factory=list)
    computed: list[int] = field(default_factory=list)  # distances that each assignment computed (vectors times k without bounds)


def down(x: np.ndarray) -> np.ndarray:
    """As 32-bit numbers, not above x; x itself may be off by two units in its last place."""
    x = np.nextafter(np.nextafter(x, -np.inf), -np.inf)
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def up(x: np.ndarray) -> np.ndarray:
    return -down(-x)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def all_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c, exact; as one product of doubles where those hold every sum exactly."""
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 2.0**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([squares(x, row) for row in c], axis=1)


def elkan(x: np.ndarray, old: np.ndarray, new: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """One assignment, in place: centroids have moved from ``old`` to ``new``. Returns how many distances were computed."""
    k = len(new)
    moved = np.sqrt(squares(new, old).astype(np.float64))
    lower[:] = down(lower.astype(np.float64) - moved)
    upper[:] = up(upper.astype(np.float64) + moved[a])
    between = down(np.sqrt(all_squares(new, new).astype(np.float64))).astype(np.float64)
    np.fill_diagonal(between, np.inf)  # the own centroid is never a candidate
    others = np.arange(k) != a[:, None]

    def candidates(at: np.ndarray) -> np.ndarray:
        u = upper[at].astype(np.float64)[:, None]
        return others[at] & (lower[at] <= u) & (between[a[at]] <= 2 * u)

    near = np.flatnonzero(between.min(axis=1)[a] <= 2 * upper.astype(np.float64))  # the others are nearer to theirs than any centroid is
    near = near[candidates(near).any(axis=1)]
    exact = squares(x[near], new[a[near]])
    root = np.sqrt(exact.astype(np.float64))
    upper[near], lower[near, a[near]] = up(root), down(root)
    todo = candidates(near)
    i, c = np.nonzero(todo)
    found = squares(x[near[i]], new[c])
    distances = np.full((len(near), k), np.iinfo(np.int64).max)
    distances[np.arange(len(near)), a[near]] = exact
    distances[i, c] = found
    lower[near[i], c] = down(np.sqrt(found.astype(np.float64)))
    if len(near):
        a[near] = distances.argmin(axis=1)  # the first of equals
        upper[near] = up(np.sqrt(distances.min(axis=1).astype(np.float64)))
    return len(near) + len(i)


def _totals(x: np.ndarray, a: np.ndarray, distance: np.ndarray | None, k: int, held: dict) -> None:
    for c in np.unique(a).tolist():
        at = a == c
        size, sums, inertia = held.get(c, (0, 0, 0))
        held[c] = size + int(at.sum()), sums + x[at].sum(axis=0, dtype=np.int64), inertia + (sum(distance[at].tolist()) if distance is not None else 0)


def _assign(id_type, old, new, last: bool):
    """A pass over the vectors: new state, and at the end of a partition what each cluster's vectors add up to (kind 1).

    Both are rows of one file, as a table partitioned by kind would sort all vectors by it. Of a vector's row the sums are null, so
    that reading them costs next to nothing.
    """

    def run(batches):
        import pyarrow as pa

        ints, wide = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = [("id", id_type), ("x", ints), ("cluster", pa.int32()), ("upper", pa.float32()), ("lower", pa.list_(pa.float32())), ("distance", pa.int64()), ("size", pa.int64()), ("sums", wide), ("computed", pa.int64()), ("kind", pa.int32())]
        schema = pa.schema(kinds)
        k, dim = new.shape
        held, computed = {}, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column("x").flatten().to_numpy().reshape(n, dim)
            if old is None:
                exact = all_squares(x, new)
                a, root = exact.argmin(axis=1), np.sqrt(exact.astype(np.float64))
                lower, upper, computed = down(root), up(root.min(axis=1)), computed + n * k
            else:
                a, upper = b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy().copy()
                lower = b.column("lower").flatten().to_numpy().reshape(n, k).copy()
                computed += elkan(x, old, new, a, upper, lower)
            distance = squares(x, new[a]) if last else None
            _totals(x, a, distance, k, held)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * k)
            data = {"id": b.column("id"), "x": b.column("x").cast(ints), "cluster": pa.array(a.astype(np.int32)), "upper": pa.array(upper), "lower": pa.ListArray.from_arrays(ends, pa.array(lower.ravel())), "kind": pa.array(np.zeros(n, np.int32))}
            data |= {"distance": pa.array(distance)} if last else {}
            yield pa.RecordBatch.from_arrays([data.get(name, pa.nulls(n, kind)).cast(kind) for name, kind in kinds], schema=schema)
        rows = [{"cluster": c, "size": size, "sums": sums.tolist(), "distance": inertia, "kind": 1} for c, (size, sums, inertia) in held.items()]
        if rows:
            yield pa.RecordBatch.from_pylist([r | {"computed": computed if i == 0 else 0} for i, r in enumerate(rows)], schema=schema)

    return run


def _whole(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; refused beyond MOST."""

    def one(x: Column) -> Column:
        v = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(v) <= MOST, v).otherwise(F.raise_error(F.lit("a vector's component is too large for exact distances")).cast("long")).cast("int")

    return F.transform(vec, one)


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, salt: str = "3:"
) -> tuple[DataFrame, Model]:
    """Rows (id, cluster int, distance long) of all vectors with exactly ``dim`` usable components, and the model.

    Components x become floor(scale * x). The first centroids are the vectors with the smallest SHA-256 of salt and id (null ids last;
    equal ids by their vectors), so equal vectors can make equal centroids, of which the smaller number gets all. Each round assigns
    every vector to its nearest centroid (of equals the smaller number) and moves centroids to the floor of their vectors' means; empty ones stay.
    A last assignment follows. With fewer vectors than k there are as many centroids as vectors. Vectors that are null, of another length,
    or with null or non-finite components are left out; null ids stay null, repeated rows count each, other columns are not read, an empty
    table gives no rows. Components whose whole number is beyond 2^27 are refused with an error, as their distances may not fit.

    One pass over the state a round; vectors are never shuffled, and a task sends k sums. The state of a round is written to the shared
    folder and the one before it dropped: a lost executor costs its running tasks only.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter((F.size("vec") == dim) & usable(F.col("vec")))
    rows = rows.select("id", _whole(F.col("vec"), scale).alias("x"))
    first = rows.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    schema = STATE.format(id=dict(rows.dtypes)["id"])
    if not first:
        return spark.createDataFrame([], schema).select(F.col("id").alias(id_col), "cluster", "distance"), Model(np.zeros((0, dim), np.int64))
    model = Model(np.array([r.x for r in first], np.int64))
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    state, old, before = spread(rows), None, None
    for i in range(rounds + 1):
        last = i == rounds
        path = f"{scratch(spark)}/clusters-{uuid.uuid4().hex[:12]}"
        state.mapInArrow(_assign(id_type, old, model.centroids, last), schema).write.parquet(path)
        written = spark.read.schema(schema).parquet(path)
        sums = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(dim)]
        found = written.filter("kind = 1").groupBy("cluster").agg(F.sum("size").alias("size"), F.sum("distance").alias("inertia"), F.sum("computed").alias("computed"), *sums).collect()
        by = {r.cluster: r for r in found}
        model.computed.append(sum(r.computed for r in found))
        old = model.centroids
        if not last:
            model.centroids = np.array([[by[c][f"s{j}"] // by[c].size for j in range(dim)] if c in by else old[c].tolist() for c in range(len(old))], np.int64)
        else:
            model.sizes = [by[c].size if c in by else 0 for c in range(len(old))]
            model.inertias = [int(by[c].inertia) if c in by else 0 for c in range(len(old))]
        state = written.filter("kind = 0").select("id", "x", "cluster", "upper", "lower")
        if before:
            _drop(spark, before)
        before = path
    return written.filter("kind = 0").select(F.col("id").alias(id_col), "cluster", "distance"), model


def clusters_with_totals(vectors: DataFrame, **parameters) -> DataFrame:
    """`cluster` with what each cluster adds up to: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    import hashlib

    rows, model = cluster(vectors, **parameters)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids.tolist()]
    facts = list(zip(range(len(hashes)), model.inertias, hashes, strict=False))
    facts = F.broadcast(rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string"))
    return rows.join(facts, "cluster").withColumn("inertia", F.lit(sum(model.inertias)).cast("long")).select(rows.columns[0], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
