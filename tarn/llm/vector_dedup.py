"""Near-duplicate vectors by Euclidean p-stable hashing: quantised random projections in several tables, then exact cosines.

What moves between tasks is narrow until it is known to be needed. Equal vectors are made one with a count. A two-pass
Bloom filter over the bucket numbers of all tables says which buckets may have two vectors; only those rows leave their
task, with a sketch of 64 signs. Small buckets keep the members whose sketch has a close one there. Vectors themselves are
only sent to buckets in which they are left, and compared there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, whole_runs
from .components import components
from .repeats import may_repeat, probe, repeat_filter
from .shingles import mixed

BLOCK = 1024  # vectors of a bucket that one task compares with as many others
SMALL = 64  # members of a bucket up to which sketches are compared first


def same_cell(cosine: float, width: float) -> float:
    """Chance that two unit vectors of this cosine fall into one cell of a quantised Gaussian projection."""
    r = math.sqrt(max(0.0, 2 - 2 * cosine))
    if r == 0:
        return 1.0
    c = width / r
    return math.erf(c / math.sqrt(2)) - math.sqrt(2 / math.pi) / c * (1 - math.exp(-c * c / 2))


def miss_probability(cosine: float, tables: int, projections: int, width: float) -> float:
    """Chance that a pair of exactly this cosine shares no bucket in any table."""
    return (1 - same_cell(cosine, width) ** projections) ** tables


def table_plan(n: int, threshold: float, width: float, miss: float, strangers: float) -> tuple[int, int]:
    """(tables, projections): as many projections as leave a vector ``strangers`` unrelated ones a bucket among ``n``, and as many
    tables as miss a pair exactly at the threshold with a chance of at most ``miss``."""
    projections = max(4, math.ceil(math.log(max(n, 2) / strangers) / -math.log(same_cell(0.0, width))))
    together = same_cell(threshold, width) ** projections
    return (1 if together >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - together)))), projections


def sketch_distance(threshold: float, miss: float) -> int:
    """Signs of 64 in which a pair at the threshold differs more often with a chance of at most ``miss`` only."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    tail, most = 1.0, -1
    while tail > miss and most < 64:
        most += 1
        tail = max(0.0, tail - math.comb(64, most) * p**most * (1 - p) ** (64 - most))
    return most


class Projector:
    """Bucket numbers and sketches of unit vectors; made of a seed, so that every task has the same."""

    def __init__(self, tables: int, projections: int, width: float, seed: int):
        self.tables, self.projections, self.width, self.seed, self.plans = tables, projections, width, seed, {}

    def __getstate__(self):
        return self.__dict__ | {"plans": {}}

    def _plan(self, dim: int) -> tuple:
        if dim not in self.plans:
            g = np.random.Generator(np.random.PCG64([self.seed, dim]))
            n = self.tables * self.projections
            odd = g.integers(1, 1 << 62, self.projections, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            self.plans[dim] = g.standard_normal((dim, n)), g.uniform(0, self.width, n), odd, g.standard_normal((dim, 64))
        return self.plans[dim]

    def keys(self, unit: np.ndarray, labels: list[str]) -> np.ndarray:
        """The bucket of each vector in each table; label and dimension are part of its number."""
        import xxhash

        a, shift, odd, _ = self._plan(unit.shape[1])
        number = {x: xxhash.xxh3_64_intdigest(f"{unit.shape[1]}:{x}") for x in set(labels)}
        own = np.fromiter((number[x] for x in labels), np.uint64, len(labels))
        out = np.empty((len(unit), self.tables), np.uint64)
        salt = mixed(np.arange(1, self.tables + 1, dtype=np.uint64))
        for i in range(0, len(unit), 4096):
            cells = np.floor((unit[i : i + 4096] @ a + shift) / self.width).astype(np.int64).view(np.uint64)
            summed = (cells.reshape(-1, self.tables, self.projections) * odd).sum(axis=2, dtype=np.uint64)
            out[i : i + 4096] = mixed(mixed(summed + salt) ^ own[i : i + 4096, None])
        return out.view(np.int64)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        signs = unit @ self._plan(unit.shape[1])[3] > 0
        return np.packbits(signs, axis=1).view(np.int64).ravel()


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one dimension, from the bytes of their numbers, at length 1 in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_size(raw: pd.Series) -> Iterator[np.ndarray]:
    size = raw.str.len().to_numpy()
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def _read(kind: str, id_col: str, label_col: str, vec_col: str):
    """Rows with the bytes of usable vectors (null for others), and a hash of label and vector."""
    import pyarrow as pa

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            vectors, labels = b.column(vec_col), b.column(label_col).cast(pa.string()).to_pylist()
            n = len(vectors)
            sizes = np.array(vectors.value_lengths().fill_null(0), np.int64)
            flat = vectors.flatten()
            given = np.array(flat.is_valid())
            values = np.array(flat.fill_null(0)).astype(kind)
            ends = np.cumsum(sizes)
            good = np.isfinite(values) & given
            # Prefix counts: how many good and how many non-zero numbers a vector has.
            count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], ends])])
            usable = (sizes > 0) & (count(good) == sizes) & (count(values != 0) > 0)
            raw = [values[e - k : e].tobytes() if ok else None for e, k, ok in zip(ends.tolist(), sizes.tolist(), usable.tolist(), strict=True)]
            raw = [None if x is None else r for r, x in zip(raw, labels, strict=True)]
            h = [None if r is None else xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass") + b"\0" + r) for r, x in zip(raw, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), pa.array(labels, pa.string()), pa.array(raw, pa.binary()), pa.array(h, pa.binary())], ["vec_id", "label", "raw", "h"])

    return run


def _all_keys(project: Projector, kind: str):
    def run(b: pd.DataFrame) -> np.ndarray:
        parts = [project.keys(_units(b["raw"].iloc[at].tolist(), kind), b["label"].iloc[at].tolist()).ravel() for at in _by_size(b["raw"])]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    return run


def _met(project: Projector, kind: str, held):
    """A row for each bucket of a vector that may have another one: (bucket, place, rid, sketch); place: the number of its table."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in _by_size(b["raw"]):
                unit = _units(b["raw"].iloc[at].tolist(), kind)
                keys, sketch = project.keys(unit, b["label"].iloc[at].tolist()), project.sketch(unit)
                row, place = np.nonzero(probe(keys.ravel(), held).reshape(keys.shape))
                yield pd.DataFrame({"bucket": keys[row, place], "place": place.astype(np.int32), "rid": b["rid"].to_numpy(np.int64)[at[row]], "sketch": sketch[row]})

    return run


def _spanning(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n items, the smallest item that the links (p, q) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, label[p], low)
        np.minimum.at(new, label[q], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(unit: np.ndarray, own: np.ndarray, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of block i with rows of block j that reach the threshold, each once."""
    if i == j:
        p, q = np.nonzero(unit @ unit.T >= threshold)
        return p[p < q], q[p < q]
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    p, q = np.nonzero(unit[a] @ unit[b].T >= threshold)
    return a[p], b[q]


def _compare(threshold: float, project: Projector, kind: str):
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, ["bucket", "place", "i", "j"], 4000):
            size, label = rows["raw"].str.len().to_numpy(), rows["label"].to_numpy(object)
            place, i, j, own = (rows[c].to_numpy() for c in ("place", "i", "j", "own"))
            # Two labels or dimensions in one bucket are a chance of its number; they don't meet.
            code = pd.factorize(rows["label"])[0]
            key = np.stack([rows["bucket"].to_numpy(np.int64), place, i, j, size, code], axis=1)
            order = np.lexsort(key.T[::-1])
            change = (key[order][1:] != key[order][:-1]).any(axis=1)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(order)]])
            unit = {n: None for n in np.unique(size).tolist()}
            where = np.zeros(len(rows), np.int64)
            for n in unit:
                at = np.flatnonzero(size == n)
                unit[n], where[at] = _units(rows["raw"].iloc[at].tolist(), kind), np.arange(len(at))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if hi - lo > 1:
                    at = order[lo:hi]
                    p, q = _pairs(unit[int(size[at[0]])][where[at]], own[at], i[at[0]], j[at[0]], threshold)
                    if len(p):
                        found.append((at[p], at[q]))
            if not found:
                continue
            p, q = (np.concatenate(x) for x in zip(*found, strict=True))
            # A pair counts in the first table that it shares.
            linked, back = np.unique(np.concatenate([p, q]), return_inverse=True)
            keys = np.zeros((len(linked), project.tables), np.int64)
            for n in unit:
                at = np.flatnonzero(size[linked] == n)
                if len(at):
                    keys[at] = project.keys(unit[n][where[linked[at]]], label[linked[at]].tolist())
            first, second = back[: len(p)], back[len(p) :]
            new = np.zeros(len(p), bool)
            for k in range(0, len(p), 100_000):
                cut = slice(k, k + 100_000)
                same = keys[first[cut]] == keys[second[cut]]
                new[cut] = same.argmax(axis=1) == place[p[cut]]
            p, q = p[new], q[new]
            m, ids = rows["m"].to_numpy(np.float64), rows["vec_id"].to_numpy(np.int64)
            n = np.bincount(p, m[q], len(rows)) + np.bincount(q, m[p], len(rows))
            root = _spanning(len(rows), p, q)
            at = np.flatnonzero(n)
            yield pd.DataFrame({"rid": rows["rid"].to_numpy(np.int64)[at], "links": n[at].astype(np.int64), "a": ids[at], "b": ids[root[at]]})

    return run


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    miss: float = 1e-6,
    strangers: float = 0.05,
    width: float = 2.0,
    tables: int | None = None,
    projections: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept).

    Vectors with equal labels and equal dimension whose cosine in double precision is at least ``threshold`` link.
    Unit vectors are projected on Gaussian directions, shifted and quantised; some projections make a bucket of a table.
    Vectors that share a bucket in any table are compared exactly, and counted only in the first table that they share.
    How many projections and tables there are follows from the largest label's size (`table_plan`), unless they are given: a
    pair exactly at the threshold is missed with a chance of at most ``miss`` (closer pairs more rarely; as much again for
    its sketch), and a bucket has about ``strangers`` unrelated vectors, so the work grows little faster than the table.

    Null, empty and zero vectors, vectors with null or non-finite components, and null labels link with nothing. Each
    row is a vector of its own: repeated rows link with each other, and components join rows that share an id. A null id
    links with nothing and has no component. Other columns are not read; an empty table gives no rows.

    Equal vectors of a label are one with a count, however many there are. Buckets above BLOCK vectors are cut into blocks;
    pairs of blocks are dealt out, so no task holds more than two blocks. A block pair sends a count per vector and a
    spanning forest of its links, never its pairs.
    """
    kind = "f4" if "float" in dict(vectors.dtypes)[vec_col] else "f8"
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    rows = source.mapInArrow(_read(kind, "vec_id", "label", "vec"), "vec_id long, label string, raw binary, h binary")
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    usable = rows.filter("vec_id IS NOT NULL AND raw IS NOT NULL")
    sizes = usable.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("n")).first()
    planned = table_plan(sizes["largest"] or 1, threshold, width, miss, strangers)
    project = Projector(tables or planned[0], projections or planned[1], width, seed)

    # Equal vectors: the first row stands for all of them.
    h = F.xxhash64("h")
    equal = repeat_filter(usable.select(h.alias("k")), sizes["n"] or 0)
    marked = usable.withColumn("again", may_repeat(h, equal))
    twins = materialize(marked.filter("again").select("rid", "vec_id", "h"), "may-be-equal")
    groups = twins.groupBy("h").agg(F.min("rid").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("m"))
    groups = materialize(groups.select("h", "rep", "least", "m"), "equal-vectors")
    first = groups.select(F.col("rep").alias("rid"), "m", "least")
    one = marked.filter("NOT again").select("rid", "vec_id", "label", "raw", F.lit(1).cast("long").alias("m"))
    several = marked.filter("again").join(first, "rid").select("rid", F.col("least").alias("vec_id"), "label", "raw", "m")
    points = materialize(one.unionByName(several), "points")

    held = repeat_filter(points.select("label", "raw"), (sizes["n"] or 0) * project.tables, keys=_all_keys(project, kind))
    met = materialize(points.select("rid", "label", "raw").mapInPandas(_met(project, kind, held), "bucket long, place int, rid long, sketch long"), "met")
    counts = materialize(met.groupBy("bucket", "place").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    met = met.join(counts, ["bucket", "place"])
    most = sketch_distance(threshold, miss)
    members = met.filter(F.col("n") <= SMALL).groupBy("bucket", "place").agg(F.collect_list(F.struct("rid", "sketch")).alias("ms"))  # at most SMALL of them
    close = F.filter("ms", lambda x: F.size(F.filter("ms", lambda y: F.bit_count(x["sketch"].bitwiseXOR(y["sketch"])) <= most)) > 1)
    small = members.select("bucket", "place", F.explode(F.transform(close, lambda x: x["rid"])).alias("rid"), F.lit(1).alias("blocks"))
    large = met.filter(F.col("n") > SMALL).select("bucket", "place", "rid", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    seats = materialize(small.unionByName(large), "seats")

    dealt = seats.join(points, "rid").withColumn("own", F.pmod(F.xxhash64("rid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")
    dealt = dealt.repartition("bucket", "place", "i", "j").sortWithinPartitions("bucket", "place", "i", "j")
    found = materialize(dealt.mapInPandas(_compare(threshold, project, kind), "rid long, links long, a long, b long"), "links")

    links = found.groupBy("rid").agg(F.sum("links").alias("n"))
    twin_of = twins.join(groups.filter("m > 1"), "h").select("rid", "rep", F.col("m").alias("twins"), "vec_id", "least")
    twin_of = materialize(twin_of, "twins")
    roots = components(found.select("a", "b").unionByName(twin_of.select(F.col("vec_id").alias("a"), F.col("least").alias("b"))).filter("a <> b"))
    out = rows.select("rid", "vec_id").join(twin_of.select("rid", "rep", "twins"), "rid", "left").withColumn("rep", F.coalesce("rep", "rid"))
    out = out.join(links.withColumnRenamed("rid", "rep"), "rep", "left").join(materialize(roots, "roots").withColumnRenamed("v", "vec_id"), "vec_id", "left")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("twins", F.lit(1)) - 1
    out = out.select("vec_id", n.cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
