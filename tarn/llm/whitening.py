"""Whitening of embeddings: Welford updates in partition iterators, a parallel merge, and a symmetric QR eigen-solve.

The covariance is never formed from sums of squares, which lose all digits when vectors lie far from zero. Components are
integers, so that running means have exact numerators and every deviation is rounded once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.session import spread

from .common import materialize

STATE = "part long, dim int, n long, sums binary, m2 binary"
FAN_IN = 64  # states that one task of a merge reads
#: Bases that go to every task; vectors of so many lengths that theirs are larger are refused.
MOST_BASIS_BYTES = 256 << 20


def usable(vec: Column) -> Column:
    """Neither null, nor with null or non-finite components."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class Moments:
    """Count, sums and co-moment matrix of rows seen so far. Sums of integers stay exact."""

    def __init__(self, dim: int, exact: bool):
        self.n, self.sums, self.m2 = 0, np.zeros(dim, np.int64 if exact else np.float64), np.zeros((dim, dim))

    def add(self, x: np.ndarray) -> None:
        """Welford's rank-one updates for the rows of x, in their order.

        The i-th row adds outer(x_i - mean_{i-1}, x_i - mean_i), which is (i-1)/i times the outer square of x_i - mean_{i-1}. Running
        sums give all those deviations of a batch at once, and one product adds their outer squares.
        """
        if not len(x):
            return
        at = self.n + np.arange(1, len(x) + 1)[:, None]
        after = self.sums + np.cumsum(x, axis=0)
        before = after - x
        if x.dtype == np.int64:
            d = ((at - 1) * x - before) / np.maximum(at - 1, 1)
        else:
            d = x - before / np.maximum(at - 1, 1)
        d = d * np.sqrt((at - 1) / at)
        self.m2 += d.T @ d
        self.n, self.sums = self.n + len(x), after[-1]

    def merge(self, n: int, sums: np.ndarray, m2: np.ndarray) -> None:
        """The parallel update: both matrices, and the outer square of the means' difference."""
        if self.n and n:
            if sums.dtype == np.int64:  # the numerator of the means' difference, in whole numbers of any size
                top = self.n * sums.astype(object) - n * self.sums.astype(object)
                d = np.array([int(t) / (self.n * n) for t in top])
            else:
                d = sums / n - self.sums / self.n
            self.m2 = self.m2 + m2 + np.outer(d, d) * (self.n * n / (self.n + n))
        elif n:
            self.m2 = m2.copy()
        self.n, self.sums = self.n + n, self.sums + sums

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * max(self.n, 1))


def integers(raw: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset, c as double; refused where later products would not fit in 64 bits."""
    x = np.floor(raw.astype(np.float64) * scale)
    if x.size and np.abs(x).max() > 2**40:
        raise OverflowError("a vector's component is too large for whole numbers of 64 bits")
    return x.astype(np.int64) + offset


def by_length(vectors, value_type) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) for each length in an Arrow list array without nulls; empty lists have no part."""
    import pyarrow.compute as pc

    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(value_type, copy=False), np.cumsum(sizes)
    out = []
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        out.append((int(n), at, flat[(ends[at] - n)[:, None] + np.arange(n)]))
    return out


def _states(read, exact: bool):
    """A state for each length of a partition's vectors; ``read`` makes (length, matrix) of a batch."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held: dict[int, Moments] = {}
        for b in batches:
            for dim, x in read(b):
                held.setdefault(dim, Moments(x.shape[1], exact)).add(x)
        part = TaskContext.get().partitionId()
        rows = [{"part": part, "dim": dim, "n": m.n, "sums": m.sums.tobytes(), "m2": m.m2.tobytes()} for dim, m in sorted(held.items())]
        types = [("part", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.binary()), ("m2", pa.binary())]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types))

    return run


def _loaded(row, exact: bool) -> tuple[int, np.ndarray, np.ndarray]:
    sums = np.frombuffer(row.sums, np.int64 if exact else np.float64)
    return int(row.n), sums, np.frombuffer(row.m2, np.float64).reshape(len(sums), len(sums))


def _merged(exact: bool):
    def run(key, pdf):
        import pandas as pd

        rows = list(pdf.sort_values("part").itertuples())
        total = Moments(len(rows[0].sums) // 8, exact)
        for r in rows:
            total.merge(*_loaded(r, exact))
        return pd.DataFrame({"part": [int(key[0])], "dim": [int(key[1])], "n": [total.n], "sums": [total.sums.tobytes()], "m2": [total.m2.tobytes()]})

    return run


def moments(states: DataFrame, exact: bool, tag: str) -> dict[int, Moments]:
    """One state for each length. Partitions meet in groups of FAN_IN, level by level, always in the same order, so reruns give the same
    bits; the driver gets one state a length."""
    states = materialize(states, f"{tag}-0")
    top, level = states.agg(F.max("part")).first()[0], 0
    while top:  # above zero: more than one group is left
        level, top = level + 1, top // FAN_IN
        group = F.expr(f"part div {FAN_IN}").alias("part")
        states = materialize(states.groupBy(group, "dim").applyInPandas(_merged(exact), STATE), f"{tag}-{level}")
    out = {}
    for r in states.orderBy("dim").toLocalIterator():
        out[r.dim] = Moments(len(r.sums) // 8, exact)
        out[r.dim].merge(*_loaded(r, exact))
    return out


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    Householder reflections make it tridiagonal; QR steps with Wilkinson's shift, chased as plane rotations, make it diagonal. Of each
    vector the largest component (the first of equals) is positive.
    """
    t, n = np.array(a, np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = t[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size > 0:
            v /= size
            t[k + 1 :] -= 2 * np.outer(v, v @ t[k + 1 :])
            t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ v, v)
            q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e, eps = np.diag(t).copy(), np.diag(t, -1).copy(), np.finfo(float).eps
    rows = q.T.copy()  # eigenvectors as rows: a rotation touches two of them
    hi = n - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if small[hi - 1]:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half, off = (d[hi - 1] - d[hi]) / 2, e[hi - 1]
        shift = d[hi] - off * off / (half + np.copysign(np.hypot(half, off), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r > 0 else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a0, b0, a1 = d[k], e[k], d[k + 1]
            d[k] = c * c * a0 + 2 * c * s * b0 + s * s * a1
            d[k + 1] = s * s * a0 - 2 * c * s * b0 + c * c * a1
            e[k] = c * s * (a1 - a0) + (c * c - s * s) * b0
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            rows[[k, k + 1]] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    order = np.argsort(-d, kind="stable")
    vectors = rows[order].T
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return d[order], vectors * np.where(signs == 0, 1, signs)


@dataclass
class Basis:
    """What whitens vectors of one length."""

    n: int
    sums: np.ndarray  # of the integers, exact
    values: np.ndarray  # eigenvalues of the first components, falling
    vectors: np.ndarray  # their unit eigenvectors, as columns
    explained: np.ndarray  # shares of the trace
    real: np.ndarray  # whether a component has variance beyond rounding
    identity_error: float = 0.0

    @classmethod
    def fit(cls, m: Moments, components: int) -> Basis:
        values, vectors = symmetric_qr(m.covariance())
        values = np.maximum(values, 0)
        total = values.sum()
        c = min(components, len(values))
        real = values[:c] > len(values) * np.finfo(float).eps * values[0]
        return cls(m.n, m.sums, values[:c], vectors[:, :c], values[:c] / total if total else np.zeros(c), real)

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if x.size and self.n * (float(np.abs(x).max()) + 1) > 2.0**62:
            raise OverflowError("n * x - S does not fit in 64 bits")
        return self.n * x - self.sums

    def whiten(self, from_mean: np.ndarray) -> np.ndarray:
        """Projections over the roots of the eigenvalues; NaN for components without variance."""
        z = (from_mean / self.n) @ self.vectors
        return np.where(self.real, z / np.sqrt(np.where(self.real, self.values, 1.0)), np.nan)


def squared(from_mean: np.ndarray) -> np.ndarray:
    """Row sums of squares, exact; refused beyond 64 bits."""
    if from_mean.size and float(np.abs(from_mean).max()) ** 2 * from_mean.shape[1] >= 2.0**62:
        sums = (from_mean.astype(object) ** 2).sum(axis=1)
        if max(sums) >= 2**63:
            raise OverflowError("a deviation does not fit in 64 bits")
        return sums.astype(np.int64)
    return (from_mean * from_mean).sum(axis=1)


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> tuple[DataFrame, dict[int, Basis]]:
    """Rows (id, dim, deviation long, whitened array<double>) and the basis of each length of vectors.

    Components c become integers floor(scale * c) + offset. Every vector with usable components is in the fit; null vectors and those
    with null or non-finite components are left out, and empty vectors, which have no component. Vectors of another length are fitted
    by themselves. A null id stays null, repeated rows count as often as they occur, other columns are not read, an empty table gives no
    rows. A component without variance (as when there are fewer vectors than components) has no whitened value (null), explains 0, and
    is not in ``identity_error``. Components above 2^40 / scale are refused with an OverflowError.

    Three passes over the vectors: moments; moments of whitened vectors (``identity_error``); the result. No vector is shuffled; a task
    sends one state a length, merged level by level, and the eigen-solve on the driver sees one matrix.
    """
    kind = np.float32 if "float" in dict(vectors.dtypes)[vec_col] else np.float64
    rows = spread(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter(usable(F.col("vec")) & (F.size("vec") > 0)))

    def read(b):
        return [(dim, integers(x, scale, offset)) for dim, _, x in by_length(b.column("vec"), kind)]

    found = moments(rows.select("vec").mapInArrow(_states(read, True), STATE), True, "moments")
    bases = {dim: Basis.fit(m, components) for dim, m in found.items()}
    if sum(x.vectors.nbytes for x in bases.values()) > MOST_BASIS_BYTES:
        raise ValueError("too many lengths of vectors, or components, for every task to hold their bases")

    def read_whitened(b):
        return [(dim, bases[dim].whiten(bases[dim].from_mean(x))[:, bases[dim].real]) for dim, x in read(b) if bases[dim].real.any()]

    checked = moments(rows.select("vec").mapInArrow(_states(read_whitened, False), STATE), False, "whitened-moments")
    for dim, m in checked.items():
        bases[dim].identity_error = float(np.abs(m.covariance() - np.eye(len(m.sums))).max())

    def apply(batches):
        import pyarrow as pa

        for b in batches:
            for dim, at, raw in by_length(b.column("vec"), kind):
                off = bases[dim].from_mean(integers(raw, scale, offset))
                z = bases[dim].whiten(off)
                ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                white = pa.ListArray.from_arrays(ends, pa.array(z.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(squared(off)), white], ["id", "dim", "deviation", "whitened"])

    out = rows.mapInArrow(apply, f"id {dict(rows.dtypes)['id']}, dim int, deviation long, whitened array<double>")
    return out.withColumnRenamed("id", id_col), bases


def whitened_components(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """`whiten` with a row for each vector and component (from 1), and what the basis says of it: n, explained, identity_error."""
    rows, bases = whiten(vectors, components, id_col, vec_col, scale, offset)
    facts = [(dim, k + 1, b.n, float(b.explained[k]), b.identity_error) for dim, b in bases.items() for k in range(len(b.values))]
    facts = F.broadcast(rows.sparkSession.createDataFrame(facts, "dim int, component int, n long, explained double, identity_error double"))
    split = rows.select(id_col, "dim", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return split.join(facts, ["dim", "component"]).select(id_col, "component", "n", "deviation", "whitened", "explained", "identity_error")
