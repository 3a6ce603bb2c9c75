"""Whitening, clustering and sharding against plain Python, on the given tables and on messy ones."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import centroids, sharding, whitening
from tarn.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors(seed: int, n: int, dim: int, spread: float = 1.0, at: float = 0.0) -> np.ndarray:
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, dim)) * np.linspace(0.2, spread, dim) + at).astype(np.float32)


def _table(spark, matrix, first: int = 0, extra: list | None = None):
    rows = [(first + i, [float(c) for c in v], i % 3) for i, v in enumerate(matrix)] + (extra or [])
    df = spark.createDataFrame(rows, VECTORS)
    return df.withColumns({c: F.lit("!") for c in ("id", "vec", "x", "cluster", "distance", "kind", "dim", "n", "part", "component", "whitened", "deviation", "h")})


# --- whitening


def _brute_whitening(matrix, scale=64, offset=1_000_000, components=32):
    ints = [[math.floor(scale * float(c)) + offset for c in v] for v in matrix]
    n, dim = len(ints), len(ints[0])
    sums = [sum(v[i] for v in ints) for i in range(dim)]
    off = np.array([[(n * x - s) / n for x, s in zip(v, sums, strict=True)] for v in ints])
    values, vectors = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-values)[:components]
    z = off @ vectors[:, order] / np.sqrt(values[order])
    deviation = [sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)) for v in ints]
    return deviation, z, values[order] / values.sum()


def _whitened(df):
    rows = df.toPandas()
    return rows, rows.set_index(["vec_id", "component"])["whitened"].unstack().sort_index().to_numpy()


@pytest.mark.parametrize("at", [0.0, 30_000.0])
def test_whitening_is_brute_forces(spark, at):
    matrix = _vectors(1, 300, 40, at=at)
    rows, got = _whitened(whitening.whitened_components(_table(spark, matrix).repartition(17)))
    deviation, want, explained = _brute_whitening(matrix)
    assert len(rows) == 300 * 32 and set(rows.n) == {300}
    assert rows.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == deviation
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-9
    assert np.allclose(rows.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-9)
    error = np.abs(np.cov(got.T, bias=True) - np.eye(32)).max()
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-10 and error < 1e-10


def test_whitening_query(spark, sf):
    source = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    rows, got = _whitened(QUERIES["op11_whitening"](spark, sf))
    deviation, want, _ = _brute_whitening(source.embedding.tolist())
    assert rows.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == deviation
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    matrix = _vectors(2, 50, 5)
    odd = [(100, None, 0), (101, [1.0, None, 1.0, 1.0, 1.0], 0), (102, [nan] * 5, 0), (103, [1.0, inf, 0.0, 0.0, 0.0], 0), (104, [], 0), (None, [1.0, 2.0, 3.0, 4.0, 5.0], 0), (7, [1.0, 2.0, 3.0, 4.0, 5.0], 0)]
    rows, bases = whitening.whiten(_table(spark, matrix, extra=odd + [(200, [1.0, 2.0], 0), (201, [2.0, 1.0], 0), (202, [4.0, 4.0], 0)]))
    rows = rows.toPandas()
    assert len(rows) == 55 and bases[5].n == 52 and bases[2].n == 3  # another length is a fit of its own
    assert rows.vec_id.isna().sum() == 1 and (rows.vec_id == 7).sum() == 2
    assert all(len(w) == d for w, d in zip(rows.whitened, rows.dim, strict=True))


def test_whitening_without_variance(spark):
    flat = [[1.0, 2.0, 3.0, float(i % 2)] for i in range(10)]
    rows = whitening.whitened_components(_table(spark, flat)).toPandas()
    assert rows[rows.component > 1].whitened.isna().all() and (rows[rows.component > 1].explained == 0).all()
    assert np.abs(np.abs(rows[rows.component == 1].whitened) - 1).max() < 1e-12 and rows.identity_error.max() < 1e-12
    assert whitening.whitened_components(_table(spark, [[1.0, 2.0]])).toPandas().whitened.isna().all()


def test_vector_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whitened_components(none).collect() == []
    assert centroids.clusters_with_totals(none).collect() == []


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(_table(spark, [[1e30, 1.0]]))
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(_table(spark, [[1e30, 1.0]]), dim=2)


@pytest.mark.parametrize("seed", range(4))
def test_symmetric_qr(seed):
    r = np.random.default_rng(seed)
    n = [1, 2, 17, 64][seed]
    a = r.normal(size=(n, n))
    for m in (a + a.T, a @ a.T, np.zeros((n, n)), np.ones((n, n)), np.diag(r.integers(0, 3, n).astype(float)), 1e12 * (a[:, :1] @ a[:, :1].T)):
        values, vectors = whitening.symmetric_qr(m)
        size = max(np.abs(m).max(), 1e-300)
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 * n
        assert np.abs(m @ vectors - vectors * values).max() < 1e-13 * n * size
        assert (np.diff(values) <= 0).all() and np.abs(values - np.linalg.eigvalsh(m)[::-1]).max() < 1e-13 * n * size


def test_merged_moments_are_whole_moments():
    x = np.random.default_rng(5).integers(10**6 - 300, 10**6 + 300, (500, 7))
    whole, parts = whitening.Moments(7, True), whitening.Moments(7, True)
    whole.add(x[:123]), whole.add(x[123:])
    for i in range(0, 500, 61):
        one = whitening.Moments(7, True)
        one.add(x[i : i + 61])
        parts.merge(one.n, one.sums, one.m2)
    want = np.cov((x - 10**6).T, bias=True)
    assert (whole.sums == x.sum(axis=0)).all() and (parts.sums == whole.sums).all()
    assert np.abs(whole.covariance() - want).max() < 1e-9 and np.abs(parts.covariance() - want).max() < 1e-9


# --- clusters


def _brute_clusters(rows, k, rounds, dim, scale=1024):
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for i in range(rounds + 1):
        found = [min((dist(v, c), j) for j, c in enumerate(cs)) for _, v in kept]
        if i < rounds:
            for j in range(len(cs)):
                own = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == j]
                if own:
                    cs[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted((str(i), at, d) for (i, _), (d, at) in zip(kept, found, strict=True)), cs


@pytest.mark.parametrize("case", ["plain", "grid", "copies", "few"])
def test_clusters_are_brute_forces(spark, case):
    r = np.random.default_rng(9)
    matrix = {
        "plain": _vectors(3, 400, 6),
        "grid": r.integers(0, 3, (300, 6)).astype(np.float32) / 1024,  # full of ties
        "copies": np.repeat(_vectors(4, 6, 6), 40, axis=0),  # equal centroids, empty clusters
        "few": _vectors(5, 3, 6),
    }[case]
    odd = [(900, None, 0), (901, [1.0] * 5, 0), (902, [1.0] * 5 + [float("nan")], 0), (903, [1.0] * 5 + [None], 0), (None, [0.5] * 6, 0), (3, [0.25] * 6, 0), (3, [0.25] * 6, 0)]
    df = _table(spark, matrix, extra=odd)
    rows, model = centroids.cluster(df, k=8, rounds=6, dim=6)
    want, cs = _brute_clusters([(x.vec_id, x.embedding) for x in df.collect()], 8, 6, 6)
    assert sorted((str(x.vec_id), x.cluster, x.distance) for x in rows.collect()) == want
    assert model.centroids.tolist() == cs and sum(model.inertias) == sum(d for _, _, d in want)


def test_bounds_skip_distances(spark):
    r = np.random.default_rng(1)
    middles = r.normal(size=(8, 64)) * 4
    matrix = (middles[np.arange(1600) % 8] + r.normal(size=(1600, 64)) * 0.3).astype(np.float32)
    _, model = centroids.cluster(_table(spark, matrix), k=8, rounds=5)
    assert model.computed[0] == 1600 * 8 and sum(model.computed[1:]) < 5 * 1600 * 8 / 3


def test_rounding_is_to_the_safe_side():
    x = np.sqrt(np.random.default_rng(2).integers(0, 2**50, 20_000).astype(np.float64))
    assert (centroids.down(x).astype(np.float64) <= x).all() and (centroids.up(x).astype(np.float64) >= x).all()
    a, b = np.random.default_rng(3).integers(-(2**27), 2**27, (2, 30, 64))
    want = [[sum((int(p) - int(q)) ** 2 for p, q in zip(u, v, strict=True)) for v in b] for u in a]
    assert centroids.all_squares(a, b).tolist() == want


# --- shards


def _jump(key: int, shards: int) -> int:
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_against_known_and_plain_values(spark):
    assert [_jump(1, 1), _jump(42, 57), _jump(0xDEAD10CC, 666), _jump(256, 1024)] == [0, 43, 361, 520]
    r = random.Random(4)
    keys = [0, 1, 42, 256, 0xDEAD10CC, 2**64 - 1] + [r.randrange(2**64) for _ in range(300)]
    df = spark.createDataFrame([(f"{k:016x}",) for k in keys], "k string")
    for n in (1, 2, 24, 57, 666, 1024):
        for x in df.select("k", sharding.jump(F.col("k"), n).alias("j")).collect():
            key = int(x.k, 16)
            assert (x.j.shard, x.j.grown) == (_jump(key, n), _jump(key, n + 1))


def _key(doc_id) -> int:
    return int(hashlib.md5(str("" if doc_id is None else doc_id).encode()).hexdigest()[:16], 16)


def _holds(rows, docs, shards):
    """Shards follow from keys, slots number them from 0, and every document is there as often as it was."""
    text = lambda t: (t or "").encode()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d.doc_id), len(text(d.text)) + 8, zlib.crc32(text(d.text))) for d in docs)
    slots = {}
    for r in rows:
        assert (r.shard, r.grown_shard) == (_jump(_key(r.doc_id), shards), _jump(_key(r.doc_id), shards + 1))
        assert r.grown_shard in (r.shard, shards) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_messy_rows(spark, messy, empty):
    _holds(sharding.shard_table(messy).collect(), messy.collect(), 24)
    assert sharding.shard_table(empty).collect() == []
    clashing = messy.withColumns({c: F.lit("!") for c in ("shard", "slot", "grown_shard", "shard_key", "shard_bucket")})
    out = sharding.shard_rows(clashing, 5)
    assert out.columns == [*clashing.columns, "_shard", "_slot", "_grown_shard"] and out.filter("shard = '!'").count() == messy.count()


def test_a_hot_id_is_numbered_by_task(spark):
    ids = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, 8).otherwise(F.col("id")).alias("doc_id")
    docs = spark.range(0, 6000, 1, 12).select(ids, F.concat(F.lit("text "), F.col("id") % 5).alias("text"))
    rows = sharding.shard_table(docs, shards=4, rows_a_bucket=100)
    _holds(rows.collect(), docs.collect(), 4)


def test_another_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    now, then = ({r.doc_id: r.shard for r in sharding.shard_rows(ids, n).collect()} for n in (24, 25))
    moved = [i for i in now if now[i] != then[i]]
    assert all(then[i] == 24 for i in moved) and 60 < len(moved) < 190


def test_shards_are_written(spark, messy, tmp_path):
    sharding.write_shards(messy, str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == messy.count()
