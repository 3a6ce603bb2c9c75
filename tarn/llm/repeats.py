"""Two-pass Bloom filtering: which of many 64-bit keys may occur more than once?

Pass 1 lets every task put its keys into a blocked Bloom filter whose cells count to two. Each task sends the
cells it touched, grouped by block; blocks are merged by streaming over one block at a time. What reaches the
driver is one bit a cell ("touched twice"), at most ``max_bytes`` of it whatever the input's size.
Pass 2 asks that bitmap. A key that repeats always answers yes; a key that is alone answers yes with the
probability of a false positive. With more keys than the filter was made for, that probability rises towards one,
which costs shuffle volume but never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

BLOCKS = 1024
FLUSH = 1 << 20  # keys that a task holds before it sends their cells


def _cells(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of each key, and its two different cells in that block."""
    k = keys.view(np.uint64)
    k = (k ^ (k >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    block = (k >> np.uint64(54)).astype(np.int64)
    first = ((k >> np.uint64(27)) % np.uint64(width)).astype(np.int64)
    second = (k % np.uint64(width)).astype(np.int64)
    return block, first, np.where(first == second, first ^ 1, second)


def _packed(offsets: np.ndarray) -> bytes:
    """Rising offsets as their differences: first how many bytes each has, then the numbers."""
    steps = np.diff(offsets, prepend=np.uint32(0))
    kind = np.uint16 if len(steps) and steps.max() < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, f"u{packed[0]}", offset=1), dtype=np.int64)


def _touch(keys: np.ndarray, width: int) -> pd.DataFrame:
    block, first, second = _cells(keys, width)
    cells, seen = np.unique(np.concatenate([block * width + first, block * width + second]), return_counts=True)
    blocks, offsets = cells // width, (cells % width).astype(np.uint32)
    starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
    ends = np.r_[starts[1:], len(blocks)]
    rows = []
    for a, b in zip(starts, ends, strict=True):
        twice = seen[a:b] > 1
        rows.append((int(blocks[a]), _packed(offsets[a:b][~twice]), _packed(offsets[a:b][twice])))
    return pd.DataFrame(rows, columns=["block", "once", "twice"])


def _flat(s: pd.Series) -> np.ndarray:
    """The keys of a column of longs, or of arrays of them."""
    s = s.dropna()
    if s.dtype == object and len(s) and isinstance(s.iloc[0], np.ndarray):
        return np.concatenate(s.to_numpy()).astype(np.int64)
    return s.to_numpy(np.int64)


def repeat_filter(rows: DataFrame, n: int, cells_per_key: int = 16, max_bytes: int = 64 << 20, keys: Callable[[pd.DataFrame], np.ndarray] | None = None):
    """A broadcast of (bitmap, cells a block) for the one column of longs, or arrays of longs, in ``rows``, or for the keys that a
    function makes of frames of them; ``n``: about how many keys there are."""
    spark, name = rows.sparkSession, rows.columns[0]
    wanted = min(max(n, 1) * cells_per_key, max_bytes * 8)
    width = 1 << max(10, (wanted // BLOCKS).bit_length() - (1 if wanted >= max_bytes * 8 else 0))
    width = min(width, max_bytes * 8 // BLOCKS)

    @lean
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            held.append(keys(b) if keys else _flat(b[name]))
            size += len(held[-1])
            if size >= FLUSH:
                yield _touch(np.concatenate(held), width)
                held, size = [], 0
        if size:
            yield _touch(np.concatenate(held), width)

    @lean
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, count = None, None
        for b in batches:
            for k, once, twice in b.itertuples(index=False):
                if k != block:
                    if block is not None:
                        yield pd.DataFrame({"block": [block], "bits": [np.packbits(count > 1).tobytes()]})
                    block, count = k, np.zeros(width, np.uint8)
                at = _unpacked(once)
                count[at] = np.minimum(count[at] + 1, 2)
                count[_unpacked(twice)] = 2
        if block is not None:
            yield pd.DataFrame({"block": [block], "bits": [np.packbits(count > 1).tobytes()]})

    touched = rows.mapInPandas(build, "block int, once binary, twice binary")
    merged = touched.repartition("block").sortWithinPartitions("block").mapInPandas(merge, "block int, bits binary")
    bitmap = np.zeros(BLOCKS * width // 8, np.uint8)
    for row in merged.collect():  # at most BLOCKS rows, max_bytes together
        bitmap[row.block * width // 8 : (row.block + 1) * width // 8] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast((bitmap, width))


def probe(keys: np.ndarray, held) -> np.ndarray:
    """What `may_repeat` answers for an array of keys, for use inside a Python worker."""
    bitmap, width = held.value
    block, first, second = _cells(keys, width)
    hit = np.ones(len(keys), bool)
    for cell in (first, second):
        at = block * width + cell
        hit &= (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return hit


def may_repeat(key: Column, held) -> Column:
    """Whether the long ``key`` may occur more than once; never false for one that does."""

    @F.pandas_udf("boolean")
    @lean
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(probe(s.to_numpy(np.int64), held))

    return ask(key)
