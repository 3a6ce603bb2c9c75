"""Shared plumbing of the corpus operators: batches, workers' memory, and small column helpers."""

from __future__ import annotations

import contextlib
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.scratch import materialize

__all__ = ["fresh", "lean", "materialize", "remainder", "runs", "text_batches", "trim", "whole_runs"]


def text_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bound the session's Arrow batches by rows and bytes, unless it has settings of its own: each row may be a long text."""
    held = spark._jsparkSession.sessionState().conf()
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if not held.contains(f"spark.sql.execution.arrow.{name}"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def trim() -> None:
    """Give freed memory of this worker back to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A generator of batches after whose end its worker gives freed memory back to the system.

    Workers wait for their next task, beside stages that run in others; what they don't use should not add up.
    """

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id counts as empty text): the fold of a row."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def whole_runs(batches, keys: list[str], rows: int):
    """Frames of about ``rows`` rows of a sorted stream of pandas frames, cut only where the keys change."""
    import pandas as pd

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size < rows:
            continue
        whole = pd.concat(held, ignore_index=True)
        at = len(whole) - int((whole[keys] != whole[keys].iloc[-1]).any(axis=1).to_numpy()[::-1].argmax())
        if at < len(whole) or (whole[keys].iloc[0] != whole[keys].iloc[-1]).any():
            yield whole.iloc[:at]
            held, size = [whole.iloc[at:]], len(whole) - at
        else:
            held = [whole]
    if size:
        yield pd.concat(held, ignore_index=True)


def runs(batches, keys: list[str]):
    """(key, rows) for each run of equal keys in a sorted stream of pandas frames; runs may span frames."""
    import pandas as pd

    held, at = [], None
    for b in batches:
        if not len(b):
            continue
        k = b[keys]
        starts = [0, *((k != k.shift()).any(axis=1).to_numpy().nonzero()[0][1:].tolist()), len(b)]
        for i, j in zip(starts, starts[1:], strict=False):
            now = tuple(k.iloc[i])
            if now != at:
                if held:
                    yield at, pd.concat(held) if len(held) > 1 else held[0]
                held, at = [], now
            held.append(b.iloc[i:j])
    if held:
        yield at, pd.concat(held) if len(held) > 1 else held[0]
