"""Intermediate tables in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KNOWN: set[str] = set()
_SCOPE: list[str] = []
_WRITTEN: dict[tuple[str, str], list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; where it is unset in local mode (as in tests) one of our own.

    A cluster needs the setting: a folder of one machine would hide what executors write from each other.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tarn-")
    return _OWN[app]


def _drop(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """This application's folder for written intermediate tables; removed when the driver ends, or by `release`."""
    folder = f"{shared_dir(spark)}/tarn-{spark.sparkContext.applicationId}"
    if folder not in _KNOWN:
        _KNOWN.add(folder)
        atexit.register(_drop, spark, folder)
    return folder


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application (results that still read them become unreadable)."""
    _drop(spark, scratch(spark))


@contextlib.contextmanager
def scope(name: str):
    """Tables written inside belong to a scope, whose tables `sweep` deletes together."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def sweep(spark: SparkSession, name: str) -> None:
    """Delete the tables written so far in a scope; results that still read them become unreadable."""
    for path in _WRITTEN.pop((spark.sparkContext.applicationId, name), []):
        _drop(spark, path)


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    It cuts lineage, and losing an executor costs nothing that was written. Its size is known to the optimizer afterwards.
    """
    path = fresh_path(df.sparkSession, tag)
    if _SCOPE:
        _WRITTEN.setdefault((df.sparkSession.sparkContext.applicationId, _SCOPE[-1]), []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
