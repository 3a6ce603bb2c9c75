"""Sessions: settings for local work, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    session = SparkSession.builder.master(f"local[{cores}]").appName("tarn").config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def spread(df: DataFrame, most: int = 256 << 20) -> DataFrame:
    """A table of at most ``most`` bytes dealt to all cores, for Python functions that follow: a small file is one row group, and so
    one task. Larger tables have splits enough and stay where they are; no text of theirs is moved. The package is shipped too, for an operator
    that is called by a program of its own."""
    ship(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def spread_all(df: DataFrame, share: int = 16 << 20, most: int = 20_000) -> DataFrame:
    """A table of any size dealt to tasks of about ``share`` bytes, and to all cores at least, for Python functions that take far longer than
    moving their rows: a large file may have few row groups, which would keep most cores idle however many bytes it has. There are at most ``most``
    tasks, or as many as cores: sizes of tables that are not files may be unknown, and count as without end."""
    ship(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // share), most)))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bound the session's Arrow batches by rows and bytes, unless it has settings of its own: rows may be long texts."""
    held = spark._jsparkSession.sessionState().conf()
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if not held.contains(f"spark.sql.execution.arrow.{name}"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def ship(spark: SparkSession) -> None:
    """Give executors this package, once an application, so that Python functions can be loaded there without an install."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tarn-ship-"), "tarn.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("tarn", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
