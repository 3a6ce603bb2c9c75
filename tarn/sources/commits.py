"""Tables that change together, behind one log of commits.

A root folder holds data folders, which are written once and never changed, and ``_commits``: a file a commit, numbered, that names the
folders of every table as it is then. Writers write data beside what is there and then create the next number's file, which fails
if another writer has it; they look at the new state and try again. Readers take the newest file, or one they hold the number of. So a
reader sees all of a commit or none, keeps its snapshot while others write, and a crash leaves folders that nobody names (`vacuum`).

The next file is written beside and renamed to its name, never over one that exists. HDFS and stores with such a rename make that step
atomic among all writers; on a local disk it is atomic for readers and for the writers of one process.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOG = "_commits"
_LOCK = threading.Lock()


class Conflict(RuntimeError):
    """Other writers took every number that was tried."""


@dataclass(frozen=True)
class Snapshot:
    """The tables of a commit; number 0 is the empty state before the first."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    p, fs = _fs(spark, f"{root}/{_LOG}")
    if not fs.exists(p):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(p))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _contents(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with these contents unless it exists; whether it was created."""
    jvm = spark.sparkContext._jvm
    beside, fs = _fs(spark, f"{path[: path.rindex('/')]}/.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    target = fs.makeQualified(_fs(spark, path)[0])
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    with _LOCK:
        try:
            context.rename(fs.makeQualified(beside), target, never_over)
            return True
        except Exception as e:
            fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot:
    """The newest state, or that of a commit's number."""
    held = _numbers(spark, root)
    if number is None:
        number = held[-1] if held else 0
    if number == 0:
        return Snapshot()
    if number not in held:
        raise ValueError(f"commit {number} is not there (any more)")
    return Snapshot(number, json.loads(_contents(spark, f"{root}/{_LOG}/{number:012d}.json")))


def commit(spark: SparkSession, root: str, change: Callable[[Snapshot], dict[str, dict | None]], attempts: int = 50) -> Snapshot:
    """Apply ``change``, from a snapshot to the tables that are new (None: gone), as one commit.

    ``change`` runs again with a newer snapshot if another writer was faster; what it wrote before is left to `vacuum`. It should write data
    that do not depend on the snapshot before, outside.
    """
    for _ in range(attempts):
        base = snapshot(spark, root)
        tables = {n: t for n, t in (base.tables | change(base)).items() if t is not None}
        if _create(spark, f"{root}/{_LOG}/{base.number + 1:012d}.json", json.dumps(tables, sort_keys=True)):
            return Snapshot(base.number + 1, tables)
    raise Conflict(f"no commit to {root} in {attempts} attempts")


def stage(df: DataFrame, root: str, name: str, kind: str = "parquet", **options) -> dict:
    """Write a table's rows into a new folder that no commit names yet: what a change returns for it."""
    folder = f"data/{name}-{uuid.uuid4().hex[:16]}"
    df.write.format(kind).options(**options).save(f"{root}/{folder}")
    return {"kind": kind, "schema": df.schema.jsonValue(), "folders": [folder], "options": options}


def read(spark: SparkSession, root: str, name: str, at: Snapshot | None = None) -> DataFrame:
    """A table as it is in a snapshot (the newest, if none is given)."""
    at = at or snapshot(spark, root)
    if name not in at.tables:
        raise ValueError(f"no table {name} in {root} at commit {at.number}")
    table = at.tables[name]
    folders = table["folders"] if "buckets" not in table else [f for fs in table["buckets"].values() for f in fs]
    schema = StructType.fromJson(table["schema"])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(table["kind"]).options(**table["options"]).load([f"{root}/{f}" for f in folders])


def replace(root: str, tables: dict[str, DataFrame], kinds: dict[str, str] | None = None) -> Snapshot:
    """Several tables, whole, in one commit."""
    spark = next(iter(tables.values())).sparkSession
    staged = {n: stage(df, root, n, (kinds or {}).get(n, "parquet")) for n, df in tables.items()}
    return commit(spark, root, lambda _: staged)


def append(df: DataFrame, root: str, name: str) -> Snapshot:
    """Rows behind those that a table has; columns must be the same."""
    new = stage(df, root, name)

    def change(base: Snapshot) -> dict:
        old = base.tables.get(name)
        if old is None:
            return {name: new}
        if [f["name"] for f in old["schema"]["fields"]] != [f["name"] for f in new["schema"]["fields"]]:
            raise ValueError(f"{name} has other columns")
        return {name: old | {"folders": old["folders"] + new["folders"]}}

    return commit(df.sparkSession, root, change)


def upsert(rows: DataFrame, root: str, name: str, key: str, best: str | None = None, buckets: int = 64, parts: int = 1) -> Snapshot:
    """Put rows into a table by key: given ones replace old ones, or, with ``best`` (an orderable column), of old and given the one with the
    greatest value stays (of given rows alike). Without ``best`` a key must be given once.

    The table is dealt to buckets by a hash of the key. Only buckets that a given key falls into are read and written anew, by ``parts``
    tasks each; all others are the same folders in the next commit.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())  # at most ``buckets``

    def change(base: Snapshot) -> dict:
        old = base.tables.get(name)
        kept = dict(old["buckets"]) if old else {}
        schema = StructType.fromJson(old["schema"]) if old else rows.schema
        given = rows.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in schema.names])
        folders = [f for b in touched for f in kept.get(str(b), [])]
        merged = given
        if folders:
            before = spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders])
            merged = before.unionByName(given) if best else before.join(given.select(key).distinct(), key, "left_anti").unionByName(given)
        if best:
            first = F.max(F.struct(F.col(best), *[F.col(c) for c in schema.names if c != best])).alias("s")
            merged = merged.groupBy(F.col(key).alias("_key")).agg(first).select("s.*").select(*schema.names)
        folder = f"data/{name}-{uuid.uuid4().hex[:16]}"
        dealt = merged.withColumn("_bucket", bucket).withColumn("_part", F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)))
        dealt.repartition(max(1, len(touched) * parts), "_bucket", "_part").drop("_part").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
        for b in touched:
            p, fs = _fs(spark, f"{root}/{folder}/_bucket={b}")
            kept[str(b)] = [f"{folder}/_bucket={b}"] if fs.exists(p) else []
        return {name: {"kind": "parquet", "schema": schema.jsonValue(), "buckets": kept, "options": {}}}

    return commit(spark, root, change)


def vacuum(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Delete all commits but the ``keep`` newest, and the data folders that none of those names; how many folders went.

    Readers of older snapshots must be done, and no writer may have data staged: run it when none is at work.
    """
    numbers = _numbers(spark, root)
    held = set()
    for n in numbers[-keep:]:
        for t in snapshot(spark, root, n).tables.values():
            named = t.get("folders", []) + [f for fs in t.get("buckets", {}).values() for f in fs]
            held |= {f.split("/")[1] for f in named}
    for n in numbers[:-keep]:
        p, fs = _fs(spark, f"{root}/{_LOG}/{n:012d}.json")
        fs.delete(p, False)
    p, fs = _fs(spark, f"{root}/data")
    gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in held] if fs.exists(p) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)
