"""Sharding by jump consistent hashing, in column expressions: no ring, no table of shards.

A key walks through the numbers of shards at which it would move; its shard is the last of them below the count. Adding a
shard moves 1/(n+1) of the keys, and only into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Fixed values of the method: the multiplier of its generator of 64-bit numbers, and the 31 bits that a step uses.
MULTIPLIER = 2862933555777941757
UNIT = float(1 << 31)
#: Keys move some ln(shards) times; those that move more often walk on in a second, longer loop.
STEPS = 128


def key_text(id_col: str) -> Column:
    """The first 16 hex digits of the MD5 of the id as text (null: empty text): the 64-bit key."""
    return F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 16)


def limbs(digits: Column) -> list[Column]:
    """A 64-bit number of 16 hex digits as its highest 16 bits, middle 24 and lowest 24, as a long each: their products can't overflow."""
    return [F.conv(F.substring(digits, at, n), 16, 10).cast("long") for at, n in ((1, 4), (5, 6), (11, 6))]


def _step(state: Column) -> Column:
    """The next number of shards at which the key moves."""
    m = [MULTIPLIER & 0xFFFFFF, MULTIPLIER >> 24 & 0xFFFFFF, MULTIPLIER >> 48]
    hi, mid, lo = (state[x] for x in ("hi", "mid", "lo"))
    low = lo * m[0] + 1
    middle = lo * m[1] + mid * m[0] + F.shiftright(low, 24)
    high = lo * m[2] + mid * m[1] + hi * m[0] + F.shiftright(middle, 24)
    high, middle, low = (x.bitwiseAND(F.lit(mask).cast("long")) for x, mask in ((high, 0xFFFF), (middle, 0xFFFFFF), (low, 0xFFFFFF)))
    top = F.shiftleft(high, 15) + F.shiftright(middle, 9)  # its highest 31 bits
    to = F.floor((state["at"] + 1).cast("double") * (F.lit(UNIT) / (top + 1).cast("double"))).cast("long")
    return F.struct(high.alias("hi"), middle.alias("mid"), low.alias("lo"), state["to"].alias("at"), to.alias("to"))


def jump(digits: Column, shards: int) -> Column:
    """struct(shard int, grown int): the shard of a key, given by 16 hex digits, among ``shards``, and with one more."""
    if shards < 1:
        raise ValueError("there must be a shard")
    hi, mid, lo = limbs(digits)
    zero = F.lit(0).cast("long")
    start = F.struct(hi.alias("hi"), mid.alias("mid"), lo.alias("lo"), zero.alias("at"), zero.alias("to"))

    def walk(state: Column, steps: int) -> Column:
        # a state is the last move (at) and the next (to); the first one leads from nowhere to shard 0
        moves = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: F.when(s["to"] < shards, _moved(s)).otherwise(s))
        return moves

    def _moved(s: Column) -> Column:
        return _step(F.struct(s["hi"].alias("hi"), s["mid"].alias("mid"), s["lo"].alias("lo"), s["to"].alias("at"), s["to"].alias("to")))

    end = walk(start, min(shards, STEPS))
    if shards > STEPS:
        end = F.transform(F.array(end), lambda s: F.when(s["to"] < shards, walk(s, shards)).otherwise(s))[0]
    # the state is needed once as a value: its expression is long
    return F.transform(F.array(end), lambda s: F.struct(s["at"].cast("int").alias("shard"), F.when(s["to"] == shards, F.lit(shards)).otherwise(s["at"]).cast("int").alias("grown")))[0]


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", order_by: tuple[str, ...] = (), rows_a_bucket: int = 200_000) -> DataFrame:
    """The rows of ``docs`` with shard int, slot long and grown_shard int (other names where ``docs`` has these; see `names`).

    The id and the number of shards decide the shard. Slots number a shard's rows from 0 without gaps, in the order of their keys, ids and
    the columns ``order_by``; rows that are equal in all of these are interchangeable. A null id is a key of its own, as an empty one;
    repeated rows each have a slot; an empty table gives none; other columns pass through.

    Two passes over the ids alone count rows and find how many fall into each of a shard's buckets (runs of keys of some ``rows_a_bucket``
    rows); then each row is moved once, to its bucket, and numbered there. Should an id by itself have more rows than a bucket, these
    are written with the number of the scan's task that read them, counted and numbered by task, and follow their bucket's other rows:
    no task ever holds a whole hot id.
    """
    shard, slot, grown = names(docs)
    key, bucket, hot, salt, rid, start, at = (fresh(docs, x) for x in ("shard_key", "shard_bucket", "shard_hot", "shard_salt", "shard_rid", "shard_start", "shard_at"))
    total = docs.select(id_col).count()
    bits = max(3, (max(1, total // (shards * rows_a_bucket)) - 1).bit_length())

    def keyed(df: DataFrame) -> DataFrame:
        df = df.withColumn(key, key_text(id_col)).withColumn(at, jump(F.col(key), shards))
        df = df.withColumns({shard: F.col(at)["shard"], grown: F.col(at)["grown"]}).drop(at)
        return df.withColumn(bucket, F.shiftright(F.conv(F.substring(F.col(key), 1, 8), 16, 10).cast("long"), 32 - min(bits, 32)))

    unit = [shard, bucket, hot, key, salt]
    plain = {hot: F.lit(0), salt: F.lit(0)}
    counted = keyed(docs.select(id_col)).groupBy(shard, bucket).agg(F.count("*").alias(start))
    counted = materialize(counted, "shard-buckets")
    full = counted.filter(F.col(start) > 4 * rows_a_bucket).select(shard, bucket)
    numbered = []
    whole = None
    if full.limit(1).count():
        # at most total / (4 * rows_a_bucket) buckets, and total / rows_a_bucket keys
        keys = keyed(docs.select(id_col)).join(F.broadcast(full), [shard, bucket]).groupBy(key).agg(F.count("*").alias(start)).filter(F.col(start) > rows_a_bucket)
        whole = materialize(keys.select(F.col(key).alias(rid)), "hot-keys")
        hit = F.col(key) == F.col(rid)
        tied = keyed(docs).join(F.broadcast(whole), hit, "left_semi").withColumns({hot: F.lit(1), salt: F.spark_partition_id(), rid: F.monotonically_increasing_id()})
        tied = materialize(tied, "hot-rows")
        cold = keyed(docs).join(F.broadcast(whole), hit, "left_anti")
        counted = keyed(docs.select(id_col)).join(F.broadcast(whole), hit, "left_anti").groupBy(shard, bucket).agg(F.count("*").alias(start))
        counted = counted.withColumns(plain | {key: F.lit("")}).unionByName(tied.groupBy(*unit).agg(F.count("*").alias(start)))
        numbered.append((tied, [rid]))
    else:
        cold = keyed(docs)
        counted = counted.withColumns(plain | {key: F.lit("")})
    before = Window.partitionBy(shard).orderBy(bucket, hot, key, salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counted.withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0))), "shard-starts")

    mine = Window.partitionBy(shard, bucket).orderBy(key, F.col(id_col), *order_by)
    out = cold.withColumn(at, F.row_number().over(mine)).join(starts.filter(F.col(hot) == 0).select(shard, bucket, start), [shard, bucket], "left")
    out = out.withColumn(slot, F.col(start) + F.col(at) - 1).select(*docs.columns, shard, slot, grown)
    for rows, order in numbered:
        within = Window.partitionBy(*unit).orderBy(*order)
        more = rows.withColumn(at, F.row_number().over(within)).join(starts.filter(F.col(hot) == 1), unit, "left")
        out = out.unionByName(more.withColumn(slot, F.col(start) + F.col(at) - 1).select(*docs.columns, shard, slot, grown))
    return out


def names(docs: DataFrame) -> tuple[str, str, str]:
    """What `shard_rows` calls its columns: shard, slot, grown_shard, each with underscores before it if ``docs`` has it already."""
    return fresh(docs, "shard"), fresh(docs, "slot"), fresh(docs, "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id") -> None:
    """A folder a shard (shard=0, shard=1, ...) of Parquet files with the rows and their slots."""
    shard_rows(docs, shards, id_col).write.partitionBy(names(docs)[0]).parquet(path)


def shard_table(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_a_bucket: int = 200_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; texts stay where they are, as what is told of them is
    computed before rows move. A null text has no bytes."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    told = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return shard_rows(told, shards, "doc_id", ("text_crc32", "size"), rows_a_bucket)
