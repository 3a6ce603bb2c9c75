"""Exact Jaccard self-join of word shingle sets over a token-group matrix.

Similar documents form groups; of each group the union of its tokens is kept (a row of the token-group matrix). A
query set's overlap with that union bounds its overlap with every member, so a group is opened only if the bound and
the sizes allow a link. Three things keep this exact and linear in all but the pairs that really have to be compared:

* Keys say which documents must be in touch at all: sets that meet the threshold share one. For high thresholds they
  are partition signatures: such sets differ in at most d tokens, so if the token space is cut into d + 1 ranges, one
  range holds the same tokens in both, and the hash of its tokens is shared. Common passages rarely fill a range. For
  lower thresholds ranges would be narrow; there the keys are each set's first (1 - t) n + 1 tokens in one global
  order (prefix filter), by document frequency, rarest first, so that common passages come last. Frequencies are
  counted over all documents in a hashed table of fixed size; any order is exact, collisions cost selectivity only.
* A row of the token-group matrix: tokens fall into groups by their hash, about PER_GROUP of a set into each, and a set has a
  count for each group. The sum of the smaller counts of two sets bounds their overlap, and so does the largest count of
  a group's members for all of them. Candidates that can't qualify by that are gone before any token set is read.
* Of the documents that share a key, the one whose keys are shared most is the pivot, mostly the original
  of a family of copies. Documents are grouped by pivot and compared with it first; what links to it needs no further
  comparison with others that do.
* The rest queries its group's other blocks, and blocks of other groups with which it shares a key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, materialize, runs
from .components import components
from .exact_dedup import exact_groups_and_filter
from .repeats import probe, repeat_filter
from .shingles import Shingler, mixed

BLOCK = 128  # members of a block of a group, on average
WIDE = 7  # from a threshold of 1 - 1/WIDE on, ranges hold about WIDE tokens or more
QUERIES = 256  # queries that one task puts to a block, on average
FEW = 300_000  # rows of work that are broadcast, some 25 MB


def size_levels(num: int, den: int, upto: int = 1 << 34) -> list[int]:
    """Starts of size levels: sets that link (num/den of the union) are in the same level or in neighbouring ones."""
    starts = [1]
    while starts[-1] < upto:
        b = starts[-1]
        starts.append(max(b + 1, (b - 1) * den // num + 1))
    return starts


def _ranges(tag: int, levels: list[int], num: int, den: int) -> int:
    """d + 1 for pairs whose smaller set is in level ``tag`` and whose other set is there or one level up."""
    return (levels[tag + 1] - 1 + levels[tag + 2] - 1) * (den - num) // (den + num) + 1


def signatures(tokens: np.ndarray, levels: list[int], num: int, den: int) -> np.ndarray:
    """One hash for each range of tokens, for the level of the set and for the level below."""
    level = bisect_right(levels, len(tokens)) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
    found = []
    for tag in (level, level - 1) if level else (level,):
        n = _ranges(tag, levels, num, den)
        width = (1 << 64) // n + 1
        at = np.searchsorted(tokens, np.arange(n, dtype=np.uint64) * np.uint64(width)) if n > 1 else np.zeros(1, int)
        at = np.append(at, len(tokens))
        salt = np.arange(n, dtype=np.uint64) + np.uint64((tag + 1) << 40)
        found.append(mixed(mixed(sums[at[1:]] - sums[at[:-1]]) + mixed(salt)))
    return np.concatenate(found)


GROUPS, PER_GROUP = 64, 4  # token groups of a row of the matrix at least (a power of two), and tokens a group else
FULL = 255  # a count that stands for itself and all larger ones
CELLS, PARTS = 1 << 20, 256  # of the table of frequencies, and the parts in which tasks send theirs


def matrix_row(tokens: np.ndarray) -> bytes:
    """A set's counts by token group, a byte each; groups are ranges of hashes, twice as many where the set is twice as large."""
    bits = max(GROUPS.bit_length() - 1, (max(1, len(tokens) // PER_GROUP) - 1).bit_length())
    counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def _rows(rows: list[bytes], size: int) -> np.ndarray:
    """Rows of one length, with ``size`` groups: neighbouring ones are added; FULL stays at least FULL."""
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), size, -1)
    return x.sum(axis=2, dtype=np.int64)


def most_shared(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many tokens two sets may share at most, by their rows; very many if a group is full in both."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(sizes), np.int64)
    for m, n in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (m, n)).all(axis=1))
        for i in range(0, len(at), 4096):
            own = at[i : i + 4096].tolist()
            x, y = (_rows([rows[k] for k in own], min(m, n)) for rows in (a, b))
            less = np.minimum(x, y)
            out[own] = np.where((less >= FULL).any(axis=1), 1 << 40, less.sum(axis=1))
    return out


def _widest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of groups: (grp, row) with the largest counts of a group's rows seen here; rows come in any order and number."""
    held: dict[int, np.ndarray] = {}

    def sent() -> pd.DataFrame:
        return pd.DataFrame({"grp": list(held), "row": [np.minimum(r, FULL).astype(np.uint8).tobytes() for r in held.values()]})

    for b in batches:
        for g, row in zip(b["grp"].tolist(), b["row"], strict=True):
            old = held.get(g)
            size = len(row) if old is None else min(len(row), len(old))
            new = _rows([row], size)[0]
            held[g] = new if old is None else np.maximum(new, old.reshape(size, -1).sum(axis=1))
        if sum(map(len, held.values())) > 4_000_000:
            yield sent()
            held = {}
    if held:
        yield sent()


def group_rows(members: DataFrame) -> DataFrame:
    """(grp, row) of members (grp, row): partial ones in every task first, so that a large group sends a row per task."""
    kind = "grp long, row binary"
    partial = members.select("grp", "row").mapInPandas(lean(_widest), kind)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, found in runs(batches, ["grp"]):
            yield from _widest([found])

    return partial.repartition("grp").sortWithinPartitions("grp").mapInPandas(lean(merged), kind)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def _frequencies(width: int):
    """A task's counts of documents per cell, in parts; documents with the same text count each."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, count = Shingler(width), np.zeros(CELLS, np.int64)
        for b in batches:
            for i in range(0, len(b), _ROWS):
                sets = [shingle(t) for t in b["text"].iloc[i : i + _ROWS]]
                if sets:
                    count += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
        if count.any():
            cut = np.minimum(count, 65_535).astype(np.uint16).reshape(PARTS, -1)
            yield pd.DataFrame({"part": np.arange(PARTS, dtype=np.int32), "counts": [c.tobytes() for c in cut]})

    return run


@lean
def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, total = None, None
    for b in batches:
        for k, counts in b.itertuples(index=False):
            if k != part:
                if part is not None:
                    yield pd.DataFrame({"part": [part], "counts": [_log(total)]})
                part, total = k, np.zeros(CELLS // PARTS, np.int64)
            total += np.frombuffer(counts, np.uint16)
    if part is not None:
        yield pd.DataFrame({"part": [part], "counts": [_log(total)]})


def _log(total: np.ndarray) -> bytes:
    return np.minimum(np.round(6 * np.log2(1 + total)), 255).astype(np.uint8).tobytes()


def frequency_table(texts: DataFrame, width: int):
    """A broadcast of one byte per cell: the logarithm of how many documents of ``texts`` (one column text) hold its tokens."""
    parts = texts.mapInPandas(_frequencies(width), "part int, counts binary")
    summed = parts.repartition("part").sortWithinPartitions("part").mapInPandas(_summed, "part int, counts binary")
    table = np.zeros(CELLS, np.uint8)
    for row in summed.collect():  # PARTS rows, CELLS bytes together
        table[row.part * (CELLS // PARTS) : (row.part + 1) * (CELLS // PARTS)] = np.frombuffer(row.counts, np.uint8)
    return texts.sparkSession.sparkContext.broadcast(table)


def prefix(tokens: np.ndarray, table: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest tokens of a set, as many as it takes to share one with any set that meets the threshold."""
    n = len(tokens)
    keep = n - (num * n + den - 1) // den + 1
    order = np.argsort((table[_cell(tokens)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8)), kind="stable")
    return tokens[order[:keep]]


_ROWS = 1000  # documents whose sets a worker holds at once


def _sets(width: int, num: int, den: int, held, frequency):
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, levels = Shingler(width), size_levels(num, den)
        table = None if frequency is None else frequency.value

        def keys(tokens: np.ndarray) -> np.ndarray:
            if not len(tokens):
                return np.empty(0, np.int64)
            return (signatures(tokens, levels, num, den) if table is None else prefix(tokens, table, num, den)).view(np.int64)

        for whole in batches:
            for i in range(0, len(whole), _ROWS):
                b = whole.iloc[i : i + _ROWS]
                sets = [shingle(t) for t in b["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"],
                        "sha": b["sha"],
                        "n": np.array([len(s) for s in sets], np.int64),
                        "level": np.array([bisect_right(levels, len(s)) - 1 for s in sets], np.int32),
                        "sigs": [keys(s) for s in sets],
                        "row": [matrix_row(s) for s in sets],
                        "again": probe(b["k"].to_numpy(np.int64), held),
                    }
                )

    return run


def _repeated(held):
    """A row for each key of a document that the filter holds."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sigs = np.concatenate(b["sigs"].to_numpy())
            row = np.repeat(np.arange(len(b)), np.fromiter(map(len, b["sigs"]), np.int64, len(b)))
            at = np.flatnonzero(probe(sigs, held))
            row = row[at]
            yield pd.DataFrame({"sig": sigs[at], "doc_id": b["doc_id"].to_numpy(np.int64)[row], "n": b["n"].to_numpy()[row], "level": b["level"].to_numpy()[row]})

    return run


def _tokens(width: int, held):
    """Tokens of documents whose id the filter holds; a few more pass it by chance."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for whole in batches:
            given = whole[whole["doc_id"].notna()]
            given = given[probe(given["k"].to_numpy(np.int64), held)]
            for i in range(0, len(given), _ROWS):
                b = given.iloc[i : i + _ROWS]
                yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [shingle(t).tobytes() for t in b["text"]]})

    return run


class Block:
    """A block of a group: its row of the token-group matrix and, for each token of it, the members that hold it."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.ids = np.array([d for d, _ in members], np.int64)
        self.sizes = np.array([len(t) for _, t in members], np.int64)
        self.union, inverse, counts = np.unique(np.concatenate([t for _, t in members]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(members)), self.sizes)
        self.owners = owner[np.argsort(inverse, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.label = np.arange(len(members))

    def links(self, doc: int, tokens: np.ndarray, num: int, den: int) -> list[int]:
        """Members to link ``doc`` with, one of each set of members already linked here; they are merged by that."""
        n = len(tokens)
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        fits = (den * np.minimum(self.sizes, n) >= num * np.maximum(self.sizes, n)) & (self.ids != doc)
        if den * len(at) < num * n or not fits.any():  # the bound: no member can share enough
            return []
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        spread = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(self.starts[at], lengths)
        shared = np.bincount(self.owners[spread], minlength=len(self.ids))
        good = np.flatnonzero(fits & (den * shared >= num * (n + self.sizes - shared)))
        if not len(good):
            return []
        labels, first = np.unique(self.label[good], return_index=True)
        self.label[np.isin(self.label, labels)] = labels[0]
        return [int(self.ids[good[i]]) for i in first]


def _compare(num: int, den: int):
    """Rows of a block and salt come together, members (role 0) before queries (role 1)."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, members, block = None, [], None
        for b in batches:
            found: list[tuple[int, int]] = []
            for *k, role, doc, tokens in b[["grp", "merged", "level", "part", "salt", "role", "doc_id", "tokens"]].itertuples(index=False):
                if k != key:
                    key, members, block = k, [], None
                t = np.frombuffer(tokens, np.uint64)
                if role == 0:
                    members.append((doc, t))
                elif members:
                    block = block or Block(members)
                    found += [(doc, m) for m in block.links(doc, t, num, den)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


_KEY = ["grp", "merged", "level", "part"]


def _linked(members: DataFrame, queries: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Links between each query and the members of the block it is put to; both tables: the key of a block and doc_id."""
    queries = materialize(queries, "queries")
    asked = materialize(queries.groupBy(*_KEY).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts")), "asked")
    asks = queries.join(asked, _KEY).select(*_KEY, F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), "doc_id")
    holds = members.join(asked, _KEY).select(*_KEY, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "doc_id")
    work = materialize(holds.unionByName(asks), "work")
    # Few rows of work go to the token sets; many meet them in a merge join, whose skewed partitions can be split.
    rows = tokens.join(F.broadcast(work), "doc_id") if work.count() <= FEW else work.join(tokens.hint("merge"), "doc_id")
    dealt = rows.repartition(*_KEY, "salt").sortWithinPartitions(*_KEY, "salt", "role")
    return dealt.mapInPandas(_compare(num, den), "a long, b long")


def _compatible(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _wide(num: int, den: int) -> bool:
    return num * WIDE >= den * (WIDE - 1)


def _may_qualify(a: Column, b: Column, sizes: Column, num: int, den: int) -> Column:
    """Whether the overlap that two rows of the matrix allow is enough for sets of together ``sizes`` tokens."""

    @F.pandas_udf("boolean")
    @lean
    def ask(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, n in parts:
            yield pd.Series(most_shared(x.tolist(), y.tolist()) * (den + num) >= n.to_numpy(np.int64) * num)

    return ask(a, b, sizes)


def jaccard_links(docs: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect all documents of ``sets`` (doc_id, n, level, sigs, row) whose Jaccard similarity is at least num/den."""
    # Most keys have one document: a filter over all of them says which may have more, and only those leave their documents.
    # Keys that a large family shares are counted map-side first, and meet their documents in a join that can be split.
    keyed = sets.filter("n > 0")
    total = keyed.agg(F.sum(F.size("sigs"))).first()[0] or 0
    repeated = repeat_filter(keyed.select("sigs"), total)
    maybe = materialize(keyed.select("doc_id", "n", "level", "sigs").mapInPandas(_repeated(repeated), "sig long, doc_id long, n long, level int"), "keys")
    repeated.destroy()
    several = materialize(maybe.groupBy("sig").agg(F.count("*").alias("d")).filter("d > 1"), "key-counts")
    shared = materialize(maybe.join(several, "sig"), "shared-keys")

    score = materialize(shared.groupBy("doc_id", "n", "level").agg(F.sum("d").alias("score")), "scores")
    pivots = shared.select("sig", "doc_id").join(score, "doc_id")
    pivots = pivots.groupBy("sig").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id", F.col("n").alias("pn"))).alias("p"))
    pivots = materialize(pivots.select("sig", F.col("p.doc_id").alias("grp"), (-F.col("p.s")).alias("ps"), F.col("p.pn").alias("pn")), "pivots")
    near = shared.join(pivots, "sig").filter(_compatible(F.col("n"), F.col("pn"), num, den))
    near = near.groupBy("doc_id", "n", "level", "grp", "ps", "pn").agg(F.count("*").alias("c"))
    matrix = materialize(sets.join(score.select("doc_id"), "doc_id", "left_semi").select("doc_id", "row"), "matrix")
    near = near.join(matrix, "doc_id").join(matrix.select(F.col("doc_id").alias("grp"), F.col("row").alias("pivot_row")), "grp")
    # Narrow keys bring documents together that have little in common; those stay apart. With wide ones all that share
    # keys with a pivot are its group, so that a large family of copies is one group whatever its members' distances.
    if not _wide(num, den):
        near = near.filter(_may_qualify(F.col("row"), F.col("pivot_row"), F.col("n") + F.col("pn"), num, den))
    best = near.groupBy("doc_id", "n", "level").agg(F.min(F.struct((-F.col("c")).alias("c"), (-F.col("ps")).alias("s"), "grp")).alias("p"))
    # A document without a fitting pivot is a group of its own.
    groups = score.select("doc_id", "n", "level").join(best.select("doc_id", F.col("p.grp").alias("g")), "doc_id", "left")
    groups = materialize(groups.select("doc_id", "n", "level", F.coalesce("g", "doc_id").alias("grp")), "groups")

    # Between groups that share a key, the smaller asks the larger, if the matrix allows a link with a member.
    held = materialize(groups.groupBy("grp").agg(F.count("*").alias("m"), F.min("n").alias("least")), "group-sizes")
    at = materialize(shared.select("sig", "doc_id").join(groups.join(held, "grp").select("doc_id", "grp", "m"), "doc_id"), "key-groups")
    torn = materialize(at.groupBy("sig").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).filter("x < y").select("sig"), "torn")
    torn_at = materialize(at.join(torn, "sig"), "torn-groups")
    rows = group_rows(groups.select("doc_id", "grp").join(matrix, "doc_id")).withColumnRenamed("row", "group_row")
    rows = materialize(rows.join(held, "grp"), "group-rows")
    # First group against group: documents only meet the groups whose rows allow a link with any of theirs.
    mine = torn_at.groupBy("sig", "grp").agg(F.first("m").alias("m"))
    theirs = mine.select("sig", F.col("grp").alias("og"), F.col("m").alias("om"))
    meet = materialize(mine.join(theirs, "sig").filter("m < om OR (m = om AND grp < og)").select("sig", "grp", "og"), "groups-that-meet")
    pairs = meet.select("grp", "og").distinct().join(rows.select("grp", F.col("group_row").alias("own_row"), F.col("least").alias("own_least")), "grp")
    pairs = pairs.join(rows.select(F.col("grp").alias("og"), "group_row", "least"), "og")
    pairs = pairs.filter(_may_qualify(F.col("own_row"), F.col("group_row"), F.col("own_least") + F.col("least"), num, den)).select("grp", "og")
    meet = meet.join(materialize(pairs, "qualifying-groups"), ["grp", "og"])
    across = torn_at.select("sig", "grp", "doc_id").join(meet, ["sig", "grp"]).select("doc_id", F.col("og").alias("grp")).distinct()
    # Then each of their documents against the group.
    across = across.join(groups.select("doc_id", "n", "level"), "doc_id").join(rows, "grp").join(matrix, "doc_id")
    across = across.filter(F.col("least") * num <= F.col("n") * den)
    smaller = F.greatest(F.col("least"), F.ceil(F.col("n") * num / den))
    across = across.filter(_may_qualify(F.col("row"), F.col("group_row"), F.col("n") + smaller, num, den)).select("doc_id", "level", "grp")
    across = materialize(across, "across")

    # Token sets of what is compared: members of groups of two or more and of asked groups, askers, pivots and who has one.
    asked = across.select("grp").unionByName(held.filter("m > 1").select("grp")).distinct()
    away = groups.filter("doc_id <> grp")  # a pivot may itself be in another group
    wanted = groups.join(asked, "grp", "left_semi").select("doc_id").unionByName(across.select("doc_id"))
    wanted = wanted.unionByName(away.select("doc_id")).unionByName(away.select(F.col("grp").alias("doc_id"))).distinct()
    wanted = materialize(wanted, "wanted")
    # Their ids as a Bloom filter (each given twice), so that no text is shuffled to find them.
    ids = wanted.select(F.xxhash64("doc_id").alias("k"))
    bloom = repeat_filter(ids.unionByName(ids), 2 * wanted.count())
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    tokens = docs.select("doc_id", text, F.xxhash64("doc_id").alias("k")).mapInPandas(_tokens(width, bloom), "doc_id long, tokens binary")
    tokens = materialize(tokens, "tokens")
    bloom.destroy()
    tokens = tokens.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "doc_id", "left_semi")

    # First the pivots, each a block of one member.
    pivot_key = [F.col("grp"), F.lit(True).alias("merged"), F.lit(-1).alias("level"), F.lit(0).alias("part")]
    others = groups.filter("doc_id <> grp").select(*pivot_key, "doc_id")
    heads = groups.filter("doc_id <> grp").select("grp").distinct().select(*pivot_key, F.col("grp").alias("doc_id"))
    first = materialize(_linked(heads, others, tokens, num, den).distinct(), "pivot-links")

    merged = groups.join(first.select(F.col("a").alias("doc_id"), F.lit(True).alias("hit")).distinct(), "doc_id", "left")
    merged = materialize(merged.select("doc_id", "n", "level", "grp", (F.col("hit").isNotNull() | (F.col("doc_id") == F.col("grp"))).alias("merged")), "merged")
    blocks = merged.groupBy("grp", "merged", "level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    blocks = materialize(blocks, "blocks")
    placed = merged.join(blocks, ["grp", "merged", "level"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    placed = materialize(placed.select("doc_id", "n", "level", "grp", "merged", "part"), "placed")

    # Inside a group: what isn't merged asks all blocks of similar size; of two such blocks only the later one is asked.
    c = blocks.select("grp", F.col("merged").alias("cm"), F.col("level").alias("cl"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cp"))
    asking = placed.filter("NOT merged").join(c, "grp").filter("abs(level - cl) <= 1 AND (cm OR cl > level OR (cl = level AND cp >= part))")
    inside = asking.select("grp", F.col("cm").alias("merged"), F.col("cl").alias("level"), F.col("cp").alias("part"), "doc_id")

    outside = across.join(c, "grp").filter("abs(level - cl) <= 1")
    outside = outside.select("grp", F.col("cm").alias("merged"), F.col("cl").alias("level"), F.col("cp").alias("part"), "doc_id")

    rest = _linked(placed.select(*_KEY, "doc_id"), inside.unionByName(outside), tokens, num, den)
    return first.unionByName(rest)


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: tuple[int, int] = (4, 5),
) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id).

    Two documents link if the intersection of their sets of ``width``-word shingles is at least ``threshold`` of the
    union; component_id is the smallest id that links reach. Sets are compared exactly, as sets of 64-bit hashes.
    Equal texts are compared once and share their component. Null, empty and white-space texts have no shingles and
    link with nothing; texts of any length are used whole. Rows that share an id count as one document. A row with a
    null id has its n_shingles, no component and no links. Other columns are not read; an empty table gives no rows.
    """
    num, den = threshold
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    copies, held = exact_groups_and_filter(docs)
    copies = copies.select("doc_id", "keep_id", "group_size", F.unhex("text_sha256").alias("sha"))
    copies = materialize(copies, "copies")
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("sha")
    dropped = copies.filter("doc_id < keep_id OR (doc_id IS NULL AND keep_id IS NOT NULL)").select("doc_id", "sha")
    hashed = docs.select("doc_id", "text", sha).withColumn("k", F.xxhash64("sha"))
    # Ranges of tokens say much if they are wide, as they are for high thresholds; else rare tokens say more.
    frequency = None if _wide(num, den) else frequency_table(hashed.select("text"), width)
    every = hashed.mapInPandas(_sets(width, num, den, held, frequency), "doc_id long, sha binary, n long, level int, sigs array<long>, row binary, again boolean")
    every = materialize(every, "all-sets")
    if frequency is not None:
        frequency.destroy()
    # Only sets of texts that may have copies meet the table of dropped rows.
    dropped = materialize(dropped.withColumnRenamed("doc_id", "_d").withColumnRenamed("sha", "_s"), "dropped-copies")
    dropped = F.broadcast(dropped) if dropped.count() <= FEW else dropped
    first = every.filter("again").join(dropped, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("sha") == F.col("_s")), "left_anti")
    sets = every.filter("NOT again").unionByName(first).drop("again")

    links = jaccard_links(docs, sets.filter("doc_id IS NOT NULL"), width, num, den)
    roots = materialize(components(links), "roots")
    least = materialize(copies.filter("group_size > 1").groupBy("keep_id").agg(F.min("doc_id").alias("least")), "least-copies")
    smallest = roots.join(least, roots.v == least.keep_id, "left").groupBy("root").agg(F.min(F.least(F.coalesce("least", "v"), "v")).alias("label"))
    labels = roots.join(materialize(smallest, "labels"), "root").select("v", "label")
    vertex = sets.select("doc_id", "sha", "n").dropDuplicates(["sha"]).join(materialize(labels, "vertex-labels").withColumnRenamed("v", "doc_id"), "doc_id", "left")
    vertex = vertex.join(least.withColumnRenamed("keep_id", "doc_id"), "doc_id", "left").select("sha", "n", F.coalesce("label", "least").alias("label"))
    vertex = materialize(vertex, "vertices")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "doc_id"))
    out = copies.join(vertex, "sha", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs``, with all columns, but of each component of near-duplicates only the smallest id's; rows with a null id stay."""
    gone = fresh(docs, "gone")
    found = jaccard_components(docs, id_col, text_col, width, threshold)
    dropped = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    return docs.join(dropped, F.col(id_col) == F.col(gone), "left_anti")
