"""Retrieval lanes: BM25, cosine over vectors, token overlap, passages; and rewriting and selection of lanes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import token_set, words
from tarn.scratch import materialize
from tarn.session import spread

K1, B, AVERAGE_LENGTH = 1.2, 0.75, 256.0
VECTORS = 512  # vectors that are compared with a block of queries at once
#: A side is broadcast only after it was counted and is at most this long; otherwise joins shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows. ``rows`` is a bound that the caller knows, as of a top k;
    without it the rows are counted, but no more than that, which runs the plan of ``df`` once for it."""
    return F.broadcast(df) if (df.limit(limit + 1).count() if rows is None else rows) <= limit else df


def query_blocks(queries: DataFrame, query_id: str, most: int) -> Iterator[list[tuple]]:
    """The rows of a table of queries in blocks of about ``most``, chosen by a hash of their ids; the driver holds one block at a time."""
    rows = queries.limit(most + 1).collect()
    if len(rows) <= most:
        yield [tuple(r) for r in rows]
        return
    blocks = -(-queries.count() // most)
    for i in range(blocks):
        yield [tuple(r) for r in queries.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i).collect()]


class _Asked:
    """A block of queries: terms with the queries that hold them, as arrays by term."""

    def __init__(self, rows: list[tuple], distinct: bool):
        self.ids = [r[0] for r in rows]
        counts = [Counter(dict.fromkeys(ts, 1) if distinct else ts) for _, ts in rows]
        self.sizes = np.array([max(1, sum(c.values())) for c in counts], np.float64)
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        pairs = sorted((self.terms[t], q, n) for q, c in enumerate(counts) for t, n in c.items())
        term = np.array([p[0] for p in pairs], np.int64)
        self.query, self.weight = np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], np.float64)
        self.starts = np.searchsorted(term, np.arange(len(self.terms) + 1))


def _best(query: np.ndarray, score: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query by score, ties by item."""
    order = np.lexsort((item, -score, query))
    query, score, item = query[order], score[order], item[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], score[keep], item[keep]


def _matches(asked, split):
    """Documents with the terms of the queries that they hold: (doc_id, length, terms, tfs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = asked.value.terms
        for b in batches:
            rows = []
            for d, t in zip(b["id"], b["t"], strict=True):
                ws = split(t.lower() if t else "")
                found = Counter(n for w in ws if (n := number.get(w)) is not None)
                if found:
                    rows.append((d, len(ws), list(found), list(found.values())))
            yield pd.DataFrame(rows, columns=["doc_id", "length", "terms", "tfs"])

    return run


def _scored(asked, part, scale, k: int):
    """Each task's k best documents per query: the sum over shared terms of weight times ``part(tf, length)``, times the query's scale."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = asked.value
        best = None
        for b in batches:
            if not len(b):
                continue
            sizes = np.fromiter(map(len, b["terms"]), np.int64, len(b))
            term, tf = np.concatenate(b["terms"].to_numpy()), np.concatenate(b["tfs"].to_numpy()).astype(np.float64)
            row = np.repeat(np.arange(len(b)), sizes)
            value = part(tf, b["length"].to_numpy(np.float64)[row], term)
            many = held.starts[term + 1] - held.starts[term]
            at = np.arange(int(many.sum())) + np.repeat(held.starts[term] - (np.cumsum(many) - many), many)
            pair, where = np.unique(held.query[at] * len(b) + np.repeat(row, many), return_inverse=True)
            query = pair // len(b)
            score = np.round(np.bincount(where, held.weight[at] * np.repeat(value, many)) * scale(held)[query], 6)
            found = query, score, b["doc_id"].to_numpy()[pair % len(b)]
            if best is not None:
                found = tuple(np.concatenate(x) for x in zip(best, found, strict=True))
            best = _best(*found, k)
        if best is not None:
            yield pd.DataFrame({"query_id": [held.ids[q] for q in best[0]], "doc_id": best[2], "score": best[1]})

    return run


def _lexical_top(queries: DataFrame, docs: DataFrame, k: int, terms, names: tuple[str, str, str, str], distinct: bool, part, scale, max_queries: int) -> DataFrame:
    query_id, query_text, id_col, text_col = names
    spark = docs.sparkSession
    kinds = dict(queries.dtypes)[query_id], dict(docs.dtypes)[id_col]
    split = re.compile("[a-z0-9]+").findall
    found = []
    for rows in query_blocks(queries.select(query_id, terms(F.col(query_text)).alias("ts")), query_id, max_queries):
        asked = spark.sparkContext.broadcast(_Asked(rows, distinct))
        texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        matched = materialize(spread(texts).mapInPandas(_matches(asked, split), f"doc_id {kinds[1]}, length int, terms array<int>, tfs array<int>"), "matches")
        found.append(matched.mapInPandas(_scored(asked, part(matched, asked), scale, k), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"))
    return lane_rank(reduce(DataFrame.unionByName, found), k)


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", max_queries: int = 20_000) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents per query by BM25, ties by id; a query's repeated term counts as often.

    Texts are read once: what is written of a document is the queries' terms in it. Frequencies of those terms are counted
    from that table and collected, one number per term of a block of queries. A document's terms are all in its row, so it
    is scored there, and each task sends its k best per query; pairs that share a term are never shuffled.
    """

    def part(matched: DataFrame, asked):
        n = docs.count()
        df = np.zeros(len(asked.value.terms))
        for r in matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
        return lambda tf, length, term: idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / AVERAGE_LENGTH)))

    return _lexical_top(queries, docs, k, words, (query_id, query_text, id_col, text_col), False, part, lambda held: np.ones(len(held.ids)), max_queries)


def overlap_top(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", max_queries: int = 20_000) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents per query by the share of the query's token set that they hold."""
    part = lambda matched, asked: lambda tf, length, term: np.ones(len(tf))
    return _lexical_top(queries, docs, k, token_set, (query_id, query_text, id_col, text_col), True, part, lambda held: 1 / held.sizes, max_queries)


def holding(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_id: str = "query_id", passage: str = "passage") -> DataFrame:
    """(passage_id, id): documents whose text holds a passage as it stands.

    A document that holds a passage holds all its words but the first and last as words. So a document only meets the
    passages whose longest such word it has. Passages without any (of one or two words) are met by their first run of
    three characters, or by themselves if they are shorter; only if there are such passages are runs taken from texts. Words and
    runs travel with ids alone; texts join the candidates last.
    """
    p = passages.select(passage_id, passage).filter(F.col(passage).isNotNull()).withColumn("_ws", words(F.col(passage)))
    inner = F.array_distinct(F.slice("_ws", 2, F.greatest(F.size("_ws") - 2, F.lit(0))))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    p = p.select(passage_id, passage, longest.alias("_key"))
    d = docs.select(F.col(id_col), F.col(text_col).alias("_text")).filter("_text IS NOT NULL")
    met = d.select(id_col, F.explode(F.array_distinct(words(F.col("_text")))).alias("_key")).join(small(p.filter("_key IS NOT NULL")), "_key")
    short = p.filter("_key IS NULL").withColumn("_key", F.left(passage, F.lit(3)))
    lengths = [r[0] for r in short.select(F.length("_key")).distinct().collect()]  # of 0, 1, 2, 3
    if lengths:
        runs = F.array_distinct(F.flatten(F.array(*[character_runs(F.col("_text"), n) for n in lengths])))
        met = met.unionByName(d.select(id_col, F.explode(runs).alias("_key")).join(small(short), "_key"))
    met = met.select(passage_id, F.col(id_col).alias("_id"), passage).distinct()
    return d.join(small(materialize(met, "may-hold")), F.col(id_col).eqNullSafe(F.col("_id")) & F.col("_text").contains(F.col(passage))).select(passage_id, id_col)


def character_runs(text: Column, n: int) -> Column:
    """All runs of n characters of a text (n = 0: an empty one); none if it is shorter."""
    if n == 0:
        return F.array(F.lit(""))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.filter(every, lambda r: F.length(r) == n)


def contained(short: DataFrame, long: DataFrame, width: int = 3) -> DataFrame:
    """(short, long): candidates for a text ``short`` (column of the first table) being part of a text ``long`` (of the second): those that
    have the rarest run of the shorter text. Texts must be distinct and not empty.

    The runs of 1 to ``width`` characters of the long texts are an index, each with the number of texts that have it. A short text of
    at least ``width`` characters looks all its runs up, and meets only the texts that have the one which fewest have; a run that none
    has ends its search. A shorter one looks itself up.
    """
    grams = F.array_distinct(F.flatten(F.array(*[character_runs(F.col("long"), n) for n in range(1, width + 1)])))
    held = materialize(long.select("long", F.explode(grams).alias("gram")), "grams")
    counts = held.groupBy("gram").agg(F.count("*").alias("texts"))
    own = F.when(F.length("short") < width, F.array("short")).otherwise(F.array_distinct(character_runs(F.col("short"), width)))
    asked = short.select("short", F.explode(own).alias("gram")).join(counts, "gram", "left")
    rarest = asked.groupBy("short").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("best")).filter("best.texts > 0")
    return rarest.select("short", F.col("best.gram").alias("gram")).join(held, "gram").select("short", "long")


def either_holds(left: DataFrame, right: DataFrame, a: str, b: str, width: int = 3) -> DataFrame:
    """Rows of both tables whose non-empty texts ``a`` and ``b`` are such that one is part of the other (or both are equal).

    Distinct texts find each other by their rarest runs (`contained`), in either direction, and the pairs of texts then meet the rows:
    a text that many rows share is looked up once, and joins back to its rows as a join that can be split.
    """
    left, right = left.filter(F.coalesce(F.col(a), F.lit("")) != ""), right.filter(F.coalesce(F.col(b), F.lit("")) != "")
    ls, rs = left.select(F.col(a).alias("short")).distinct(), right.select(F.col(b).alias("short")).distinct()
    longer = lambda df: df.withColumnRenamed("short", "long")
    inside = contained(ls, longer(rs), width).filter(F.col("long").contains(F.col("short"))).select(F.col("short").alias("_a"), F.col("long").alias("_b"))
    around = contained(rs, longer(ls), width).filter(F.col("long").contains(F.col("short")) & (F.col("long") != F.col("short"))).select(F.col("long").alias("_a"), F.col("short").alias("_b"))
    pairs = inside.unionByName(around)
    return left.join(pairs, F.col(a) == F.col("_a")).join(right, F.col("_b") == F.col(b)).drop("_a", "_b")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", id_col: str = "vec_id", vec_col: str = "embedding", max_queries: int = 20_000) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors by cosine, ties by id.

    Queries are compared in blocks of about ``max_queries`` vectors, chosen by a hash of their ids: every task compares
    a block with VECTORS of its rows at a time by a matrix product and sends only its k best per query, so what is shuffled
    grows with queries and tasks, not with rows. Each block is a scan of the vectors, and the driver holds one block at a time.
    """
    kind = dict(queries.dtypes)[query_id]
    found = [_dense_block(rows, kind, vectors, k, id_col, vec_col) for rows in query_blocks(queries.select(query_id, vec_col), query_id, max_queries)]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _dense_block(rows: list[tuple], query_kind: str, vectors: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, vec_id, score): each task's k nearest vectors per query of one block."""
    ids = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300) if len(rows) else 1
    held = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
    kind = dict(vectors.dtypes)[id_col]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = held.value
        best = None
        for b in batches:
            if not len(b) or not ids:
                continue
            x = np.array(b["v"].tolist(), np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            own = b["id"].to_numpy()
            for i in range(0, len(own), VECTORS):
                s = np.round(q @ x[i : i + VECTORS].T, 6)
                if s.shape[1] > k:  # whatever ties with the k-th stays until ids decide
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    if best is not None:
                        least = np.maximum(least, floor[:, None])
                    query, at = np.nonzero(s >= least)
                else:
                    query, at = np.nonzero(np.ones(s.shape, bool))
                found = query, s[query, at], own[i : i + VECTORS][at]
                if best is not None:
                    found = tuple(np.concatenate(p) for p in zip(best, found, strict=True))
                best = _best(*found, k)
                # What a vector must score to enter: the k-th of a query that has k already.
                floor = np.where(np.bincount(best[0], minlength=len(ids)) >= k, np.inf, -np.inf)
                np.minimum.at(floor, best[0], best[1])
        if best is not None:
            yield pd.DataFrame({"query_id": [ids[i] for i in best[0]], "vec_id": best[2], "score": best[1]})

    some = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("v IS NOT NULL")
    return some.mapInPandas(nearest, f"query_id {query_kind}, vec_id {kind}, score double")


def lane_rank(hits: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best hits per group with their rank, ties by item."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(item).asc())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lane_queries(tasks: DataFrame) -> DataFrame:
    """(task_id, lane, query) for tasks (task_id, text, should, must, sections): dense keeps the text; sparse adds should
    terms once and must terms three times; section adds section terms; table adds the words of table look-ups."""
    unique = lambda *xs: F.array_join(F.array_distinct(F.filter(F.concat(*xs), lambda t: t != "")), " ")
    text, should, must, sections = F.array("text"), F.col("should"), F.col("must"), F.col("sections")
    boosted = F.flatten(F.array_repeat(must, 3))
    sparse = F.trim(F.concat_ws(" ", unique(text, should), F.array_join(boosted, " ")))
    lanes = F.array(
        F.struct(F.lit("dense").alias("lane"), F.col("text").alias("query")),
        F.struct(F.lit("sparse").alias("lane"), sparse.alias("query")),
        F.struct(F.lit("section").alias("lane"), unique(text, sections).alias("query")),
        F.struct(F.lit("table").alias("lane"), F.concat_ws(" ", F.col("text"), F.lit("table row page")).alias("query")),
    )
    return tasks.select("task_id", F.explode(lanes).alias("x")).select("task_id", "x.lane", "x.query")


#: Lanes of each mode; an unknown mode is dense only.
MODES = {"dense": ("dense",), "bm25": ("sparse",), "rrf": ("dense", "sparse"), "rerank": ("dense", "sparse")}


def lanes_of(mode: str, purpose: str = "") -> tuple[str, ...]:
    """Lanes to run for a mode and a unit's purpose; purposes that name tables, sections or metrics add theirs."""
    lanes = list(MODES.get(mode, ("dense",)))
    if len(lanes) > 1:
        lanes += [lane for word, lane in (("table", "table"), ("section", "section"), ("metric", "metric_alias")) if word in purpose.lower()]
    return tuple(lanes)


def lane_top_k(configured: int = 0, task: int = 0, requested: int = 0) -> int:
    return max(1, configured, task, requested)


def effective_top_k(requested: int | None, default: int = 8, most: int = 12) -> int:
    return min(requested or default, most)


def keep_where(df: DataFrame, wanted: dict, columns: dict[str, str] | None = None) -> DataFrame:
    """Conjunction of conditions on known columns: a list means one of, a scalar equals; unknown keys are ignored.

    Keys may be aliases: section_name, document_type and filing_type. Conditions are plain, so Parquet scans take them.
    """
    alias = {"section_name": "section_title", "document_type": "file_type", "filing_type": "file_type"} | (columns or {})
    for key, value in wanted.items():
        name = key if key in df.columns else alias.get(key, key)
        if name in df.columns and value is not None:
            df = df.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def merged_filters(base: dict | None, task: dict | None) -> dict:
    return {**(base or {}), **(task or {})}


def all_terms(text: Column, terms: Column) -> Column:
    """Every term (in normal form) is part of the text."""
    return F.forall(terms, lambda t: text.contains(t))
