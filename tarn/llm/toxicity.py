"""Toxicity by class-conditional Kneser-Ney models over the bytes inside words.

Each class has its own counts of the longest n-grams (``ORDER`` bytes, shorter at the start of a word); what those
leave by absolute discounting goes to backoff distributions of continuation counts that both classes share. A rare
expression is thus scored by the shared backoff in both models and cancels out of their ratio. A text's signals are
length-normalised log-likelihood ratios: the largest mean of ``WINDOW`` neighbouring words, the mean of the whole text, and
what its distinct words have above ``CLEAR`` each, over the root of their number, so that expressions of which each is
rare add up. A logistic curve over them, fitted on labelled rows the models did not see, makes a probability of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, remainder
from .shingles import mixed

ORDER = 5
WINDOW = 4
CLEAR = 2.0  # a word's log-likelihood ratio up to which it says nothing by itself
SIGNALS = ["peak", "mean", "excess"]
DISCOUNT = 0.75
#: Cells of a model of hashed counts (`_ngrams` of a few words); fitted models hold counts by 63-bit keys, one per n-gram.
CELLS = 1 << 20
#: Labelled rows of which the curve's share is taken, at most (a sample by hash of the id; all rows if there are fewer);
#: no more labels are broadcast. The models learn from all labelled rows.
MAX_ROWS = 200_000
_HELD = 40_000  # distinct words a task holds before it sends their n-grams
_DISTINCT = 200_000  # words that a worker keeps scores of
_ROWS = 500  # texts that are split into words at once
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KINDS = ["c0", "c1", "t0", "t1", "f0", "f1", "s", "st", "sf"]
#: The kinds of counts that each kind of key has.
_GROUPS = {"gram": ["c0", "c1"], "context": ["t0", "t1", "f0", "f1"], "suffix": ["s"], "suffix_context": ["st", "sf"]}


def tokenize(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


class _Grams:
    """All n-grams of all words, as hashes per byte position and order; a word has a blank before and after it.

    With ``keyed`` hashes are 63-bit keys (the order is part of them), else cells.
    """

    def __init__(self, words: list[bytes], keyed: bool = False):
        spaced = [b" " + w + b" " for w in words]
        flat = np.frombuffer(b"".join(spaced), np.uint8).astype(np.uint64)
        lengths = np.fromiter(map(len, spaced), np.int64, len(spaced))
        self.word = np.repeat(np.arange(len(spaced)), lengths)
        self.pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        h = np.zeros(len(flat), np.uint64)
        self.gram, self.context = [], []
        for m in range(1, ORDER + 1):
            shifted = np.zeros(len(flat), np.uint64)
            shifted[m - 1 :] = flat[: len(flat) - m + 1]
            before = h
            h = mixed(h * _STEP + shifted + np.uint64(m * 1000))
            context = np.zeros(len(flat), np.uint64)
            context[1:] = before[:-1]
            cell = self.key if keyed else self.cell
            self.gram.append(cell(h))
            self.context.append(cell(mixed(context + np.uint64(m))))

    @staticmethod
    def cell(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(20)).astype(np.int64) & (CELLS - 1)

    @staticmethod
    def key(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(1)).astype(np.int64)


def _ngrams(words: Counter, other: Counter, keyed: bool = False) -> pd.DataFrame:
    """A row per distinct n-gram cell (or key): its order, cells of itself, its context, suffix and the suffix's context, and counts."""
    names = list(words.keys() | other.keys())
    g, kind = _Grams(names, keyed), np.int64 if keyed else np.int32
    counts = [np.fromiter((c[w] for w in names), np.float64, len(names)) for c in (words, other)]
    parts = []
    for m in range(1, ORDER + 1):
        at = np.flatnonzero((g.pos >= 1) & (g.pos + 1 >= m))
        first = m == ORDER or None
        top = np.ones(len(at), bool) if first else g.pos[at] + 1 == m
        suffix = g.gram[m - 2][at] if m > 1 else np.zeros(len(at), np.int64)
        suffix_context = g.context[m - 2][at] if m > 1 else np.zeros(len(at), np.int64)
        key = mixed((g.gram[m - 1][at] * 2 + top).astype(np.uint64) + np.uint64(m << 40)) ^ mixed(g.context[m - 1][at].astype(np.uint64) + (suffix.astype(np.uint64) << np.uint64(24)))
        _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        parts.append(
            pd.DataFrame(
                {
                    "m": np.full(len(index), m, np.int32),
                    "top": top[index],
                    "gram": g.gram[m - 1][at][index].astype(kind),
                    "context": g.context[m - 1][at][index].astype(kind),
                    "suffix": suffix[index].astype(kind),
                    "suffix_context": suffix_context[index].astype(kind),
                    "n0": np.bincount(inverse, counts[0][g.word[at]], len(index)),
                    "n1": np.bincount(inverse, counts[1][g.word[at]], len(index)),
                }
            )
        )
    return pd.concat(parts)


@lean
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            held[int(toxic)].update(tokenize(text))
            if len(held[0]) + len(held[1]) > _HELD:
                yield _ngrams(*held, keyed=True)
                held = (Counter(), Counter())
    if held[0] or held[1]:
        yield _ngrams(*held, keyed=True)


def fit_counts(labelled: DataFrame) -> dict[str, np.ndarray]:
    """The two models for rows (text, toxic 0/1): sorted keys per group of counts, where their leading bits start, and the counts at their places.

    A key is that of one n-gram or context (two share a 63-bit key by a chance of about n^2 / 2^64 for n keys), so the
    tables grow with the distinct n-grams of the rows. Only sums per key reach the driver.
    """
    key = ["m", "top", "gram", "context", "suffix", "suffix_context"]
    grams = labelled.mapInPandas(_count, "m int, top boolean, gram long, context long, suffix long, suffix_context long, n0 double, n1 double")
    grams = materialize(grams.groupBy(*key).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "ngrams")
    top = grams.filter("top")
    lower = grams.filter("m > 1").groupBy("suffix", "suffix_context").agg(F.count("*").alias("s"))
    tables = {
        "gram": top.groupBy("gram").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1")),
        "context": top.groupBy("context").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count_if(F.col("n0") > 0).alias("f0"), F.count_if(F.col("n1") > 0).alias("f1")),
        "suffix": lower.groupBy("suffix").agg(F.sum("s").alias("s")),
        "suffix_context": lower.groupBy("suffix_context").agg(F.sum("s").alias("st"), F.count("*").alias("sf")),
    }
    model = {}
    for group, table in tables.items():
        kinds = _GROUPS[group]
        rows = table.select(group, *[F.col(k).cast("float").alias(k) for k in kinds]).toPandas().sort_values(group)
        model[f"{group}_keys"] = known = np.append(rows[group].to_numpy(np.int64), np.iinfo(np.int64).max)
        bits = min(40, len(known).bit_length() + 1)
        model[f"{group}_first"] = np.searchsorted(known, np.arange(1 << bits, dtype=np.int64) << (63 - bits)).astype(np.int32)
        model |= {k: np.append(rows[k].to_numpy(np.float32), np.float32(0)) for k in kinds}
    return model


def _places(model: dict[str, np.ndarray], group: str, keys: np.ndarray) -> np.ndarray:
    """Where a model has the counts of keys; unknown ones have the last place, which holds 0. Cells are places."""
    known = model.get(f"{group}_keys")
    if known is None:
        return keys
    first = model[f"{group}_first"]  # the first place of keys with the same leading bits; keys are spread evenly
    at = first[keys >> (64 - len(first).bit_length())].astype(np.int64)
    found = known[at]
    behind = np.flatnonzero(found < keys)
    while len(behind):
        at[behind] += 1
        found[behind] = known[at[behind]]
        behind = behind[found[behind] < keys[behind]]
    at[found != keys] = len(known) - 1
    return at


def word_ratios(model: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of each word."""
    g = _Grams(words, "gram_keys" in model)
    p = np.full(len(g.pos), 1 / 256)
    inner = g.pos >= 1

    def step(n, total, followers, lower):
        kept = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * followers * lower) / np.maximum(total, 1)
        return np.where(total > 0, kept, lower)

    for m in range(1, ORDER):
        suffix, context = _places(model, "suffix", g.gram[m - 1]), _places(model, "suffix_context", g.context[m - 1])
        p = np.where(inner & (g.pos + 1 >= m), step(model["s"][suffix], model["st"][context], model["sf"][context], p), p)
    order = np.minimum(g.pos + 1, ORDER) - 1
    gram, context = _places(model, "gram", np.choose(order, g.gram)), _places(model, "context", np.choose(order, g.context))
    logs = [np.log(np.maximum(step(model[f"c{k}"][gram], model[f"t{k}"][context], model[f"f{k}"][context], p), 1e-12)) for k in "01"]
    return np.bincount(g.word, np.where(inner, logs[1] - logs[0], 0.0), len(words))


class Scorer:
    """Texts -> SIGNALS of the log-likelihood ratio per word; 0 for texts without words."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model, self.known = model, {}

    def __call__(self, texts) -> np.ndarray:
        split = [tokenize(t) for t in texts]
        new = list({w for ws in split for w in ws} - self.known.keys())
        if len(self.known) + len(new) > _DISTINCT:
            self.known = {}
            new = list({w for ws in split for w in ws})
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            self.known.update(zip(part, word_ratios(self.model, part).tolist(), strict=True))
        out = np.zeros((len(split), len(SIGNALS)))
        for i, ws in enumerate(split):
            if ws:
                total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.known.__getitem__, ws), np.float64, len(ws)))])
                k = min(WINDOW, len(ws))
                once = dict.fromkeys(ws)
                above = np.fromiter(map(self.known.__getitem__, once), np.float64, len(once)) - CLEAR
                out[i] = (total[k:] - total[:-k]).max() / WINDOW, total[-1] / len(ws), np.maximum(above, 0).sum() / np.sqrt(len(once))
        return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method on standardised columns; returns (weights..., intercept) for raw columns."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / spread
    return np.append(raw, w[-1] - raw @ mean)


def _features(held):
    @F.pandas_udf(", ".join(f"{s} double" for s in SIGNALS))
    @lean
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = Scorer(held.value)
        for s in parts:
            cut = [score(s.iloc[i : i + _ROWS]) for i in range(0, len(s), _ROWS)]
            yield pd.DataFrame(np.concatenate(cut) if cut else np.zeros((0, len(SIGNALS))), columns=SIGNALS)

    return run


def fit_scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS):
    """A function from a column of texts to a column of scores, learned as `toxicity` says."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.filter(remainder("doc_id") != 2)
    share = max_rows / max(1, known.count())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labelled = texts.join(F.broadcast(known) if share >= 1 else known, "doc_id").withColumn("part", remainder("doc_id"))

    held = spark.sparkContext.broadcast(fit_counts(labelled.filter("part <> 3").select("text", "toxic")))
    features = _features(held)
    shown = labelled.filter("part = 3")
    if share < 1:
        shown = shown.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(share * 950_000))
    seen = shown.select(features("text").alias("x"), "toxic").select("x.*", "toxic").toPandas()  # max_rows / 3 rows of numbers
    y = seen["toxic"].to_numpy(np.float64)
    if len(y) and 0 < y.sum() < len(y):
        *weights, base = fit_curve(seen[SIGNALS].to_numpy(), y).tolist()
    else:
        rate = float(y.mean()) if len(y) else 0.0
        weights, base = [0.0] * len(SIGNALS), float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))

    def score(text: Column) -> Column:
        x = features(text)
        return 1 / (1 + F.exp(-sum((x[s] * F.lit(w) for s, w in zip(SIGNALS, weights, strict=True)), F.lit(base))))

    return score


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    Labels are learned only from rows whose crc32(id as text) mod 4 isn't 2: the models from remainders 0 and 1, the
    curve from remainder 3. The models learn from all those rows, and their tables grow with the distinct n-grams; for the
    curve at most about ``max_rows`` labelled rows are sampled by a hash of the id. Labels are broadcast up to that number,
    beyond it the join shuffles; texts are used whole. A label that is null is ignored; of
    several for an id, the largest holds. The score of a text without words (null, empty) is the curve at signals of 0.
    Without labelled rows of both classes every score is the share of toxic labels. A null id hashes as empty text
    and has no label. Other columns are not read; an empty table gives no rows.
    """
    score = fit_scorer(docs, labels, id_col, text_col, label_col, max_rows)
    scored = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col) == 2).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is under ``threshold``; a map once the models are fitted."""
    return docs.filter(fit_scorer(docs, labels, id_col, text_col)(F.col(text_col)) < threshold)
