"""Language identification by unigram piece models whose word probabilities sum over all segmentations.

The pieces are a fixed public vocabulary. Per language, piece probabilities come from the pieces of all training words;
a word's probability is the forward algorithm's sum over every way to cut it into pieces. Words are independent, so a
text's score needs each distinct word once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, remainder

_WORDS = re.compile(r"[^\W\d_]+")
SPACE = "▁"
#: A character that is no piece has this probability in every language.
UNKNOWN = 1e-8
#: Keeps forward sums of long words inside a double's range; it cancels between languages.
SCALE = 3.0
BACKGROUND = 50.0  # pseudo-counts of the mean of all languages in each language's model
#: Languages of one broadcast model; more are compared block by block.
LANGUAGES = 64
_KEPT = 200_000  # words a worker keeps
_AT_ONCE = 8_000  # words of one length that are scored at once
_PADDED = 40  # longer words are summed one by one


def words(text: str | None) -> list[str]:
    """Runs of letters of any script, lower-cased. Numerals such as ½, ² and Ⅷ are no letters."""
    found = _WORDS.findall((text or "").lower())
    if found and not "".join(found).isalpha():  # the pattern also takes numerals that are no digits
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


def _pieces(path: str) -> dict[str, int]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not skip(i)}


class Model:
    """Forward sums for many words at once. ``probability``: languages x pieces."""

    def __init__(self, pieces: dict[str, int], probability: np.ndarray):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        self.p = np.ascontiguousarray(probability.T)
        for s, i in pieces.items():
            self.p[i] *= np.exp(SCALE * len(s))
        self.unknown = UNKNOWN * np.exp(SCALE)
        self.clear()

    def clear(self) -> None:
        """Scores of words: where a word's row is, and the rows."""
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.p.shape[1]))

    def one(self, word: str) -> np.ndarray:
        """log of the sum over all segmentations, per language, less the scale that all share."""
        s = SPACE + word
        alpha = np.zeros((len(s) + 1, self.p.shape[1]))
        shift, alpha[0] = 0.0, 1.0
        for end in range(1, len(s) + 1):
            total = np.zeros(self.p.shape[1])
            for start in range(max(0, end - self.longest), end):
                i = self.pieces.get(s[start:end])
                if i is not None:
                    total += alpha[start] * self.p[i]
                elif end - start == 1:
                    total += alpha[start] * self.unknown
            alpha[end] = total
            top = total.max()
            if top < 1e-100 or top > 1e100:  # rescale all that later positions can reach
                alpha[max(0, end - self.longest) : end + 1] /= top
                shift += np.log(top)
        return np.log(np.maximum(alpha[len(s)], 1e-300)) + shift

    def many(self, words: list[str]) -> np.ndarray:
        """The same for words of equal length, position by position."""
        n, size = len(words), len(words[0]) + 1
        alpha = np.zeros((size + 1, n, self.p.shape[1]))
        alpha[0] = 1.0
        spaced = [SPACE + w for w in words]
        get = self.pieces.get
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                ids = np.fromiter([get(s[start:end], -1) for s in spaced], np.int64, n)
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    alpha[end][hit] += alpha[start][hit] * self.p[ids[hit]]
                if end - start == 1 and len(hit) < n:
                    miss = np.flatnonzero(ids < 0)
                    alpha[end][miss] += alpha[start][miss] * self.unknown
        return np.log(np.maximum(alpha[size], 1e-300))

    def learn(self, words) -> None:
        """Scores of new words into the cache."""
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > _KEPT:
            self.clear()
            new = list(words)
        have, need = len(self.at), len(self.at) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows[:have], np.zeros((max(have // 2, len(new)), self.rows.shape[1]))])
        by: dict[int, list[str]] = {}
        for w in new:
            by.setdefault(len(w), []).append(w)
        for size, ws in by.items():
            for i in range(0, len(ws), _AT_ONCE):
                part = ws[i : i + _AT_ONCE]
                have = len(self.at)
                self.rows[have : have + len(part)] = [self.one(w) for w in part] if size > _PADDED else self.many(part)
                self.at.update(zip(part, range(have, have + len(part)), strict=True))

    def score(self, counts: Counter) -> np.ndarray:
        """The log-likelihood of learned words, so often each, per language."""
        at = np.fromiter(map(self.at.__getitem__, counts), np.int64, len(counts))
        return np.fromiter(counts.values(), np.float64, len(counts)) @ self.rows[at]


def _count(path: str):
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        skip = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)])
        totals: dict[str, np.ndarray] = {}
        held: dict[str, Counter] = {}

        def flush() -> None:
            for lang, counts in held.items():
                names = list(counts)
                ids = sp.encode(names, num_threads=1)
                weight = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), [len(x) for x in ids])
                flat = np.fromiter((i for x in ids for i in x), np.int64, len(weight))
                totals[lang] = totals.get(lang, np.zeros(size)) + np.bincount(flat, weight, size)
            held.clear()

        def sent() -> Iterator[pd.DataFrame]:
            for lang, t in totals.items():
                at = np.flatnonzero((t > 0) & ~skip)
                yield pd.DataFrame({"lang": lang, "piece": at, "n": t[at]})
            totals.clear()

        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                held.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, held.values())) > _KEPT or len(held) > LANGUAGES:
                flush()
            if len(totals) > LANGUAGES:
                yield from sent()
        flush()
        yield from sent()

    return run


def fit_blocks(docs: DataFrame, model_path: str) -> Iterator[tuple[list[str], np.ndarray]]:
    """For each block of at most LANGUAGES languages, in order: (languages, probabilities: languages x pieces).

    Learned from rows (text, lang). Counts are a written table; what is collected at once is a name per language, a mean
    per piece, and the counts of one block.
    """
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    counts = docs.filter(F.col("lang").isNotNull()).mapInPandas(_count(model_path), "lang string, piece int, n double")
    counts = materialize(counts.groupBy("lang", "piece").agg(F.sum("n").alias("n")), "pieces")
    totals = materialize(counts.groupBy("lang").agg(F.sum("n").alias("total")), "language-totals")
    langs = sorted(r.lang for r in totals.select("lang").collect())
    share = counts.join(totals, "lang").groupBy("piece").agg(F.sum(F.col("n") / F.col("total")).alias("s")).toPandas()
    mean = np.zeros(size)
    mean[share["piece"].to_numpy(np.int64)] = share["s"].to_numpy(np.float64) / max(1, len(langs))
    mean = (mean + 1e-3 / size) / (mean.sum() + 1e-3)
    for i in range(0, len(langs), LANGUAGES):
        block = langs[i : i + LANGUAGES]
        rows = counts.filter(F.col("lang").isin(block)).toPandas()
        n = np.zeros((len(block), size))
        at = {x: k for k, x in enumerate(block)}
        n[[at[x] for x in rows["lang"]], rows["piece"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
        yield block, (n + BACKGROUND * mean) / (n.sum(axis=1, keepdims=True) + BACKGROUND)


def _scores(held, model_path: str):
    """For a block of languages: whether a text has a letter, its likeliest language there, that log-likelihood, and the logarithm of all of them summed."""

    @F.pandas_udf("letters boolean, lang string, best double, total double")
    @lean
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, probability = held.value
        model = Model(_pieces(model_path), probability)
        for texts in parts:
            found = []
            counts = [Counter(words(t)) for t in texts]
            for i in range(0, len(counts), 500):
                model.learn(set().union(*counts[i : i + 500]))
                for c in counts[i : i + 500]:
                    if not c:
                        found.append((False, None, None, None))
                        continue
                    total = model.score(c)
                    at = int(total.argmax())
                    found.append((True, langs[at], float(total[at]), float(total[at] + np.log(np.exp(np.minimum(total - total[at], 0)).sum()))))
            yield pd.DataFrame(found, columns=["letters", "lang", "best", "total"])

    return predict


def identify(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: (doc_id, held_out, lang_pred, score).

    Learned from text and non-null language of rows whose crc32(id as text) mod 4 isn't 2, all of them. The prediction
    is the language with the largest likelihood of all letters' words; score is its share of the likelihoods of all
    languages. A text that is null or has no letter (numerals such as ½, ² and Ⅷ are none) is ``und`` with score 0; if no
    language was learned, all are. Ties go to the first language in order. Texts are used whole, words of any length too.
    Null ids hash as empty text; other columns are not read; an empty table gives no rows.

    Languages are compared in blocks of at most LANGUAGES, so that a broadcast has at most LANGUAGES x pieces numbers,
    whatever values the column of languages holds.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out = rows.select("doc_id", "text", (remainder("doc_id") == 2).alias("held_out"))
    blocks = []
    for n, block in enumerate(fit_blocks(rows.filter(remainder("doc_id") != 2).select("text", "lang"), model_path)):
        blocks.append(f"_block_{n}")
        out = out.withColumn(blocks[-1], _scores(spark.sparkContext.broadcast(block), model_path)("text"))
    und = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")]
    if not blocks:
        return out.select("doc_id", "held_out", *und)
    tops = F.array(*[F.col(b) for b in blocks])
    best = F.array_max(F.transform(tops, lambda x: x["best"]))
    lang = F.element_at(F.filter(tops, lambda x: x["best"] == best), 1)["lang"]
    score = 1 / F.aggregate(tops, F.lit(0.0), lambda a, x: a + F.exp(x["total"] - best))
    letters = F.col(blocks[0])["letters"]
    return out.select("doc_id", "held_out", F.when(letters, lang).otherwise("und").alias("lang_pred"), F.when(letters, score).otherwise(0.0).alias("score"))
