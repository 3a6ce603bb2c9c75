"""Token counts by a map-side two-tier lookup of pre-token lengths; no pre-token is ever shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

#: Lengths that a worker keeps of pre-tokens outside the broadcast table, before it starts anew.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are encoded each time, so that the cache's bytes are bounded too.
CACHE_CHARS = 64


def _load(path: str):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    special = [x["content"] for x in spec.get("added_tokens", [])]
    return Tokenizer.from_file(path), special, spec


def frequent_lengths(path: str) -> dict[str, int]:
    """Pre-token -> number of tokens, for each vocabulary entry that is a pre-token by itself.

    A byte-level BPE vocabulary is the list of its training corpus's most frequent strings, so this is the compact
    table of frequent pre-tokens, at most as long as the vocabulary whatever the input is. Lengths come from encoding.
    """
    tok, special, _ = _load(path)
    found = {}
    decoded = tok.decode_batch([[i] for i in range(tok.get_vocab_size())], skip_special_tokens=False)
    whole = [s for s in decoded if s and "�" not in s and s not in special]
    for s, parts in zip(whole, (tok.pre_tokenizer.pre_tokenize_str(s) for s in whole), strict=True):
        if len(parts) == 1:
            found[s] = len(tok.encode(s, add_special_tokens=False).ids)
    return found


_ODD: dict[tuple[str, str], str] = {}


def split_differently(spark: SparkSession, path: str, pattern: str) -> str:
    """A character class of the code points that ``pattern`` splits otherwise than the library does; empty if there are none.

    The pattern runs on the tables of Python's ``regex``, the library on its own, of another version of Unicode. Every code point is put
    beside a letter, a digit and a mark, and both splits are compared: thousands at once, and fewer and fewer where those differ. Tasks
    take blocks of code points; it is done once for a file and a pattern.
    """
    if (path, pattern) in _ODD:
        return _ODD[path, pattern]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        tok, _, _ = _load(path)
        ends = regex.compile(pattern).finditer

        def same(codes: list[int]) -> bool:
            text = "".join(f"a{c}1{c}.{c}\n" for c in map(chr, codes))
            return [m.end() for m in ends(text)] == [b for _, (_, b) in tok.pre_tokenizer.pre_tokenize_str(text)]

        def search(codes: list[int]) -> list[int]:
            if not codes or same(codes):
                return []
            if len(codes) == 1:
                return codes
            half = len(codes) // 2
            return search(codes[:half]) + search(codes[half:])

        for b in batches:
            found = [search([c for c in range(i * 1024, (i + 1) * 1024) if not 0xD800 <= c < 0xE000]) for i in b["id"].tolist()]
            yield pd.DataFrame({"code": pd.Series([c for cs in found for c in cs], dtype="int64")})

    blocks = 0x110000 // 1024
    odd = sorted(r.code for r in spark.range(0, blocks, 1, min(blocks, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "code long").collect())  # code points at most
    ranges: list[list[int]] = []
    for c in odd:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    _ODD[path, pattern] = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if ranges else ""
    return _ODD[path, pattern]


class _Lengths(dict):
    """Second tier: a worker's cache of lengths in front of the broadcast table and the encoder."""

    def __init__(self, tok, frequent: dict[str, int]):
        super().__init__()
        self.tok, self.frequent = tok, frequent

    def __missing__(self, s: str) -> int:
        n = self.frequent.get(s)
        if n is None:
            n = len(self.tok.encode(s, add_special_tokens=False).ids)
        if len(s) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[s] = n
        return n


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: (doc_id, n_bytes, n_tokens, over_limit) for a byte-level BPE file of the tokenizers library.

    ``pattern`` is the file's pre-token pattern; a text is split by it and token counts of its pre-tokens are added up,
    which is exact because merges never cross pre-tokens. A text that holds a special token's string is given whole to
    the library, which cuts that string out first; and so is one with a code point that the library's own tables class
    otherwise than the pattern's (`split_differently`, found once). Null and empty texts have no tokens; text of any length is counted
    whole, with memory for that text's pre-tokens. Repeated rows give repeated rows, an empty table none; other
    columns are not read. A map without any exchange: losing an executor costs its tasks only.
    """
    spark: SparkSession = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_lengths(tokenizer_path))
    odd = split_differently(spark, tokenizer_path, pattern)

    @F.pandas_udf("long")
    @lean
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        import regex

        tok, special, _ = _load(tokenizer_path)
        split = regex.compile(pattern).findall
        other = re.compile(odd).search if odd else lambda t: None
        least = chr(int(odd[3:11], 16)) if odd else chr(0x10FFFF)
        look = _Lengths(tok, frequent.value).__getitem__

        def whole(t: str) -> bool:
            return any(s in t for s in special) or (not t.isascii() and max(t) >= least and other(t) is not None)

        for texts in parts:
            yield pd.Series([len(tok.encode(t, add_special_tokens=False).ids) if whole(t) else sum(map(look, split(t))) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
