"""Packing ranked blocks into a token budget, and deduplicating evidence."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import CJK, LATIN_WORD, count

_TOKENS = [re.compile(p) for p in ("[一-鿿]", r"[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)?", r"[^\w\s]")]


def raw_tokens(text: str) -> int:
    """CJK characters, latin words and punctuation marks, also those inside words; counts of parts between blanks add up."""
    return sum(len(p.findall(text)) for p in _TOKENS)


def approx_tokens(text: str) -> int:
    """`raw_tokens`, at least 1."""
    return max(1, raw_tokens(text))


#: Characters that count as white space in any script, for a class of a pattern.
BLANKS = r"\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = rf"[^\p{{L}}\p{{N}}_{BLANKS}]"


def tokens_of(text: Column) -> Column:
    """`approx_tokens` as a column; null counts as an empty text."""
    return F.greatest(F.lit(1), count(text, CJK) + count(text, LATIN_WORD) + count(text, PUNCTUATION)).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def truncated(text: Column, tokens: Column, budget: Column) -> Column:
    """A text of ``tokens`` tokens cut in proportion to a token budget, then at four fifths of that length again and again until it fits.

    Blanks at the end of a cut go; a cut that only loses such blanks ends the search, whether it fits or not. There is a walk over lengths
    for the texts that are too long only; it has as many steps as four fifths take to come down from the text's length to 1.
    """

    def cut_at(limit: Column) -> Column:
        return F.regexp_replace(F.substring(text, F.lit(1), limit), rf"[{BLANKS}]+\z", "")

    def state(limit: Column, done: Column) -> Column:
        return F.struct(limit.cast("int").alias("limit"), cut_at(limit.cast("int")).alias("cut"), done.alias("done"))

    def step(s: Column, _: Column) -> Column:
        following = state(F.greatest(F.lit(1), F.floor(s["limit"] * 4 / 5)), F.lit(False))
        ended = lambda f: (s["cut"] == "") | (s["cut"] == f["cut"]) | (tokens_of(s["cut"]) <= budget)
        last = F.struct(s["limit"].alias("limit"), s["cut"].alias("cut"), F.lit(True).alias("done"))
        return F.when(s["done"], s).otherwise(_let(following, lambda f: F.when(ended(f), last).otherwise(f)))

    first = state(F.greatest(F.lit(1), F.floor(F.length(text) * budget / tokens)), F.lit(False))
    steps = F.sequence(F.lit(1), F.ceil(F.log(F.length(text) + F.lit(1)) / F.lit(math.log(1.25))).cast("int") + 8)
    walked = F.aggregate(steps, first, step)["cut"]
    return F.when(budget <= 0, "").when(tokens <= budget, text).otherwise(walked)


def pack(blocks: DataFrame, budget: int, max_blocks: int, truncate: bool = True) -> DataFrame:
    """Greedy packing of each query's blocks (query_id, block_id, rank, text) in rank order: (query_id, block_id, rank, tokens, included,
    drop_reason, text).

    With ``truncate`` a block that is too long is cut to what is left; without, it is skipped and a smaller one
    behind it may still enter. Blocks that are left out carry the reason max_blocks or token_budget. Tokens are counted before blocks
    are gathered. The walk depends on its order, so a query's blocks are one array, which a fold passes once; ranks above bound its
    length, as lanes are cut to their top k before.
    """
    kind = dict(blocks.dtypes)["block_id"]
    entry = f"struct<block_id:{kind},rank:bigint,tokens:bigint,included:boolean,drop_reason:string,text:string>"
    rows = blocks.select("query_id", F.struct(F.col("rank").cast("long").alias("rank"), "block_id", tokens_of(F.col("text")).alias("tokens"), "text").alias("b"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{entry}>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        full, fits = s["used"] >= max_blocks, b["tokens"] <= s["left"]
        cut = truncated(F.coalesce(b["text"], F.lit("")), b["tokens"], s["left"]) if truncate else F.lit("")

        def after(kept: Column) -> Column:
            reason = F.when(full, "max_blocks").when(~fits & (kept == ""), "token_budget")
            tokens = F.when(reason.isNotNull(), 0).when(fits, b["tokens"]).otherwise(tokens_of(kept)).cast("long")
            text = F.when(reason.isNotNull(), F.lit(None)).when(fits, b["text"]).otherwise(kept)
            made = F.struct(b["block_id"].alias("block_id"), b["rank"].alias("rank"), tokens.alias("tokens"), reason.isNull().alias("included"), reason.alias("drop_reason"), text.alias("text"))
            return F.struct((s["left"] - tokens).alias("left"), (s["used"] + reason.isNull().cast("long")).alias("used"), F.concat(s["out"], F.array(made.cast(entry))).alias("out"))

        return _let(F.when(full | fits, F.lit("")).otherwise(cut), after)

    folded = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("bs")).select("query_id", F.aggregate("bs", start, step)["out"].alias("out"))
    return folded.select("query_id", F.inline("out"))


def fit_prefix(blocks: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """The blocks of each group that fit whole or in part, by a running sum of tokens before them; the last is cut."""
    before = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    rows = rows.filter(F.col("before") < budget)
    return rows.withColumn("kept_tokens", F.least(F.col("tokens"), budget - F.col("before")))


def dedupe_evidence(rows: DataFrame) -> DataFrame:
    """One row per query and chunk: best rank, its text, and all sources."""
    return rows.groupBy("query_id", "chunk_id").agg(
        F.min("rank").alias("rank"), F.min_by("text", F.struct("rank", "text")).alias("text"), F.array_sort(F.collect_set("source")).alias("sources")
    )


def source_type(types: Column) -> Column:
    """Of a block's source types: the only one, text_chunk without any, else mixed."""
    distinct = F.array_distinct(F.filter(types, lambda t: t.isNotNull()))
    return F.when(F.size(distinct) == 0, "text_chunk").when(F.size(distinct) == 1, F.element_at(distinct, 1)).otherwise("mixed")


def stitch_pages(pages: DataFrame, by: str, page: str, text: str) -> DataFrame:
    """Each page with the texts of the pages before and after it."""
    order = Window.partitionBy(by).orderBy(page)
    return pages.withColumn("stitched", F.concat_ws("\n", F.lag(text).over(order), F.col(text), F.lead(text).over(order)))


