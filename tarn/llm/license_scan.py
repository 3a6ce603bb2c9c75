"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

The templates' words, in order of their frequency over all documents, rarest first, are the tokens. A block (a line of at
most SPREAD times as many words as the template has, or as many neighbouring words as it has, across lines) meets a
template if it holds at least ``threshold`` of the template's set. Whoever does holds one of the template's first tokens (prefix filter), is long enough (length filter),
and still has enough tokens behind the first shared one (positional filter); only blocks that pass all three are
compared. Blocks across lines are those around a first token, from every start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import let

#: Label and text of each template. The first three labels are also those of the base phrases.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License Version 2 0"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY NC 4 0"),
    ("all-rights-reserved", "All rights reserved"),
]
#: Phrases whose places are counted, and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

SPREAD = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A character of a word before A-Z become lower case.
RAW_CHAR = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
#: What stands between words: splitting there costs a sixth of extracting the words one by one.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def _count_words(text: Column) -> Column:
    """Ends of words: characters of words with none behind them."""
    return F.regexp_count(text, F.lit(f"{RAW_CHAR}(?!{RAW_CHAR})"))


def _sets(templates) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(text.lower().split()))) for label, text in templates]


def token_order(docs: DataFrame, text_col: str, templates) -> list[str]:
    """The templates' words by the number of documents that hold them, rarest first; one row per word is collected."""
    vocabulary = sorted({w for _, ws in _sets(templates) for w in ws})
    held = F.array_intersect(_words(F.coalesce(F.col(text_col), F.lit(""))), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _labels(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5), templates=TEMPLATES) -> DataFrame:
    """One row per input row: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Blocks are lines of at most SPREAD times as many words as a template has (words that are scattered over a longer line say
    nothing) and, since license texts are wrapped, all runs of as many words as it has, whatever lines they stand in; a
    block meets a template if it holds at least ``threshold`` of its distinct words.
    n_base counts all places of the base phrases, also across lines; first_word and last_word are the smallest and
    largest of their starts, words from 0. labels are the base labels and those of templates met, distinct and sorted.
    score is 1 with a base phrase, else the largest share of a met template, else 0. Null and empty texts have 0
    words, null places, empty labels. Texts of any length, repeated rows, null ids and an empty table are handled row
    by row; other columns are not read.

    Two scans: one for the order of tokens (an aggregate with a row per template word), one that does the rest in place.
    The templates are a fixed list, so they are constants of the plan and nothing is shuffled.
    """
    num, den = threshold
    order = token_order(docs, text_col, templates)
    rank = {w: i for i, w in enumerate(order)}
    ranked = [(label, sorted(rank[w] for w in ws), math.ceil(len(ws) * num / den)) for label, ws in _sets(templates)]
    prefixes = sorted({r for _, rs, need in ranked for r in rs[: len(rs) - need + 1]})
    lengths = [len(text.split()) for _, text in templates]
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    edge = RAW_CHAR
    starters = "|".join(sorted({order[r] for r in prefixes} | {p[-1] for p in PHRASES}))
    may = F.col("text").rlike(f"(?i)(?<!{edge})(?:{starters})(?!{edge})")

    def share(block: Column) -> Column:
        """Of one block's ranks (sorted, with how many words it has): an array with the share of each template, null if not met."""

        def one(rs: list[int], need: int, length: int) -> Column:
            first = rs[: len(rs) - need + 1]
            r = block["ranks"]
            lead = F.element_at(F.filter(r, lambda x: x.isin(first)), 1)
            behind_block = F.size(r) - F.array_position(r, lead) + 1
            behind_template = F.size(F.filter(F.array(*map(F.lit, rs)), lambda x: x >= lead))
            shared = F.size(F.array_intersect(r, F.array(*map(F.lit, rs))))
            passes = (block["n"] >= need) & (block["words"] <= SPREAD * length) & F.arrays_overlap(r, F.array(*map(F.lit, first)))
            return F.when(passes & (F.least(behind_block, behind_template) >= need) & (shared >= need), shared / len(rs)).cast("double")

        return F.array(*[one(rs, need, n) for (_, rs, need), n in zip(ranked, lengths, strict=True)])

    def block(line: Column) -> Column:
        vocabulary = F.array(*map(F.lit, order))
        return let(
            F.struct(_words(line).alias("all"), F.array_distinct(_words(line)).alias("ws")),
            lambda x: F.struct(
                F.size(x["all"]).alias("words"),
                F.size(x["ws"]).alias("n"),
                F.array_sort(F.transform(F.array_intersect(x["ws"], vocabulary), lambda w: F.element_at(ranks, w))).alias("ranks"),
            ),
        )

    blocks = F.filter(F.transform(F.split("text", "\n"), block), lambda b: F.arrays_overlap(b["ranks"], F.array(*map(F.lit, prefixes))))

    def runs(ws: Column) -> Column:
        """Per place of a first token: an array with each template's best share in a run of its length around the place, null if not met."""
        held = [sorted(set(text.lower().split())) for _, text in templates]

        def one(at: Column, words: list[str], length: int, rs: list[int], need: int) -> Column:
            own = F.array(*map(F.lit, words))
            low = F.greatest(at["i"] - (length - 1), F.lit(0))
            shared = lambda start, n: F.size(F.array_intersect(F.slice(ws, start + 1, n), own))
            best = F.array_max(F.transform(F.sequence(low, at["i"]), lambda start: shared(start, F.lit(length))))
            near = at["w"].isin([order[r] for r in rs[: len(rs) - need + 1]]) & (shared(low, at["i"] - low + length) >= need)
            return F.when(near, let(best, lambda n: F.when(n >= need, n / len(rs)))).cast("double")

        places = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin([order[r] for r in prefixes]))
        return F.transform(places, lambda at: F.array(*[one(at, words, n, rs, need) for words, n, (_, rs, need) in zip(held, lengths, ranked, strict=True)]))

    met = F.when(may, F.concat(F.transform(blocks, share), let(_words(F.col("text")), runs)))

    def places(ws: Column) -> Column:
        at = lambda i, k: F.get(ws, i + k)

        def start(i: Column) -> Column:
            found = None
            for phrase, name in PHRASES.items():
                hit = at(i, 0) == F.lit(phrase[0])
                for k, w in enumerate(phrase[1:], 1):
                    hit = hit & (at(i, k) == F.lit(w))
                found = F.when(hit, name) if found is None else found.when(hit, name)
            return F.struct(i.cast("long").alias("i"), found.alias("label"))

        every = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(every, start), lambda p: p["label"].isNotNull())

    based = F.when(F.col("text").rlike("(?i)license"), let(_words(F.col("text")), places))
    rows = rows.select("doc_id", _count_words(F.col("text")).cast("long").alias("n_words"), based.alias("base"), met.alias("met"))

    base, met = F.col("base"), F.col("met")
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.transform(base, lambda p: p["label"]), none)
    of_template = F.flatten(F.transform(met, lambda m: F.filter(F.transform(m, lambda s, i: F.when(s.isNotNull(), F.get(F.array(*[F.lit(x) for x, _, _ in ranked]), i))), lambda x: x.isNotNull())))
    best = F.coalesce(F.array_max(F.transform(met, lambda m: F.array_max(m))), F.lit(0.0))
    n_base = F.coalesce(F.size(base), F.lit(0))
    n_base = F.when(base.isNull(), 0).otherwise(n_base).cast("long")
    return rows.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["i"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["i"])).alias("last_word"),
        _labels(base_labels).alias("base_labels"),
        _labels(F.concat(base_labels, F.coalesce(of_template, none))).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
