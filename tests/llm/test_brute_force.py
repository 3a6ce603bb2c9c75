"""Operators against plain Python on small tables."""

import calendar
import datetime
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from compare import same
from conftest import DOCS, prose

from tarn.llm import components, exact_dedup, jaccard, language_id, license_scan, mixing, pii, segment_sampling, toxicity, vector_dedup
from tarn.llm.queries import ORACLE_SQL, QUERIES
from tarn.llm.repeats import may_repeat, repeat_filter

PIECES = P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def _components(links, vertices):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


def _family(seed: int, copies: int, n: int, edits: int) -> list[str]:
    """A text and copies with a few words exchanged, so that pairs lie on both sides of the threshold."""
    r = random.Random(seed)
    base = prose(seed, n).split()
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = prose(r.randrange(10**9), 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard(spark, width, num, den):
    texts = [t for s in range(12) for t in _family(s, 25, random.Random(s).choice([3, 9, 12, 40, 150]), 6)]
    texts += [prose(0, 40) + " " + prose(100 + i, 12) for i in range(30)] + ["", "one", "one two", "ONE two"] + texts[:20]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = _components(links, range(len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, width=width, threshold=(num, den)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_size_levels_hold_all_links():
    for num, den in ((9, 10), (4, 5), (1, 2)):
        starts = jaccard.size_levels(num, den, 5000)
        level = np.searchsorted(starts, np.arange(5001), side="right") - 1
        for small in range(1, 2000):
            largest = small * den // num
            assert level[min(largest, 5000)] - level[small] <= 1


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 2000 + i) for i in range(100)] + [(7, 7)]
    found = {x.v: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == _components(links, {v for link in links for v in link})


def test_no_links(spark):
    assert components.components(spark.createDataFrame([(None, 1)], "a long, b long")).collect() == []


def test_vectors(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 32))
    x = np.concatenate([c + r.normal(size=(40, 32)) * s for c, s in zip(centres, np.linspace(0.01, 0.3, 12), strict=True)])
    labels = [int(i % 3) if i % 17 else None for i in range(len(x))]
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels, strict=True))]
    rows += [(1000, [0.0] * 32, 1), (1001, None, 1), (1002, [float("nan")] * 32, 1), (1003, [1.0] * 8, 1), (1004, [2.0] * 8, 1), (1005, [], 1), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.98
    links = [(a, b) for a, b in itertools.combinations(range(len(x)), 2) if labels[a] is not None and labels[a] == labels[b] and close[a, b]] + [(1003, 1004)]
    n = Counter(v for link in links for v in link)
    want = _components(links, {*range(len(x)), *range(1000, 1006)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == {i: (n[i], want[i], want[i] == i) for i in want}


def test_buckets_over_a_block(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    r = np.random.default_rng(4)
    x = np.ones(16) + r.normal(size=(150, 16)) * 0.02
    df = spark.createDataFrame([(i, v.tolist(), 1, "z") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, keys string")
    assert all(q.n_links == 149 and q.component_id == 0 for q in vector_dedup.near_vectors(df).collect())


def test_whole_runs():
    import pandas as pd

    from tarn.llm.common import whole_runs

    r = random.Random(3)
    keys = sorted(r.choices(range(12), k=300)) + [50] * 40
    batches = [pd.DataFrame({"k": keys[i : i + 7], "v": range(i, min(i + 7, len(keys)))}) for i in range(0, len(keys), 7)]
    for rows in (1, 10, 50, 1000):
        found = list(whole_runs(iter(batches), ["k"], rows))
        assert [v for f in found for v in f["v"]] == list(range(len(keys)))
        assert all(a["k"].iloc[-1] != b["k"].iloc[0] for a, b in itertools.pairwise(found)) and all(len(f) for f in found)


def test_miss_probability():
    assert vector_dedup.miss_probability(0.98, 16, 10, 3.2) < 1e-5


def test_filter_never_misses_a_repeat(spark):
    r = random.Random(1)
    keys = [r.randrange(2**60) for _ in range(3000)]
    keys += keys[:300]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    held = repeat_filter(df, len(keys))
    flagged = Counter(r.k for r in df.filter(may_repeat(df.k, held)).collect())
    assert all(flagged[k] == 2 for k in keys[:300]) and len(flagged) < 300 + 0.1 * 3000


def test_saturated_filter_changes_no_result(spark):
    docs = spark.createDataFrame([(i, f"t{i % 700}", "en", "s", 0) for i in range(1000)], DOCS)
    small, large = (exact_dedup.exact_groups(docs, max_filter_bytes=b).orderBy("doc_id").collect() for b in (1 << 10, 1 << 20))
    assert small == large and sum(r.kept for r in small) == 700


def test_round_trip_of_pseudonyms(spark):
    texts = ["+1 (274) 555-9629, 4495114827612972; 4495-1148-2761-2972", "bosbt.42@mail8.example.com 88.100.187.118 2000-02-29 1999/12/31 24.12.1999", "DE89370400440532013000 GB82 WEST 1234 5698 7654 32", "no 1234567890123456 999.1.1.1 2001-02-29", ""]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    hidden = pii.pseudonymize(df, "key")
    rows = hidden.orderBy("doc_id").collect()
    assert [r.n_card for r in rows] == [2, 0, 0, 0, 0] and [r.n_date for r in rows] == [0, 3, 0, 0, 0] and rows[2].n_iban == 2 and rows[3].text == texts[3]
    assert [len(r.text) for r in rows[:1]] == [len(texts[0])]
    one, other = rows[0].text.split(", ")[1].split("; ")
    assert one == other.replace("-", "") != "4495114827612972"
    back = pii.pseudonymize(hidden.select("doc_id", "text"), "key", undo=True).orderBy("doc_id").collect()
    assert [r.text for r in back] == texts
    assert pii.pseudonymize(df, "other").orderBy("doc_id").first().text != rows[0].text


def test_pseudonyms_are_a_permutation(spark):
    df = spark.createDataFrame([(i, f"10.0.{i // 256}.{i % 256}", "en", "s", 0) for i in range(2000)], DOCS)
    assert pii.pseudonymize(df, "k").select("text").distinct().count() == 2000


def test_dates_stay_dates(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 73_049, 37).select(F.col("id").alias("doc_id"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    out = pii.pseudonymize(df, "k")
    assert out.filter(F.to_date("text").isNull()).count() == 0 and out.select("text").distinct().count() == df.count()


def test_mix_meets_targets(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(1, 30), "en", r.choice(["a"] * 30 + ["b", "c", "d", None]), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).collect()
    size, target, taken = Counter(), {}, Counter()
    source = {x[0]: x[3] for x in rows}
    for x in out:
        s = source[x.doc_id]
        size[s], target[s] = x.source_size, x.target
        taken[s] += x.taken
        assert x.taken <= 3 * x.size
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    assert all(abs(taken[s] - target[s]) <= 30 for s in size) and all(target[s] <= 3 * size[s] + 1e-9 for s in size)
    again = {x.doc_id: x.taken for x in mixing.mix(df.repartition(7)).collect()}
    assert again == {x.doc_id: x.taken for x in out}
    half = {x.doc_id: x.taken for x in mixing.mix(df, share=0.5).collect()}
    assert all(half[i] <= again[i] for i in again)  # a smaller budget takes a subset
    repeated = Counter(x.doc_id for x in mixing.mixed_rows(df).collect())
    words = {x.doc_id: x.size for x in out}
    assert all(repeated[i] * words[i] == again[i] for i in again)


def _plain_forward(model, word):
    """Sum over all segmentations, written out."""

    def total(s):
        if not s:
            return np.ones(model.p.shape[1])
        out = np.zeros(model.p.shape[1])
        for k in range(1, len(s) + 1):
            i = model.pieces.get(s[:k])
            if i is not None:
                out = out + model.p[i] * total(s[k:])
            elif k == 1:
                out = out + model.unknown * total(s[k:])
        return out

    return np.log(total("▁" + word))


def test_forward_algorithm():
    pieces = language_id._pieces(PIECES)
    p = np.random.default_rng(1).random((3, 32_000)) * 1e-3
    model = language_id.Model(pieces, p)
    words = ["the", "über", "language", "漢字", "x"]
    for w in words:
        assert np.allclose(model.one(w), _plain_forward(model, w)) and np.allclose(model.many([w])[0], _plain_forward(model, w))
    assert np.allclose(model.one("ab" * 40) - model.one("ab" * 40), 0)


def test_languages_are_told_apart(spark):
    words = {"en": "the of and thing shall water house over", "de": "der und nicht wasser haus über sich eine", "fr": "le et pas eau maison sur une être"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(words[lang].split(), k=20)), lang, "s", 0) for i in range(300) for lang in [("en", "de", "fr")[i % 3]]]
    out = language_id.identify(spark.createDataFrame(rows, DOCS), PIECES).filter("held_out").collect()
    assert len(out) > 30 and all(x.lang_pred == rows[x.doc_id][2] for x in out)


def test_signals_by_hand():
    score = toxicity.Scorer({})
    score.known = {b"a": 4.0, b"b": -1.0, b"c": 3.0}
    assert score(["a b b b b a", "A c a", "", None]).tolist() == [[0.25, 4 / 6, 2 / 2**0.5], [11 / 4, 11 / 3, 3 / 2**0.5], [0, 0, 0], [0, 0, 0]]


def test_toxic_words_are_learned(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        text, bad = prose(i, r.randint(20, 120)).split(), i % 6 == 0
        for _ in range(2 if bad else 0):
            text.insert(r.randrange(len(text)), r.choice(["scumbag", "worthless", "idiotic"]))
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, DOCS)
    out = [x for x in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() if x.held_out]
    right = sum(x.predicted == labels[x.doc_id][2] for x in out)
    assert right >= 0.97 * len(out) and all(0 <= x.score <= 1 for x in out)


def kneser_ney(words, other):
    """word -> log P(word | other) - log P(word | words), by the formulas written out; both: Counter of words as bytes."""
    order, discount = toxicity.ORDER, toxicity.DISCOUNT
    classes, grams = (Counter(), Counter()), set()
    for counts, top in zip((words, other), classes, strict=True):
        for w, n in counts.items():
            s = b" " + w + b" "
            for i in range(1, len(s)):
                grams |= {s[i - m + 1 : i + 1] for m in range(1, min(order, i + 1) + 1)}
                top[s[max(0, i - order + 1) : i + 1]] += n
    continued = Counter(g[1:] for g in grams if len(g) > 1)  # in how many longer n-grams one continues
    total, kinds = Counter(), Counter()
    for g, n in continued.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1

    after = [defaultdict(list), defaultdict(list)]
    for top, by in zip(classes, after, strict=True):
        for g, n in top.items():
            by[g[:-1]].append(n)

    def smoothed(count, of, followers, lower):
        return (max(count - discount, 0) + discount * followers * lower) / of if of else lower

    def ratio(w):
        s, out = b" " + w + b" ", 0.0
        for i in range(1, len(s)):
            p = 1 / 256
            for m in range(1, min(order - 1, i + 1) + 1):
                g = s[i - m + 1 : i + 1]
                p = smoothed(continued[g], total[g[:-1]], kinds[g[:-1]], p)
            g = s[max(0, i - order + 1) : i + 1]
            logs = []
            for top, by in zip(classes, after, strict=True):
                mine = by[g[:-1]]
                logs.append(np.log(max(smoothed(top[g], sum(mine), len(mine), p), 1e-12)))
            out += logs[1] - logs[0]
        return out

    return ratio


def test_scores_of_sf(spark):
    """Held-out rows of the test tables: most toxic ones are caught, in every language, and few others."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows) and hit >= 0.85 * sum(r.predicted for r in rows)


def test_word_ratios_are_kneser_ney(spark):
    """The vectorised model against the formulas written out, by full counts and for hashed cells."""
    r = random.Random(6)
    words, other = Counter({b"good": 3, b"gold": 2}), Counter({b"bad": 2, b"good": 1})
    words.update(prose(1, 60).encode().split())
    other.update(prose(2, 30).encode().split())
    rows = [(w.decode(), k) for k, c in enumerate((words, other)) for w, n in c.items() for _ in range(n)]
    r.shuffle(rows)
    model = toxicity.fit_counts(spark.createDataFrame(rows, "text string, toxic int"))
    asked = [b"good", b"bad", b"gold", b"zzz", b"x", "é漢".encode(), *list(words)[:20], *list(other)[:20]]
    ratio = kneser_ney(words, other)
    assert np.allclose(toxicity.word_ratios(model, asked), [ratio(w) for w in asked], atol=1e-4)
    good, bad = ratio(b"gold"), ratio(b"bad")
    assert bad > 1 > 0 > good


def test_toxicity_counts_are_those_of_every_ngram(spark):
    """No two n-grams share a count, and no labelled row is left out, however small ``max_rows`` is."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(60_000)]  # over 200,000 distinct top n-grams
    rows = [(" ".join(words[i : i + 30]), int(i % 60 == 0)) for i in range(0, len(words), 30)]
    model = toxicity.fit_counts(spark.createDataFrame(rows, "text string, toxic int"))
    want = [Counter(), Counter()]
    for text, toxic in rows:
        for w in text.split():
            s = f" {w} "
            want[toxic].update(s[max(0, i - toxicity.ORDER + 1) : i + 1] for i in range(1, len(s)))
    every = want[0].keys() | want[1].keys()
    assert len(every) > 200_000
    assert sorted(zip(model["c0"][:-1].tolist(), model["c1"][:-1].tolist(), strict=True)) == sorted((want[0][g], want[1][g]) for g in every)
    assert model["s"][:-1].sum() == model["st"][:-1].sum()

    docs = spark.createDataFrame([(i, "fine words here" if i % 2 else f"fine rare{i} bad", "en", "s", 0) for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    fitted = []
    original = toxicity.fit_counts
    toxicity.fit_counts = lambda labelled: fitted.append(labelled.count()) or original(labelled)
    try:
        toxicity.toxicity(docs, labels, max_rows=40).count()
    finally:
        toxicity.fit_counts = original
    assert fitted == [sum(zlib.crc32(str(i).encode()) % 4 in (0, 1) for i in range(400))]


def _segmentations(v, s):
    if not s:
        return [((), 0.0)]
    return [((v.ids[s[:k]],) + rest, v.logp[v.ids[s[:k]]] + p) for k in range(1, len(s) + 1) if s[:k] in v.ids for rest, p in _segmentations(v, s[k:])]


def test_sampling_without_replacement():
    x = segment_sampling.Lattices(segment_sampling.Vocabulary(PIECES, 0.5))
    every = _segmentations(x.v, x.v.normal("the cats"))
    z = np.logaddexp.reduce([p for _, p in every])
    chance = {a: np.exp(p - z) for a, p in every}
    n = 6000
    keys = [int(h) for h in segment_sampling.mixed(np.arange(n, dtype=np.uint64) * np.uint64(7919))]
    found = segment_sampling.sample_batch(x, ["the cats"] * n, keys, 3)
    first = Counter(tuple(r[0][0].tolist()) for r in found)
    pairs = Counter((tuple(r[0][0].tolist()), tuple(r[1][0].tolist())) for r in found)
    likely = sorted(chance, key=chance.get)[-4:]
    for a in likely:
        assert abs(first[a] / n - chance[a]) < 5 * (chance[a] / n) ** 0.5
        for b in likely:
            if a != b:
                p = chance[a] * chance[b] / (1 - chance[a])
                assert abs(pairs[a, b] / n - p) < 5 * (p / n) ** 0.5 + 1e-3
    for r in found[:500]:
        assert len({tuple(q[0].tolist()) for q in r}) == 3
        assert all(abs(q[1] - np.log(chance[tuple(q[0].tolist())])) < 1e-6 for q in r)
        assert r[0][2] >= r[1][2] >= r[2][2]
    # Weighted by inclusion scores, samples estimate a total without bias.
    estimate = np.mean([sum(chance[tuple(q[0].tolist())] / np.exp(q[3]) for q in r) for r in found])
    assert abs(estimate - 1) < 0.05


def test_all_segmentations_of_a_short_text():
    x = segment_sampling.Lattices(segment_sampling.Vocabulary(PIECES, 0.5))
    every = _segmentations(x.v, x.v.normal("ab"))
    found = segment_sampling.sample_batch(x, ["ab"], [5], 50)[0]
    assert {tuple(r[0].tolist()) for r in found} == {a for a, _ in every}


def test_batches_do_not_matter():
    texts = [prose(i, 50) for i in range(6)]
    make = lambda: segment_sampling.Lattices(segment_sampling.Vocabulary(PIECES, 0.5))
    whole = segment_sampling.sample_batch(make(), texts, list(range(6)), 2)
    single = [segment_sampling.sample_batch(make(), [t], [i], 2)[0] for i, t in enumerate(texts)]
    assert [[r[0].tolist() for r in d] for d in whole] == [[r[0].tolist() for r in d] for d in single]


def test_library_encoding_round_trip(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = segment_sampling.encode(spark.createDataFrame([(1, "a  b\nc 漢"), (2, None)], "doc_id long, text string"), PIECES).orderBy("doc_id").collect()
    assert sp.decode(list(rows[0].ids)) == "a  b\nc 漢" and rows[1].ids == []


BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal'


def test_wrapped_licenses_are_met(spark):
    def wrapped(text, mark):
        return "x y\n" + "\n".join(mark + line for line in text.split("\n")) + "\nz"

    narrow = "some words before Redistribution and\n# use in source\n# and\n#\n# binary forms, with\n# or without modification,\n# are"
    far = "Redistribution and use in source and binary forms" + "\nother words" * 9 + "\nwith or without modification are permitted"
    texts = [wrapped(BSD, ""), wrapped(MIT, " * "), wrapped(BSD, "// "), narrow, far, "All rights\nreserved.", "All\nother rights\nreserved", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 4)) for r in license_scan.license_scan(rows).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("bsd", round(12 / 13, 4)), 4: ("", 0.0), 5: ("all-rights-reserved", 1.0), 6: ("", 0.0), 7: ("", 0.0)}


def test_scattered_words_are_no_license(spark):
    words = ["w"] * 7000
    words[5], words[3000], words[6990] = "all", "rights", "reserved"
    texts = [" ".join(words), "all w rights w w reserved", "all w rights w w w reserved", "w " * 500 + "All rights reserved" + " w" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in license_scan.license_scan(rows).orderBy("doc_id").collect()] == ["", "all-rights-reserved", "", "all-rights-reserved"]


def test_license_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    every = sorted({w for _, t in license_scan.TEMPLATES for w in t.lower().split()} - {"license"})  # no base phrases
    texts = []
    for _ in range(150):
        words = rng.choice([*every, *["other"] * 10], rng.integers(0, 40)).tolist()
        template = license_scan.TEMPLATES[rng.integers(len(license_scan.TEMPLATES))][1].lower().replace("license", "permit").split()
        words += [w if rng.random() < 0.9 else "other" for w in template] + rng.choice(every, rng.integers(0, 20)).tolist()
        texts.append("".join(w + ("\n" if rng.random() < 0.2 else " ") for w in words))

    def brute(text):
        met = {}
        for label, t in license_scan.TEMPLATES:
            own, n, ws = set(t.lower().split()), len(t.split()), text.split()
            blocks = [line.split() for line in text.split("\n") if len(line.split()) <= license_scan.SPREAD * n] + [ws[i : i + n] for i in range(len(ws))]
            share = max((len(own & set(b)) for b in blocks), default=0)
            if 5 * share >= 4 * len(own):
                met[label] = max(met.get(label, 0), share / len(own))
        return ",".join(sorted(met)), max(met.values(), default=0.0)

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(rows).collect()}
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert got == want and len({x for x, _ in want.values()}) > 4


def test_the_limits_of_pseudonyms_are_stated(spark):
    """What the docstring says stays in clear does so, and is said."""
    clear = ["1/5/1999", "020 7946 0958", "2001:db8::1"]
    assert all(x in pii.pseudonymize.__doc__ for x in clear)
    rows = spark.createDataFrame(list(enumerate(clear)), "doc_id long, text string")
    assert [r.text for r in pii.pseudonymize(rows, "k").orderBy("doc_id").collect()] == clear


def _feistel(kind, parts, key):
    """The network written out: free parts (value, range) -> new values."""
    free = [list(p) for p in parts if p[1] > 1]
    for k in range(pii.ROUNDS):
        others = ",".join(str(v) if (i + k) % 2 else str(n) for i, (v, n) in enumerate(free))
        digits = "".join(hashlib.sha256("|".join(map(str, [key, kind, k, len(free), j, others])).encode()).hexdigest() for j in range((len(free) - 1) // 16 + 1))
        free = [[v if (i + k) % 2 else (v + int(digits[4 * i : 4 * i + 4], 16)) % n, n] for i, (v, n) in enumerate(free)]
    new = iter(v for v, _ in free)
    return [next(new) if n > 1 else v for v, n in parts]


def _luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _plain_pseudonym(s, key):
    """(kind, value) of a match by plain Python; kinds are told apart by how they are written."""
    digits = "".join(c for c in s if c.isdigit())
    spell = lambda parts, base: "".join(chr(b + v) if n > 1 else c for c, v, (_, n), b in zip(s, _feistel(kind, parts, key), parts, base, strict=True))
    of = lambda c: (ord(c) - 48, 10, 48) if c.isdigit() else (ord(c) - 97, 26, 97) if "a" <= c <= "z" else (ord(c) - 65, 26, 65) if "A" <= c <= "Z" else (0, 1, 0)
    if "@" in s:
        kind, at = "email", s.index("@")
        cells = [of(c) if i < at else (0, 1, 0) for i, c in enumerate(s)]
        return kind, spell([x[:2] for x in cells], [x[2] for x in cells])
    if s[0].isalpha():
        plain = s.replace(" ", "")
        number = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        if number(plain[4:] + plain[:4]) != 1:
            return None, s
        kind = "iban"
        cells = [of(c) if i >= 4 else (0, 1, 0) for i, c in enumerate(s)]
        new = spell([x[:2] for x in cells], [x[2] for x in cells])
        bare = new.replace(" ", "")
        return kind, f"{s[:2]}{98 - number(bare[4:] + s[:2] + '00'):02d}{new[4:]}"
    if s.count(".") == 3:
        os = s.split(".")
        if any(int(o) > 255 for o in os):
            return None, s
        wide = [len(o) > 1 and o[0] == "0" for o in os]
        new = _feistel("ip", [(int(o), 10 ** (len(o) - 1) if z else 256) for o, z in zip(os, wide, strict=True)], key)
        return "ip", ".".join(str(v).zfill(len(o)) if z else str(v) for o, v, z in zip(os, new, wide, strict=True))
    if len(digits) == 8 and s[0] != "+":
        form = "%Y-%m-%d" if s[4] == "-" else "%Y/%m/%d" if s[4] == "/" else "%d.%m.%Y" if s[2] == "." else "%m/%d/%Y" if int(s[:2]) <= 12 else "%d/%m/%Y"
        try:
            day = datetime.datetime.strptime(s, form).date()
        except ValueError:
            return None, s
        if not 1900 <= day.year <= 2099:
            return None, s
        years = [y for y in range(1900, 2100) if calendar.isleap(y) == calendar.isleap(day.year)]
        days = [datetime.date(day.year, 1, 1) + datetime.timedelta(i) for i in range(365 + calendar.isleap(day.year))]
        days = [d for d in days if form != "%d/%m/%Y" or d.day > 12]
        y, d = _feistel("date", [(years.index(day.year), len(years)), (days.index(day), len(days))], key)
        return "date", days[d].replace(year=years[y]).strftime(form)
    if len(digits) == 9 and len(s) == 11 and s[3] == "-" and s[6] == "-":
        area, group, serial = map(int, s.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None, s
        areas = [x for x in range(1, 900) if x != 666]
        a, g, n = _feistel("ssn", [(areas.index(area), 898), (group - 1, 99), (serial - 1, 9999)], key)
        return "ssn", f"{areas[a]:03d}-{g + 1:02d}-{n + 1:04d}"
    if s[0] == "+" and s[1] != "1":
        kind = "phone"
        two = [20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98]
        country = 1 if digits[0] == "7" else 2 if int(digits[:2]) in two else 3
        cells, at = [], -1
        for c in s:
            at += c.isdigit()
            cells.append((0, 1, 0) if not c.isdigit() or at < country or at == country and c == "0" else (int(c) - 1, 9, 49) if at == country else of(c))
        return kind, spell([x[:2] for x in cells], [x[2] for x in cells])
    if len(digits) in (10, 11) and (len(digits) == 10 or s.startswith("+1")):
        kind, cells, at = "phone", [], -1
        for c in s:
            at += c.isdigit()
            left = len(digits) - at
            lead = left in (10, 7)
            cells.append((0, 1, 0) if not c.isdigit() or left > 10 else (int(c) - 2, 8, 50) if lead and c >= "2" else (int(c), 2, 48) if lead else of(c))
        return kind, spell([x[:2] for x in cells], [x[2] for x in cells])
    if not 13 <= len(digits) <= 19 or _luhn(digits):
        return None, s
    kind, cells, at = "card", [], 0
    for c in s:
        at += c.isdigit()
        cells.append(of(c) if c.isdigit() and at < len(digits) else (0, 1, 0))
    new = spell([x[:2] for x in cells], [x[2] for x in cells])
    return kind, new[:-1] + str(-_luhn("".join(c for c in new[:-1] if c.isdigit()) + "0") % 10)


def test_pseudonyms_equal_brute_force(spark):
    """Planted values between words: found, counted and replaced as plain Python does it."""
    r = random.Random(9)
    number = lambda n: "".join(r.choices("0123456789", k=n))

    def card(n):
        head = number(n - 1)
        plain = head + str(-_luhn(head + "0") % 10)
        return plain if r.random() < 0.5 else "-".join(plain[i : i + 4] for i in range(0, n, 4))

    def iban():
        body = "".join(r.choices("0123456789ABCXYZ", k=r.choice([16, 18, 20])))
        return f"DE{98 - int(''.join(str(int(c, 36)) for c in body + 'DE00')) % 97:02d}{body}"

    day = lambda: datetime.date(1900, 1, 1) + datetime.timedelta(r.randrange(73_000))
    make = [
        lambda: "".join(r.choices("abcXYZ019._", k=r.randint(1, 40))) + "@mail.example.com", iban, lambda: card(16), lambda: card(19), lambda: number(16),
        lambda: day().strftime(r.choice(["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"])), lambda: f"{r.randint(1, 40):02d}/{r.randint(1, 40):02d}/1999",
        lambda: ".".join(str(r.randint(0, 300)).zfill(r.choice([1, 1, 2, 3])) for _ in range(4)), lambda: f"{number(3)}-{number(2)}-{number(4)}",
        lambda: f"{r.choice(['', '+1 ', '+1-'])}({number(3)}) {number(3)}-{number(4)}", lambda: f"+1{number(10)}", lambda: f"+{r.choice(['44', '49', '7', '351', '86'])} {number(2)} {number(4)} {number(4)}", lambda: f"+4420{number(8)}",
    ]
    cases = [[make[r.randrange(len(make))]() for _ in range(6)] for _ in range(250)]
    texts = [" ; ".join(f"word {v} more" for v in vs) for vs in cases]
    hidden = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key")
    rows = hidden.orderBy("doc_id").collect()
    kinds = Counter()
    for vs, row in zip(cases, rows, strict=True):
        found = [_plain_pseudonym(v, "key") for v in vs]
        assert row.text == " ; ".join(f"word {v} more" for _, v in found)
        n = Counter(k for k, _ in found if k)
        assert all(row[f"n_{k}"] == n[k] for k in pii.KINDS)
        kinds += n
    assert len(kinds) == len(pii.KINDS) and min(kinds.values()) > 20
    back = pii.pseudonymize(hidden.select("doc_id", "text"), "key", undo=True).orderBy("doc_id").collect()
    assert [x.text for x in back] == texts


def _plain_run(run: str, key: str) -> tuple[int, str]:
    """(cards, text) of a run of digit groups in plain Python: windows of whole groups by how long they are."""
    groups, out, n, i = re.findall(r"\d+[ -]?", run), "", 0, 0
    shapes = [(4, 4, 4, 4, None), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4)]
    while i < len(groups):
        sizes = [len(g.rstrip(" -")) for g in groups[i:]]
        ways = [1] if 13 <= sizes[0] <= 19 else []
        ways += [len(s) for s in shapes if len(s) <= len(sizes) and all(a == b or (b is None and a <= 3 and len({g[-1] for g in groups[i : i + 4]}) == 1) for a, b in zip(sizes, s, strict=False))]
        for k in ways:
            window = "".join(groups[i : i + k])
            bare = window.rstrip(" -")
            if _luhn("".join(c for c in bare if c.isdigit())) == 0:
                out, n, i = out + _plain_pseudonym(bare, key)[1] + window[len(bare) :], n + 1, i + k
                break
        else:
            out, i = out + groups[i], i + 1
    kind, value = _plain_pseudonym(run, key) if n == 0 else (None, out)
    return (1, value) if kind == "card" else (n, out)


def test_cards_beside_other_numbers(spark):
    """Cards before an expiry date, after a number, two in a row, before a phone: none stays in clear, all else does."""
    solid, grouped, amex = "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"
    texts = {
        f"{solid} 12/2027": ([solid], " 12/2027"), f"id 12 {solid}": ([solid], "id 12 "), f"{grouped} 100 units": ([grouped], " 100 units"), f"{grouped} 1 000": ([grouped], " 1 000"),
        f"{solid} {grouped}": ([solid, grouped], " "), f"{solid} 5500005555555559 {amex}": ([solid, "5500005555555559", amex], " "), f"7 {amex} 8": ([amex], "7 "), f"1234 {grouped}": ([grouped], "1234 "),
        f"exp 12-27 {solid}": ([solid], "12-27 "), f"{solid} 5": ([solid], " 5"), f"1-2-3-{solid}-4": ([solid], "1-2-3-"),
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.pseudonymize(rows, "k").orderBy("doc_id").collect()
    for (text, (cards, stays)), row in zip(texts.items(), got, strict=True):
        assert row.n_card == len(cards), text
        assert not any(c in row.text for c in cards) and stays in row.text and len(row.text) == len(text), text
        assert _plain_run(re.search(r"\d[\d -]*\d", text).group(), "k")[1] in row.text if "exp" not in text and "/" not in text else True
    back = pii.pseudonymize(spark.createDataFrame([(r.doc_id, r.text) for r in got], "doc_id long, text string"), "k", undo=True)
    assert [r.text for r in back.orderBy("doc_id").collect()] == list(texts)
    # the same number has the same pseudonym wherever it stands
    assert all(_plain_pseudonym(solid, "k")[1] in r.text.replace("-", "") for r, t in zip(got, texts, strict=True) if solid in t)
    beside = pii.pseudonymize(spark.createDataFrame([(1, f"{solid} 555-123-4567 on 2001-02-28, 078-05-1120 {solid} 10.1.2.3")], "doc_id long, text string"), "k").first()
    assert (beside.n_card, beside.n_phone, beside.n_date, beside.n_ssn, beside.n_ip) == (2, 1, 1, 1, 1)


def test_runs_of_numbers_equal_brute_force(spark):
    r = random.Random(12)
    number = lambda n: "".join(r.choices("0123456789", k=n))

    def card():
        n = r.choice([13, 14, 15, 16, 16, 16, 19])
        head = number(n - 1)
        plain = head + str(-_luhn(head + "0") % 10)
        return r.choice([plain, "-".join(plain[i : i + 4] for i in range(0, n, 4)), f"{plain[:4]} {plain[4:10]} {plain[10:]}"])

    runs = [r.choice(" -").join(r.choice([card, card, lambda: number(r.choice([1, 2, 5, 6, 14, 16, 21]))])() for _ in range(r.randint(1, 4))) for _ in range(400)]
    runs = [x for x in runs if sum(c.isdigit() for c in x) >= 13 and not re.search(rf"(?:{pii.SSN}|{pii.PHONE}|{pii.DATE})", x)]
    rows = pii.pseudonymize(spark.createDataFrame([(i, f"a {x} b") for i, x in enumerate(runs)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [(x.n_card, x.text) for x in rows] == [(n, f"a {t} b") for n, t in (_plain_run(x, "k") for x in runs)] and sum(x.n_card for x in rows) > 300


def test_parts_of_long_values_move_on_their_own(spark):
    """No two letters of a long local part move by the same amount under every key."""
    from pyspark.sql import functions as F

    name = "abcdefghijklmnopqrstuvwx"
    rows = spark.createDataFrame([(0, f"{name}@x.example.com")], "doc_id long, text string")
    moved = [pii.pseudonymize(rows, f"k{i}").select(F.split("text", "@")[0].alias("t")).first().t for i in range(12)]
    for a, b in itertools.combinations(range(len(name)), 2):
        assert len({(ord(m[a]) - ord(m[b]) - a + b) % 26 for m in moved}) > 1


def test_octets_with_leading_zeros_come_back(spark):
    texts = ["010.001.002.003", "10.1.2.3", "0.00.000.255"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hidden = pii.pseudonymize(rows, "k")
    assert [[len(o) if len(o) > 1 and o[0] == "0" else 0 for o in r.text.split(".")] for r in hidden.orderBy("doc_id").collect()][0] == [3, 3, 3, 3]
    assert [r.text for r in pii.pseudonymize(hidden.select("doc_id", "text"), "k", undo=True).orderBy("doc_id").collect()] == texts


LARGE = [-(2**63), -(2**62), 2**62, 2**62 + 1, 2**63 - 2, 2**63 - 1]


def test_any_long_is_an_id(spark):
    """Sums and negations of ids would overflow."""
    links = [(LARGE[i], LARGE[i + 1]) for i in range(2, 5)] + [(LARGE[0], LARGE[1])]
    found = {x.v: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == _components(links, LARGE)
    base = prose(1, 200).split()
    texts = [" ".join(base[:i] + [f"w{i}"] + base[i + 1 :]) for i in range(0, 60, 10)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in zip(LARGE, texts, strict=True)], DOCS)
    assert {r.component_id for r in jaccard.jaccard_components(docs).collect()} == {LARGE[0]}
    assert {r.keep_id for r in exact_dedup.exact_groups(docs.withColumn("text", docs.lang)).collect()} == {LARGE[-1]}
    vectors = spark.createDataFrame([(d, [1.0, 0.001 * i], 1) for i, d in enumerate(LARGE)], "vec_id long, embedding array<double>, label int")
    assert {(r.component_id, r.n_links) for r in vector_dedup.near_vectors(vectors).collect()} == {(LARGE[0], 5)}
    assert mixing.mix(docs).count() == len(LARGE)


def test_vectors_repeated_shared_and_missing(spark):
    """Repeated rows link with each other, rows that share an id join their components, an empty table gives no rows."""
    kind = "vec_id long, embedding array<double>, label int"
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (4, [-1.0, 0.0], 1), (5, [1.0, 0.0], 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, kind)).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True)]
    assert vector_dedup.near_vectors(spark.createDataFrame([], kind)).collect() == []


def test_numerals_are_no_letters(spark):
    rows = [(i, t, "en" if i < 90 else None, "s", 0) for i, t in enumerate(["plain words here"] * 90 + ["½ ½", "²", "Ⅷ", "x²y", "", None])]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, DOCS), PIECES).collect()}
    assert [got[i] for i in (90, 91, 92, 94, 95)] == [("und", 0.0)] * 5 and got[93] == ("en", 1.0)
    assert language_id.words("x²y Ⅷz") == ["x", "y", "z"]


def test_blocks_of_languages_do_not_matter(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, " ".join(prose(1000 + k, 12).split()[j] for j in [r.randrange(12) for _ in range(9)]), f"l{k}", "s", 0) for i in range(240) for k in [i % 12]]
    docs = spark.createDataFrame(rows, DOCS)
    whole = {x.doc_id: (x.lang_pred, round(x.score, 9)) for x in language_id.identify(docs, PIECES).collect()}
    monkeypatch.setattr(language_id, "LANGUAGES", 5)
    assert whole == {x.doc_id: (x.lang_pred, round(x.score, 9)) for x in language_id.identify(docs, PIECES).collect()}
    assert sum(whole[x[0]][0] == x[2] for x in rows) > 0.9 * len(rows)


def test_unlikely_segmentations_are_given_too():
    """Of two segmentations the second is found even if its share is far below the precision of one minus it."""
    v = segment_sampling.Vocabulary(PIECES, 0.5)
    v.weights = v.weights.copy()
    whole = v.ids["▁the"]
    v.weights[whole] += 60.0
    x = segment_sampling.Lattices(v)
    every = len(_segmentations(v, "▁the"))
    for key in range(5):
        found = segment_sampling.sample_batch(x, ["the"], [key], every + 3)[0]
        assert len(found) == every == len({tuple(r[0].tolist()) for r in found}) and found[0][0].tolist() == [whole]


def test_kept_lattices_change_nothing():
    """Chunks made once, kept, beyond the short length and spelled by bytes: the same samples as by fresh lattices."""
    texts = [prose(i % 7, 30) + ("x" * 90 if i % 3 else "") + " ß漢😀\n\x00" for i in range(12)]
    held = segment_sampling.Lattices(segment_sampling.Vocabulary(PIECES, 0.5))
    for i, t in enumerate(texts):
        fresh = segment_sampling.Lattices(held.v)
        one, two = (segment_sampling.sample_batch(x, [t], [i], 3)[0] for x in (held, fresh))
        assert [(a[0].tolist(), round(a[1], 9), round(a[2], 9)) for a in one] == [(a[0].tolist(), round(a[1], 9), round(a[2], 9)) for a in two]
        pieces = np.array(held.v.text, object)
        assert all(segment_sampling.decode(held.v, pieces, a[0]) == held.v.normal(t) for a in one)
    assert held.at
