"""Every operator and pipeline stage on null, empty, long, repeated and clashing input, and on empty tables."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, jaccard, language_id, license_scan, mixing, pii, segment_sampling, token_counts, toxicity

PIECES = P.path("piece_bpe_32k.model")


def _labels(spark):
    return spark.createDataFrame([(1, 0, 0), (3, 0, 1), (7, 1, 1), (8, 1, 0), (9, 0, None), (None, 1, 1), (12, 0, 1), (12, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda s, d: pii.pseudonymize(d, "k"),
    "token_counts": lambda s, d: token_counts.token_counts(d, P.path("byte_bpe_50k.json"), P.PATTERN),
    "toxicity": lambda s, d: toxicity.toxicity(d, _labels(s)),
    "jaccard": lambda s, d: jaccard.jaccard_components(d),
    "language": lambda s, d: language_id.identify(d, PIECES),
    "exact": lambda s, d: exact_dedup.exact_groups(d),
    "license": lambda s, d: license_scan.license_scan(d),
    "mix": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, messy, name):
    rows = OPERATORS[name](spark, messy).collect()
    assert len(rows) == messy.count()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in messy.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []


def test_exact_keeps_one_of_each(spark, messy):
    rows = exact_dedup.exact_groups(messy).collect()
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    for group in by.values():
        assert all(r.group_size == len(group) for r in group)
        assert sum(r.kept for r in group) == 1
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert all(r.keep_id == (max(ids) if ids else None) for r in group)


def test_dropping_copies_keeps_columns(spark, messy):
    kept = exact_dedup.drop_copies(messy)
    assert kept.columns == messy.columns and kept.select("text").distinct().count() == messy.select(F.coalesce("text", F.lit(""))).distinct().count() == kept.count()


def test_token_counts_of_every_code_point(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}'s {c}1{c}a {c}\n" for c in map(chr, codes[i : i + 64])) for i in range(0, len(codes), 64)] + ["\u20cf's \u20cf't \u20cf1\u20cf", "\u0558", "x\ua7ce", "\U000323b0b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    want = {i: len(e.ids) for i, e in enumerate(tok.encode_batch(texts, add_special_tokens=False))}
    assert {i: (rows[i], want[i]) for i in want if rows[i] != want[i]} == {}


def test_token_counts_are_the_librarys(spark, messy):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in messy.filter("doc_id IS NOT NULL").collect()}
    for r in OPERATORS["token_counts"](spark, messy).filter("doc_id IS NOT NULL").collect():
        text = texts[r.doc_id] or ""
        assert r.n_tokens == len(tok.encode(text, add_special_tokens=False).ids) and r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 1024)


def test_language_of_texts_without_letters(spark, messy):
    rows = {r.doc_id: r.lang_pred for r in OPERATORS["language"](spark, messy).collect()}
    assert rows[4] == rows[5] == rows[6] == "und" and rows[7] != "und"


def test_jaccard_without_words(spark, messy):
    rows = {r.doc_id: r for r in OPERATORS["jaccard"](spark, messy).collect()}
    assert rows[5].n_shingles == 0 and rows[5].component_id == 5 and rows[6].component_id == 6 and rows[4].n_shingles == 0
    assert rows[1].component_id == rows[2].component_id == rows[3].component_id == 1 and rows[9].n_shingles == 1
    assert rows[None].component_id is None


def test_license_places(spark, messy):
    row = {r.doc_id: r for r in OPERATORS["license"](spark, messy).collect()}
    assert (row[11].n_base, row[11].first_word, row[11].last_word, row[11].base_labels) == (1, 0, 0, "mit")
    assert row[4].n_words == 0 and row[4].first_word is None and row[4].labels == "" and row[4].score == 0.0


def test_pii_of_messy_rows(spark, messy):
    row = {r.doc_id: r for r in OPERATORS["pii"](spark, messy).collect()}
    assert row[4].text is None and row[11].n_card == 1 and row[11].n_date == 0 and "4111 1111" not in row[11].text and "2020-02-30" in row[11].text


def test_samples(spark, messy, empty):
    rows = segment_sampling.sample_segmentations(messy, PIECES, k=3).collect()
    assert all(r.decodes for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(tuple(r.ids))
    assert by[5] == {()} and len(by[7]) == 3 and len(by[1]) == 3
    assert sorted(r.sample for r in rows if r.doc_id == 2) == [0, 0, 1, 1, 2, 2] and len(by[2]) == 3  # a repeated row repeats its samples
    assert segment_sampling.sample_segmentations(empty, PIECES).collect() == []


def test_pipeline_stages(spark, messy, empty, tmp_path):
    import corpus_pipeline

    _labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for start in (messy, empty):
        docs = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            path = f"{tmp_path}/{start is messy}-{i}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns, name
            docs = out
        assert (docs.count() > 0) == (start is messy)
