"""The registered queries of this subpackage, with the parameters that production runs use, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.session import ship

from .common import text_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    return pseudonymize(_read(spark, sf_dir, "documents"), key="corpus-key-1")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"), width=3, threshold=(9, 10))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .language_id import identify

    return identify(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(_read(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from .license_scan import PHRASES, SPREAD, TEMPLATES

    templates = ", ".join(f"('{label}', {sorted(set(text.lower().split()))!r}, {len(text.split())})" for label, text in TEMPLATES)
    phrases = " ".join("WHEN " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p, 1)) + f" THEN '{label}'" for p, label in PHRASES.items())
    sql = r"""
        WITH d AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
        s AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w WHERE contains(text, 'license')),
        p AS (SELECT doc_id, i, CASE {phrases} END AS label FROM s),
        b AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi FROM p WHERE label IS NOT NULL GROUP BY doc_id),
        t(label, toks, n) AS (VALUES {templates}),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        k AS (SELECT doc_id, regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM l),
        f AS (SELECT doc_id, w, label, toks, n FROM w, t WHERE 5 * len(list_intersect(w, toks)) >= 4 * len(toks)),
        r AS (SELECT doc_id, label, len(toks) AS size,
                     list_max(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(toks, w[i])), lambda i: len(list_intersect(list_slice(w, i, i + n - 1), toks)))) AS shared FROM f),
        m AS (SELECT doc_id, label, len(list_intersect(ws, toks)) / len(toks)::DOUBLE AS share
              FROM k, t WHERE len(ws) <= {spread} * n AND 5 * len(list_intersect(ws, toks)) >= 4 * len(toks)
              UNION ALL SELECT doc_id, label, shared / size::DOUBLE FROM r WHERE 5 * shared >= 4 * size),
        g AS (SELECT doc_id, label, 0.0::DOUBLE AS share, true AS base FROM p WHERE label IS NOT NULL
              UNION ALL SELECT doc_id, label, share, false FROM m),
        a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, max(share) AS share FROM g GROUP BY doc_id)
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
               coalesce(a.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
               CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(a.share, 0.0) END::DOUBLE AS score
        FROM w LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""
    return sql.replace("{phrases}", phrases).replace("{templates}", templates).replace("{spread}", str(SPREAD))


def op9_segment_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from .segment_sampling import sample_segmentations

    rows = sample_segmentations(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2)
    return rows.withColumn("n_pieces", F.size("ids").cast("long")).withColumn("ids_hash", F.xxhash64("ids")).drop("ids")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents")).drop("copies")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened_components

    return whitened_components(_read(spark, sf_dir, "embeddings"), components=32)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import clusters_with_totals

    return clusters_with_totals(_read(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_table

    return shard_table(_read(spark, sf_dir, "documents"), shards=24)


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    parts = [f"""
        v AS MATERIALIZED (
          SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS cluster, x AS c FROM v QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
        a{i} AS MATERIALIZED (
          SELECT rid, vec_id, x, cluster, distance FROM (
            SELECT *, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS distance FROM v, c{i})
          QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            parts.append(f"""
        m{i} AS MATERIALIZED (
          SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
            SELECT cluster, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{i}, range(1, 65) r(i) GROUP BY cluster, i) GROUP BY cluster),
        c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c)::BIGINT[] AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return f"""WITH {",".join(parts)}
        SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)"""


QUERIES = {
    "op1_vector_dedup": op1_vector_dedup,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_segment_sampling": op9_segment_sampling,
    "op10_mix_sources": op10_mix_sources,
    "op11_whitening": op11_whitening,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL = {
    "op1_vector_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n
          FROM embeddings WHERE label IS NOT NULL),
        l AS (
          SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
          WHERE x.n > 0 AND y.n > 0 AND list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.98),
        r AS (SELECT a AS id, a AS reach FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a),
        c AS (SELECT id, min(reach) AS root FROM r GROUP BY id),
        d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.root, e.vec_id) AS component_id,
               coalesce(c.root, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN d ON d.a = e.vec_id LEFT JOIN c ON c.id = e.vec_id""",
    "op7_exact_dedup": """
        WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha AS text_sha256
        FROM h WINDOW w AS (PARTITION BY sha)""",
    "op8_license_scan": _license_sql(),
    "op10_mix_sources": r"""
        WITH r AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 ('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT AS u
          FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
        a AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS pos FROM s),
        w AS (SELECT *, (CASE pos % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 3.0 END)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM a),
        l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE
                         - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
              FROM w),
        f AS (SELECT *, (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, pos LIMIT 1) AS found FROM l),
        t AS (SELECT source, source_size, CASE WHEN found IS NULL THEN cap ELSE least(cap, w * found) END AS target FROM f),
        b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
        c AS (
          SELECT r.doc_id, r.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
                 sum(r.size) OVER (PARTITION BY r.source ORDER BY r.u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                 sum(r.size) OVER (PARTITION BY r.source, r.u) AS n
          FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target,
               (size * least(3, whole + CASE WHEN upto <= budget OR (upto - n <= budget AND n - (budget - (upto - n)) < budget - (upto - n))
                                             THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM c""",
    "op12_centroid_clusters": _clusters_sql(),
    "op13_sharding": """
        WITH RECURSIVE
        bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
                 UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
        tbl AS MATERIALIZED (SELECT list(c ORDER BY i) AS tb FROM bits WHERE k = 8),
        d AS MATERIALIZED (
          SELECT doc_id, md5(coalesce(doc_id::VARCHAR, '')) AS h, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
                 [4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
          FROM documents),
        r AS MATERIALIZED (
          SELECT doc_id, h, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tb[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM d, tbl),
        j AS (
          SELECT DISTINCT h, ('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT AS key, 0::BIGINT AS cur, 0::BIGINT AS nxt FROM r
          UNION ALL
          SELECT h, k, nxt, floor((nxt + 1) * (2147483648::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
          FROM (SELECT h, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k, nxt FROM j WHERE nxt < 24))
        SELECT doc_id, size, text_crc32, 'key' AS law, cur::INTEGER AS shard,
               row_number() OVER (PARTITION BY cur ORDER BY substr(r.h, 1, 16), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
               (CASE WHEN nxt = 24 THEN 24 ELSE cur END)::INTEGER AS grown_shard
        FROM r JOIN j ON r.h = j.h AND j.nxt >= 24""",
}
