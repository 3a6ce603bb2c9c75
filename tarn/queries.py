"""The registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import numbers as N
from tarn.functions import text as T
from tarn.operators import candidates, chunking, fusion, graph, lexical_index, measures, packing, profiling, retrieval, traces, vector_index, verification
from tarn.plans import guarded_sql, planning
from tarn.scratch import fresh_path, materialize
from tarn.session import bounded_batches, ship
from tarn.sources import datasets, files, index
from tarn.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.held = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    def register(fn):
        name = fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            bounded_batches(spark)
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return register


# Pieces of SQL that several queries share.
WS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
STOP = "['a','an','and','for','in','is','of','the','to','what']"
TS = f"list_filter(list_distinct({WS}), lambda x: NOT list_contains({STOP}, x))"
BM25_SQL = f"""
  q AS (SELECT item_id AS query_id, unnest({WS.format("text")}) AS term FROM benchmark),
  qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
  d AS (SELECT doc_id, {WS.format("text")} AS ws FROM documents),
  p AS (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM d),
  tf AS (SELECT doc_id, term, length, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  n AS (SELECT count(*)::DOUBLE AS n FROM documents),
  w AS (SELECT query_id, qt.term, qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) AS weight FROM qt JOIN df ON qt.term = df.term, n),
  bm AS (SELECT query_id, doc_id, round(sum(weight * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / 256.0)))), 6) AS score
         FROM tf JOIN w ON tf.term = w.term GROUP BY query_id, doc_id)"""
OVERLAP_SQL = f"""
  oq AS (SELECT item_id AS query_id, {TS.format("text")} AS ts FROM benchmark),
  ot AS (SELECT query_id, len(ts) AS size, unnest(ts) AS term FROM oq),
  od AS (SELECT doc_id, unnest({TS.format("text")}) AS term FROM documents),
  ov AS (SELECT query_id, doc_id, round(count(*) / size::DOUBLE, 6) AS score FROM od JOIN ot USING (term) GROUP BY query_id, doc_id, size)"""
LANE_K, RERANK_K, OUTPUT_K = 40, 30, 8
LANES_SQL = f"""{BM25_SQL},
  dq AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS a FROM benchmark JOIN embeddings ON vec_id = item_id),
  dv AS (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings JOIN documents ON doc_id = vec_id),
  dn AS (SELECT query_id, vec_id, round(list_cosine_similarity(a, b), 6) AS score FROM dq, dv),
  bl AS (SELECT query_id, doc_id AS chunk_id, 'bm25' AS lane, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= {LANE_K}),
  dl AS (SELECT query_id, vec_id AS chunk_id, 'dense' AS lane, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dn QUALIFY rank <= {LANE_K}),
  lanes AS (SELECT * FROM bl UNION ALL SELECT * FROM dl)"""
RRF_SQL = f"""{LANES_SQL},
  parts AS (SELECT *, CASE lane WHEN 'bm25' THEN 1.1 ELSE 1.0 END / (60 + rank) AS part FROM lanes),
  agg AS (SELECT query_id, chunk_id, round(sum(part), 9) AS score, count(*) AS contributions, max(round(part, 9)) AS bp,
                 min(CASE WHEN lane = 'dense' THEN rank END) AS dense_rank, min(CASE WHEN lane = 'bm25' THEN rank END) AS lexical_rank FROM parts GROUP BY ALL),
  best AS (SELECT p.query_id, p.chunk_id, min(p.rank) AS best_rank FROM parts p JOIN agg a ON p.query_id = a.query_id AND p.chunk_id = a.chunk_id AND round(p.part, 9) = a.bp GROUP BY ALL),
  fused AS (SELECT a.query_id, a.chunk_id, score, contributions, dense_rank, lexical_rank,
                   row_number() OVER (PARTITION BY a.query_id ORDER BY score DESC, best_rank, coalesce(dense_rank, 1000000000), coalesce(lexical_rank, 1000000000), a.chunk_id) AS rank
            FROM agg a JOIN best b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id QUALIFY rank <= {LANE_K})"""


def _asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _once(t: Tables, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A small result that several steps read, written when it is first asked for, so that its size is known."""
    if name not in t.held:
        t.held[name] = materialize(make(), name)
    return t.held[name]


def _lanes(t: Tables) -> DataFrame:
    """Hits of two lanes: BM25 over the texts, and cosine over the vectors of documents that have one. A question's vector is
    the one with its id, in place of an embedding model."""

    def make() -> DataFrame:
        asked = t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")
        vectors = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        bm = retrieval.bm25_top(_asked(t), t.documents, LANE_K).withColumn("lane", F.lit("bm25")).withColumnRenamed("doc_id", "chunk_id")
        dense = retrieval.dense_top(asked, vectors, LANE_K).withColumn("lane", F.lit("dense")).withColumnRenamed("vec_id", "chunk_id")
        return bm.unionByName(dense)

    return _once(t, "lanes", make)


def _fused(t: Tables) -> DataFrame:
    weight = F.when(F.col("lane") == "bm25", fusion.LANE_WEIGHTS["bm25"]).otherwise(fusion.LANE_WEIGHTS["dense"])
    return _once(t, "fused", lambda: fusion.weighted_rrf(_lanes(t).withColumn("lane_weight", weight), limit=LANE_K))


def _blocks(t: Tables) -> DataFrame:
    """The texts of each query's best fused hits."""
    texts = t.documents.select(F.col("doc_id").alias("block_id"), "text")
    return texts.join(_fused(t).filter(F.col("rank") <= OUTPUT_K).select("query_id", F.col("chunk_id").alias("block_id"), "rank"), "block_id")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 24")
def bm25_topk(t):
    return retrieval.bm25_top(_asked(t), t.documents, 24)


@query(f"WITH {OVERLAP_SQL} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ov QUALIFY rank <= 24")
def overlap_topk(t):
    return retrieval.overlap_top(_asked(t), t.documents, 24)


@query(f"WITH {RRF_SQL} SELECT * FROM fused WHERE rank <= {OUTPUT_K}")
def hybrid_rrf(t):
    """The flagship: a lexical and a dense lane over all documents, fused by weighted reciprocal ranks, the eight best per query."""
    return _fused(t).filter(F.col("rank") <= OUTPUT_K)


@query(f"""WITH {LANES_SQL}
SELECT query_id, chunk_id, string_agg(DISTINCT lane, ',' ORDER BY lane) AS sources, min(rank) AS best_rank, max(score) AS best_score,
       arg_min(lane, rank * 10 + CASE lane WHEN 'bm25' THEN 0 ELSE 1 END) AS first_lane FROM lanes GROUP BY ALL""")
def candidate_merge(t):
    return fusion.merge_candidates(_lanes(t))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0),
v AS (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings)
SELECT query_id, vec_id, round(list_cosine_similarity(a, b), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(a, b), 6) DESC, vec_id) AS rank
FROM q, v QUALIFY rank <= 10""")
def dense_topk(t):
    """Every vector whose id is divisible by 50 against all vectors."""
    asked = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_top(asked, t.embeddings, 10)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0),
v AS (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings)
SELECT query_id, vec_id, round(list_cosine_similarity(a, b), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(a, b), 6) DESC, vec_id) AS rank
FROM q, v QUALIFY rank <= 10""")
def dense_index_topk(t):
    """Every vector whose id is divisible by 50 against all vectors, through an inverted-file index that opens further cells until the
    result is certain: the rows of a whole scan."""
    index_of = vector_index.build(t.embeddings, fresh_path(t.spark, "vector-index"))
    return vector_index.search(index_of, _every_fiftieth(t), 10, exact=True)


@query()
def dense_index_recall(t):
    """(query_id, hits, recall): of the ten nearest of every vector whose id is divisible by 50, how many the index finds in the cells it
    opens first."""
    index_of = vector_index.build(t.embeddings, fresh_path(t.spark, "vector-index"))
    some = vector_index.search(index_of, _every_fiftieth(t), 10).select("query_id", "vec_id", F.lit(1).alias("found"))
    all_ = retrieval.dense_top(_every_fiftieth(t), t.embeddings, 10).select("query_id", "vec_id")
    rows = all_.join(some, ["query_id", "vec_id"], "left").groupBy("query_id")
    return rows.agg(F.count("found").alias("hits"), F.round(F.count("found") / F.count("*"), 6).alias("recall"))


def _every_fiftieth(t: Tables) -> DataFrame:
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 24")
def bm25_index_topk(t):
    """`bm25_topk` through a lexical index, which is built here and then searched without its texts."""
    return lexical_index.search(lexical_index.build(t.documents, fresh_path(t.spark, "lexical-index")), _asked(t), 24)


@query("""WITH q AS (SELECT vec_id AS query_id, label AS ql, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0),
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS b FROM embeddings),
r AS (SELECT query_id, ql, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(a, b), 6) DESC, vec_id) AS rank FROM q, v QUALIFY rank <= 10),
h AS (SELECT query_id, vec_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) / rank::DOUBLE AS p FROM r WHERE ql = label),
g AS (SELECT query_id, min(rank) AS first_rank, sum(p) AS total FROM h GROUP BY ALL),
e AS (SELECT query_id, count(*) AS expected FROM q JOIN v ON ql = label GROUP BY ALL)
SELECT q.query_id, first_rank, coalesce(first_rank <= 1, false) AS hit_1, coalesce(first_rank <= 3, false) AS hit_3, coalesce(first_rank <= 5, false) AS hit_5, coalesce(first_rank <= 10, false) AS hit_10,
       round(coalesce(1.0 / first_rank, 0), 6) AS reciprocal_rank, round(coalesce(total, 0) / greatest(1, coalesce(expected, 0)), 6) AS average_precision
FROM q LEFT JOIN g USING (query_id) LEFT JOIN e USING (query_id)""")
def hit_mrr_map(t):
    """For every vector whose id is divisible by 50, against all vectors; relevant items, those of its label, are counted, not listed."""
    asked = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    ranked = retrieval.dense_top(asked.select("query_id", "embedding"), t.embeddings, 10).withColumnRenamed("vec_id", "item")
    labels = t.embeddings.select(F.col("vec_id").alias("item"), "label")
    relevant = labels.join(ranked.select("query_id", "item").join(asked.select("query_id", "label"), "query_id"), ["item", "label"]).select("query_id", "item")
    expected = asked.select("query_id", "label").join(labels.groupBy("label").agg(F.count("*").alias("expected")), "label").select("query_id", "expected")
    return measures.retrieval_metrics(ranked, relevant, asked, expected)


@query(f"""WITH {RRF_SQL},
c AS (SELECT f.query_id, f.chunk_id, f.rank AS fusion_rank, lower(d.text) AS dt, d.lang, {TS.format("q.text")} AS a, {TS.format("d.text")} AS b
      FROM fused f JOIN benchmark q ON q.item_id = f.query_id JOIN documents d ON d.doc_id = f.chunk_id WHERE f.rank <= {RERANK_K}),
s AS (SELECT *, list_slice(list_sort(a), 1, 1) AS en, list_slice(list_sort(a), 2, 3) AS pe, list_slice(list_sort(a), 4, 4) AS me FROM c),
z AS (SELECT query_id, chunk_id, fusion_rank, round(0.25 * (CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0 END) + (len(list_filter(en, lambda x: contains(dt, x))) > 0)::INT
      + 0.55 * (CASE WHEN len(pe) > 0 THEN len(list_filter(pe, lambda x: contains(dt, x))) / len(pe)::DOUBLE ELSE 0 END) + 1.4 * (len(list_filter(me, lambda x: contains(dt, x))) > 0)::INT
      - (CASE WHEN lang = 'en' THEN 0.0 ELSE 0.1 END), 6) AS rerank_score FROM s)
SELECT query_id, chunk_id, fusion_rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fusion_rank, chunk_id) AS rank FROM z QUALIFY rank <= {OUTPUT_K}""")
def rerank_cascade(t):
    """40 fused hits, of which the first 30 are reranked and the best 8 are left. Words of the question stand for entity, periods and metric."""
    return _reranked(t)


def _reranked(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("dt"), "lang")
    rows = texts.join(_fused(t).filter(F.col("rank") <= RERANK_K).select("query_id", "chunk_id", "rank"), "chunk_id").join(_asked(t).withColumnRenamed("text", "qt"), "query_id")
    terms = F.array_sort(T.token_set(F.col("qt")))
    noise = F.when(F.col("lang") == "en", 0.0).otherwise(0.1)
    score = fusion.lexical_rerank_score(F.col("qt"), F.col("dt"), F.slice(terms, 1, 1), F.slice(terms, 2, 2), F.slice(terms, 4, 1), noise)
    return fusion.rerank(rows, score, RERANK_K).filter(F.col("rank") <= OUTPUT_K).select("query_id", "chunk_id", "fusion_rank", "rerank_score", "rank")


@query(f"""WITH {LANES_SQL},
c AS (SELECT query_id, chunk_id, rank AS lr, CASE WHEN chunk_id % 11 = 0 THEN 0 WHEN chunk_id % 7 = 0 THEN 2 ELSE 1 END AS band, CASE lane WHEN 'bm25' THEN 1.1 ELSE 1.0 END AS w FROM lanes),
g AS (SELECT query_id, chunk_id AS item, round(sum(w / (60 + lr)), 9) AS score, min(band) AS band, min(lr) AS first FROM c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, band ORDER BY score DESC, first, item) AS pos FROM g QUALIFY band <> 1 OR pos <= 8)
SELECT query_id, item, CASE band WHEN 0 THEN 'pinned' WHEN 1 THEN 'ranked' ELSE 'supporting' END AS policy, score, row_number() OVER (PARTITION BY query_id ORDER BY band, pos) AS rank FROM k""")
def cross_provider_fuse(t):
    policy = F.when(F.col("chunk_id") % 11 == 0, "pinned").when(F.col("chunk_id") % 7 == 0, "supporting").otherwise("ranked")
    rows = _lanes(t).select(
        "query_id", "chunk_id", F.lit(None).cast("long").alias("parent_id"), policy.alias("policy"), F.lit(1.0).alias("unit_weight"), F.when(F.col("lane") == "bm25", 1.1).otherwise(1.0).alias("lane_weight"), F.col("rank").alias("local_rank")
    )
    return fusion.fuse_providers(rows, 8)


@query("SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[一-鿿]')) + len(regexp_extract_all(text, '[A-Za-z0-9_]+(?:[-''][A-Za-z0-9_]+)?')) + len(regexp_extract_all(text, '[^\\p{L}\\p{N}_\\s]')))::BIGINT AS n_tokens, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_words FROM documents")
def text_token_count(t):
    return t.documents.select("doc_id", T.token_count(F.col("text")).alias("n_tokens"), T.word_count(F.col("text")).alias("n_words"))


@query("SELECT language, count(*) AS n FROM (SELECT CASE WHEN len(regexp_extract_all(text, '[一-鿿]')) >= len(regexp_extract_all(text, '[A-Za-z]+')) THEN 'zh' ELSE 'en' END AS language FROM documents) GROUP BY ALL")
def text_language_detect(t):
    return t.documents.groupBy(T.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, trim(regexp_replace(url, '\s+', ' ', 'g')) AS url,
trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name,
regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*[/\\]', ''), '\.[A-Za-z0-9]{1,5}$', '')), '[^a-z0-9]', '', 'g') AS key,
CASE WHEN length(trim(regexp_replace(html, '\s+', ' ', 'g'))) > 320 THEN rtrim(left(trim(regexp_replace(html, '\s+', ' ', 'g')), 317)) || '...' ELSE trim(regexp_replace(html, '\s+', ' ', 'g')) END AS preview
FROM pages""")
def text_normal_forms(t):
    u, h = F.col("url"), F.col("html")
    return t.pages.select("page_id", T.squash(u).alias("url"), T.column_name(u).alias("name"), T.document_key(u).alias("key"), T.preview(h).alias("preview"))


@query("""WITH d AS (SELECT doc_id, no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)),
e AS (SELECT doc_id, no, line, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM d)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS block, NULL::VARCHAR AS section, trim(string_agg(rtrim(line), chr(10) ORDER BY no)) AS text FROM e WHERE trim(line) <> '' GROUP BY doc_id, run""")
def text_blocks(t):
    return chunking.line_blocks(t.documents)


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# Head ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || '## Tail' || chr(10) || 'end' ELSE coalesce(text, '') END AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d),
h AS (SELECT *, nullif(regexp_extract(line, '^\s{0,3}#{1,6}\s+(.+?)\s*$', 1), '') AS title FROM l),
k AS (SELECT doc_id, bool_or(title IS NOT NULL) AS headed FROM h GROUP BY doc_id),
r AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM h JOIN k USING (doc_id) WHERE headed),
a AS (SELECT doc_id, run, max(title) AS section, string_agg(rtrim(line), chr(10) ORDER BY no) AS text FROM r GROUP BY doc_id, run),
p AS (SELECT doc_id, generate_subscripts(x, 1) AS run, NULL::VARCHAR AS section, unnest(x) AS text FROM (SELECT doc_id, regexp_split_to_array(trim(text, ' ' || chr(10) || chr(13) || chr(9)), '\n\s*\n+') AS x FROM d JOIN k USING (doc_id) WHERE NOT headed)),
b AS (SELECT doc_id, run, section, trim(text, ' ' || chr(10) || chr(13) || chr(9)) AS text FROM (SELECT * FROM a UNION ALL SELECT * FROM p))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS ordinal, section, text FROM b WHERE text <> ''""")
def document_boundaries(t):
    """Where documents may be cut: at headings, which every second one gets, else at blank lines."""
    given = F.concat(F.lit("# Head "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n## Tail\nend"))
    docs = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, given).otherwise(F.col("text")).alias("text"))
    return chunking.boundary_blocks(docs).select("doc_id", "ordinal", "section", "text")


@query()
def chunk_rows(t):
    return chunking.chunk_documents(t.documents, 120, 20)


@query()
def parent_child_chunks(t):
    return chunking.parent_child(t.documents, 120, 20, 480)


@query()
def html_to_text(t):
    return files.pages_text(t.pages, title_col="url")


_PROFILED = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _profile_sql(table: str, columns: tuple[str, ...]) -> str:
    parts = [
        f"""SELECT '{c}' AS column_name, {i} AS position, count(*) FILTER (v IS NULL) AS nulls, count(v) AS non_null,
        count(*) FILTER (regexp_full_match(replace(v, ',', ''), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) AS numeric,
        count(*) FILTER (regexp_full_match(replace(v, ',', ''), '[+-]?[0-9]+')) AS integers,
        count(*) FILTER (lower(v) IN ('true','t','yes','y','1','false','f','no','n','0')) AS booleans,
        count(*) FILTER (regexp_full_match(v, '[0-9]{{4}}') OR try_strptime(v, '%Y-%m-%d') IS NOT NULL) AS dates
        FROM (SELECT nullif(trim({c}::VARCHAR), '') AS v FROM {table})"""
        for i, c in enumerate(columns)
    ]
    return (
        "SELECT *, CASE WHEN non_null = 0 THEN 'empty' WHEN booleans = non_null THEN 'boolean' WHEN integers = non_null THEN 'integer' "
        "WHEN numeric = non_null THEN 'number' WHEN dates = non_null THEN 'date' ELSE 'string' END AS inferred_type FROM (" + " UNION ALL ".join(parts) + ")"
    )


@query(_profile_sql("orders", _PROFILED))
def column_profile(t):
    return profiling.column_profile(t.orders, list(_PROFILED))


@query(f"SELECT inferred_type, count(*) AS n FROM ({_profile_sql('orders', _PROFILED)}) GROUP BY ALL")
def type_histogram(t):
    return profiling.type_histogram(profiling.column_profile(t.orders, list(_PROFILED)))


@query(f"""WITH p AS ({_profile_sql('orders', _PROFILED)})
SELECT 'table' AS card, NULL AS column_name, 'table orders: ' || string_agg(column_name, ', ' ORDER BY position) AS text FROM p
UNION ALL SELECT 'column', column_name, 'column ' || column_name || ' of orders: ' || inferred_type FROM p
UNION ALL SELECT 'profile', NULL, 'types: ' || string_agg(x, ', ' ORDER BY x) FROM (SELECT inferred_type || '=' || count(*) AS x FROM p GROUP BY inferred_type)""")
def routing_cards(t):
    return profiling.routing_cards("orders", profiling.column_profile(t.orders, list(_PROFILED)))


_NAMES = (
    "Fiscal Year", "year", "FY", "Order Date", "date", "Company", "company name", "CUSIP", "isin code", "code", "Unit Price", "unit", "Currency", "Net Sales", "sales", "Revenue ($)",
    "margin", "liabilities", "cash", "Share Count", "USD amount", "Pct margin", "2023", "FY 2023", "Region", "", "%",
)


@query(f"""WITH x AS (SELECT p_partkey, ({list(_NAMES)!r})[p_partkey % {len(_NAMES)} + 1] || CASE WHEN p_size % 2 = 0 THEN '' ELSE '!' END AS name FROM part),
n AS (SELECT p_partkey, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS n FROM x)
SELECT p_partkey, n AS name, CASE WHEN regexp_matches(n, '\\b(year|fy|fiscal|period|quarter|date|month)\\b') THEN 'period' WHEN regexp_matches(n, '\\b(id|identifier|code|ticker|symbol|cusip|isin)\\b') THEN 'identifier'
WHEN regexp_matches(n, '\\b(company|segment|region|country|category|name)\\b') THEN 'dimension' WHEN regexp_matches(n, '\\b(unit|currency|scale)\\b') THEN 'unit'
WHEN regexp_matches(n, '\\b(amount|value|revenue|sales|income|expense|cash|asset|liabil|margin)\\b') THEN 'measure' ELSE 'unknown' END AS role,
CASE WHEN contains(n, 'usd') OR contains(n, 'dollar') THEN 'currency_usd' WHEN contains(n, 'percent') OR contains(n, 'pct') OR contains(n, 'margin') THEN 'percent' WHEN contains(n, 'share') THEN 'shares' END AS unit,
CASE WHEN regexp_full_match(n, '(19|20)[0-9][0-9]') THEN n END AS period FROM n""")
def semantic_roles(t):
    """Roles and hints of one column name per part, spelled in two ways."""
    name = F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int")), F.when(F.col("p_size") % 2 == 0, "").otherwise("!"))
    rows = t.part.select("p_partkey", name.alias("raw"))
    raw = F.col("raw")
    return rows.select("p_partkey", T.column_name(raw).alias("name"), profiling.semantic_role(raw).alias("role"), profiling.unit_hint(raw).alias("unit"), profiling.period_hint(raw).alias("period"))


@query("""SELECT o_orderkey AS row_key, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders""")
def eav_pivot(t):
    columns = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
    rows = profiling.wide(profiling.cells(t.orders, "o_orderkey", columns), columns)
    return rows.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("""WITH x AS (SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS row_index, sha256(to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus})::VARCHAR) AS row_hash FROM orders)
SELECT row_index, row_index + 1 AS physical_row, row_hash, left(sha256('orders' || chr(31) || row_index || chr(31) || row_hash), 32) AS row_id FROM x""")
def row_locators(t):
    return profiling.row_locators(t.orders, "orders", ["o_orderpriority", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def dedupe_content_hash(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).filter("copies > 1")


@query("""WITH i AS (SELECT doc_id, lpad(doc_id::VARCHAR, 12, '0') AS uri, sha256(text) AS content_hash FROM documents WHERE source <> 'src1'),
k AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE source = 'src1'),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY content_hash ORDER BY uri) = 1 AND content_hash NOT IN (SELECT content_hash FROM k) AS fresh FROM i)
SELECT CASE WHEN fresh THEN 'loaded' ELSE 'skipped_duplicate' END AS status, count(*) AS n FROM r GROUP BY ALL""")
def ingest_skip_duplicates(t):
    rows = t.documents.select("doc_id", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("uri"), F.sha2("text", 256).alias("content_hash"))
    fresh, skipped = index.new_documents(rows.filter("source <> 'src1'").drop("source"), rows.filter("source = 'src1'"))
    return fresh.select(F.lit("loaded").alias("status")).unionByName(skipped.select(F.lit("skipped_duplicate").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de') AND source = 'src3' GROUP BY ALL")
def metadata_filter(t):
    rows = retrieval.keep_where(t.documents, retrieval.merged_filters({"lang": ["en"], "colour": "red"}, {"lang": ["en", "de"], "source": "src3"}))
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT item_id AS task_id, 'dense' AS lane, text AS query FROM benchmark UNION ALL SELECT item_id, 'sparse', text || ' revenue margin margin margin' FROM benchmark UNION ALL SELECT item_id, 'section', text || ' risk' FROM benchmark UNION ALL SELECT item_id, 'table', text || ' table row page' FROM benchmark")
def lane_query_rewrite(t):
    words = lambda *ws: F.array(*map(F.lit, ws)).cast("array<string>")
    return retrieval.lane_queries(t.benchmark.select(F.col("item_id").alias("task_id"), "text", words("revenue").alias("should"), words("margin").alias("must"), words("risk").alias("sections")))


@query("""SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def parent_best_child(t):
    return fusion.best_per_group(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), F.col("doc_id").asc()])


@query("""SELECT page_id, concat_ws(chr(10), lag(url) OVER (PARTITION BY page_id // 10 ORDER BY page_id), url, lead(url) OVER (PARTITION BY page_id // 10 ORDER BY page_id)) AS stitched FROM pages""")
def page_neighbourhood(t):
    rows = t.pages.select("page_id", F.floor(F.col("page_id") / 10).alias("doc"), "url")
    return packing.stitch_pages(rows, "doc", "page_id", "url").select("page_id", "stitched")


@query("""WITH r AS (SELECT lang, doc_id, n_chars AS tokens, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY lang ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT lang, doc_id, rank, least(tokens, 50000 - before)::BIGINT AS kept_tokens FROM b WHERE before < 50000""")
def budget_fit(t):
    order = Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")
    rows = t.documents.select("lang", "doc_id", F.col("n_chars").alias("tokens"), F.row_number().over(order).alias("rank"))
    return packing.fit_prefix(rows, 50_000, "lang").select("lang", "doc_id", "rank", F.col("kept_tokens").cast("long").alias("kept_tokens"))


def _packing_sql(truncate: bool, budget: int = 2000, most: int = 5) -> str:
    """The walk by recursion: a step takes the next block, or, while a block is being cut, tries the next shorter length."""
    tok = lambda x: f"greatest(1, len(regexp_extract_all({x}, '[一-鿿]')) + len(regexp_extract_all({x}, '[A-Za-z0-9_]+(?:[-''][A-Za-z0-9_]+)?')) + len(regexp_extract_all({x}, '[^\\p{{L}}\\p{{N}}_\\s]')))::BIGINT"
    cut = lambda n: f"regexp_replace(left(b.text, {n}), '\\s+$', '')"
    shorter = "greatest(1, w.lim * 4 // 5)"
    return f"""WITH RECURSIVE {RRF_SQL},
blk AS (SELECT f.query_id, f.chunk_id AS block_id, f.rank, coalesce(d.text, '') AS text, {tok("coalesce(d.text, '')")} AS n, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank, f.chunk_id) AS pos
  FROM fused f JOIN documents d ON d.doc_id = f.chunk_id WHERE f.rank <= {OUTPUT_K}),
walk AS (
  SELECT query_id, 0::BIGINT AS pos, {budget}::BIGINT AS lft, 0::BIGINT AS used, NULL::BIGINT AS lim, NULL::BIGINT AS tokens, NULL::VARCHAR AS state, NULL::VARCHAR AS text FROM (SELECT DISTINCT query_id FROM blk)
  UNION ALL
  SELECT query_id, pos, CASE WHEN state = 'in' THEN lft - tokens ELSE lft END, CASE WHEN state = 'in' THEN used + 1 ELSE used END, lim, tokens, state, CASE WHEN state = 'in' THEN text END FROM (
    SELECT w.query_id, b.pos, w.lft, w.used,
      CASE WHEN w.lim IS NULL THEN CASE WHEN w.used >= {most} OR b.n <= w.lft OR w.lft <= 0 OR NOT {truncate} THEN NULL ELSE greatest(1, length(b.text) * w.lft // b.n) END
           WHEN {cut("w.lim")} = '' OR {cut("w.lim")} = {cut(shorter)} OR {tok(cut("w.lim"))} <= w.lft THEN NULL ELSE {shorter} END AS lim,
      CASE WHEN w.lim IS NULL THEN b.n ELSE {tok(cut("w.lim"))} END AS tokens,
      CASE WHEN w.lim IS NULL THEN CASE WHEN w.used >= {most} THEN 'max_blocks' WHEN b.n <= w.lft THEN 'in' WHEN w.lft <= 0 OR NOT {truncate} THEN 'token_budget' ELSE 'cutting' END
           WHEN {cut("w.lim")} = '' THEN 'token_budget' WHEN {cut("w.lim")} = {cut(shorter)} OR {tok(cut("w.lim"))} <= w.lft THEN 'in' ELSE 'cutting' END AS state,
      CASE WHEN w.lim IS NULL THEN b.text ELSE {cut("w.lim")} END AS text
    FROM walk w JOIN blk b ON b.query_id = w.query_id AND b.pos = w.pos + CASE WHEN w.lim IS NULL THEN 1 ELSE 0 END))
SELECT w.query_id, b.block_id, b.rank, CASE WHEN state = 'in' THEN w.tokens ELSE 0 END AS tokens, state = 'in' AS included, CASE WHEN state <> 'in' THEN state END AS drop_reason, w.text
FROM walk w JOIN blk b ON b.query_id = w.query_id AND b.pos = w.pos WHERE state <> 'cutting'"""


@query(_packing_sql(True))
def budget_pack_greedy(t):
    """Fused blocks of each query packed into 2000 tokens and at most five blocks, the last one cut."""
    return packing.pack(_blocks(t), 2000, 5)


@query(_packing_sql(False))
def budget_pack_drop(t):
    return packing.pack(_blocks(t), 2000, 5, truncate=False)


@query("""SELECT event_type, count(*) AS n, floor(avg(value))::BIGINT AS avg_ms, min(value) AS min_ms, max(value) AS max_ms,
quantile_disc(value, 0.5) AS p50_rank, quantile_disc(value, 0.95) AS p95_rank, round(quantile_cont(value, 0.5), 6) AS p50_linear, round(quantile_cont(value, 0.95), 6) AS p95_linear
FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def latency_percentiles(t):
    return measures.latency(t.events, "event_type", "value")


@query(f"""WITH {RRF_SQL}, rr AS ({ORACLE_SQL["rerank_cascade"]}),
gold AS (SELECT item_id AS case_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
al AS (SELECT query_id, chunk_id, lane AS mode, rank FROM lanes UNION ALL SELECT query_id, chunk_id, 'hybrid', rank FROM fused UNION ALL SELECT query_id, chunk_id, 'rerank', rank FROM rr),
fr AS (SELECT case_id, mode, min(rank) AS first_rank FROM al JOIN gold ON query_id = case_id AND chunk_id = doc_id GROUP BY ALL),
m AS (SELECT item_id AS case_id, min(first_rank) FILTER (mode = 'dense') AS dense, min(first_rank) FILTER (mode = 'bm25') AS bm25, min(first_rank) FILTER (mode = 'hybrid') AS hybrid,
      min(first_rank) FILTER (mode = 'rerank') AS rerank FROM benchmark LEFT JOIN fr ON case_id = item_id GROUP BY ALL),
x AS (SELECT unnest([CASE WHEN dense IS NULL AND bm25 IS NOT NULL THEN 'dense_missed_bm25_hit' END, CASE WHEN hybrid IS NOT NULL AND rerank IS NULL THEN 'hybrid_found_reranker_lost' END,
      CASE WHEN rerank < hybrid THEN 'reranker_improved_rank' END, CASE WHEN dense IS NULL AND hybrid IS NULL THEN 'both_dense_and_hybrid_missed' END]) AS bucket FROM m)
SELECT bucket, count(*) AS n FROM x WHERE bucket IS NOT NULL GROUP BY ALL""")
def failure_buckets(t):
    """Where one mode finds a case's passage that another misses: both lanes, the fused ranks as hybrid, the rerank cascade's as rerank."""
    return measures.failure_buckets(_first_ranks(t))


def _gold(t: Tables) -> DataFrame:
    """(query_id, doc_id): documents that hold the passage of a question."""
    return _once(t, "gold", lambda: retrieval.holding(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))))


def _first_ranks(t: Tables) -> DataFrame:
    """(case_id, mode, first_rank): the first document with the case's passage in each of the four modes; a case that none finds has one row with null."""
    gold = _gold(t).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("chunk_id"))
    ranks = lambda df, mode: df.select(F.col("query_id").alias("case_id"), "chunk_id", mode.alias("mode"), "rank")
    every = ranks(_lanes(t), F.col("lane")).unionByName(ranks(_fused(t), F.lit("hybrid"))).unionByName(ranks(_reranked(t), F.lit("rerank")))
    found = every.join(gold, ["case_id", "chunk_id"]).groupBy("case_id", "mode").agg(F.min("rank").alias("first_rank"))
    missing = t.benchmark.select(F.col("item_id").alias("case_id"), F.lit("dense").alias("mode"), F.lit(None).cast("int").alias("first_rank"))
    return found.unionByName(missing)


_EDGE_SQL = "e AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, 's' || l_suppkey || '-p' || l_partkey AS edge_id, round(sum(l_quantity) / 100.0, 6) AS confidence FROM lineitem GROUP BY ALL), u AS (SELECT source AS node, target AS other, edge_id, confidence FROM e UNION ALL SELECT target, source, edge_id, confidence FROM e)"


def _edges(t: Tables) -> DataFrame:
    """Suppliers and parts, with how much was shipped as confidence."""
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    rows = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_quantity") / 100.0, 6).alias("confidence"))
    return rows.select(s.alias("source"), p.alias("target"), F.concat(s, F.lit("-"), p).alias("edge_id"), "confidence")


@query(f"WITH {_EDGE_SQL} SELECT node, count(*) AS degree FROM u GROUP BY ALL")
def graph_degree(t):
    return graph.degrees(_edges(t))


@query(f"WITH {_EDGE_SQL} SELECT node FROM u GROUP BY node HAVING count(*) > 25")
def graph_hubs(t):
    return graph.hubs(_edges(t))


@query(f"""WITH {_EDGE_SQL} SELECT node, other, edge_id, confidence, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, edge_id) AS rank, count(*) OVER (PARTITION BY node) AS degree, count(*) OVER (PARTITION BY node) > 25 AS truncated
FROM u WHERE node LIKE 's%' QUALIFY rank <= 25""")
def graph_neighbours_capped(t):
    seeds = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return graph.neighbours(seeds, _edges(t))


@query(f"""WITH {_EDGE_SQL}, p AS (SELECT 's' || s_suppkey AS start, 's' || (s_suppkey + 1) AS goal FROM supplier),
c AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, edge_id) AS n FROM u QUALIFY n <= 25),
two AS (SELECT start, goal, 2 AS hops, a.other AS mid, a.edge_id AS edge1, b.edge_id AS edge2, (a.confidence + b.confidence) / 2 AS score
  FROM p JOIN c a ON a.node = start JOIN c b ON b.node = a.other AND b.other = goal WHERE a.other <> goal AND a.edge_id <> b.edge_id),
one AS (SELECT start, goal, 1 AS hops, NULL AS mid, edge_id AS edge1, NULL AS edge2, confidence AS score FROM p JOIN c ON node = start AND other = goal)
SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY hops, score DESC, edge1, edge2 NULLS FIRST) AS rank FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY rank <= 20""")
def graph_paths_2hop(t):
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    return graph.paths(t.supplier.select(s(F.col("s_suppkey")).alias("start"), s(F.col("s_suppkey") + 1).alias("goal")), _edges(t))


@query("""WITH t(term) AS (VALUES ('asia'), ('EUROPE'), ('ame'), ('middle'), ('region asia'), ('zzz')),
n AS (SELECT r_regionkey AS id, r_name AS name, lower(trim(r_name)) AS f FROM region),
a AS (SELECT id, name, lower('region ' || name) AS f FROM n),
x AS (SELECT term, id, name, 1.0 AS score FROM t JOIN n ON lower(term) = f UNION ALL SELECT term, id, name, 0.95 FROM t JOIN a ON lower(term) = f),
y AS (SELECT term, id, name, 0.75 AS score FROM t JOIN n ON contains(f, lower(term)) OR contains(lower(term), f) WHERE term NOT IN (SELECT term FROM x)
      UNION ALL SELECT term, id, name, 0.7 FROM t JOIN a ON contains(f, lower(term)) OR contains(lower(term), f) WHERE term NOT IN (SELECT term FROM x)),
z AS (SELECT term, id, name, max(score) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY ALL)
SELECT term, id AS entity_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY term ORDER BY score DESC, lower(name), id) AS rank FROM z""")
def graph_entity_match(t):
    terms = t.spark.createDataFrame([(x,) for x in ("asia", "EUROPE", "ame", "middle", "region asia", "zzz")], "term string")
    names = t.region.select(F.col("r_regionkey").alias("entity_id"), F.col("r_name").alias("name"), F.array(F.concat(F.lit("region "), "r_name")).alias("aliases"))
    return graph.resolve_entities(terms, names)


@query("""SELECT object_id, chunk_id, doc_id, rank FROM (SELECT l_suppkey AS object_id, l_orderkey AS chunk_id, o_custkey AS doc_id,
row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, anchor) AS rank FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_orderkey * 10 + l_linenumber AS anchor FROM lineitem) JOIN orders ON l_orderkey = o_orderkey) WHERE rank <= 3""")
def graph_grounding(t):
    anchors = t.lineitem.select(F.col("l_suppkey").alias("object_id"), F.col("l_orderkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("anchor_id"))
    chunks = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_index"))
    return graph.ground(t.supplier.select(F.col("s_suppkey").alias("object_id")), anchors, chunks)


@query("SELECT c_custkey AS object_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_scope(t):
    anchors = t.orders.select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("chunk_id"))
    return graph.in_scope(t.customer.select(F.col("c_custkey").alias("object_id")), anchors, t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_id")))


@query("SELECT c_custkey AS chunk_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)")
def anti_missing(t):
    """Customers without a large finished order."""
    large = t.orders.filter("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.col("o_custkey").alias("chunk_id"))
    return graph.missing_chunks(t.customer.select(F.col("c_custkey").alias("chunk_id")), large)


@query("SELECT s_suppkey, s_nationkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hydration_joins(t):
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    return t.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "r_name")


@query("""WITH k AS (SELECT l_suppkey, min(l_returnflag) AS flag FROM lineitem WHERE l_quantity >= 50 GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) = 1)
SELECT s_suppkey, coalesce(flag, 'unknown') AS flag FROM supplier LEFT JOIN k ON l_suppkey = s_suppkey""")
def version_backfill(t):
    """A value is carried over where a key has exactly one."""
    one = t.lineitem.filter("l_quantity >= 50").groupBy("l_suppkey").agg(F.min("l_returnflag").alias("flag"), F.count_distinct("l_returnflag").alias("n")).filter("n = 1")
    return t.supplier.join(one, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("flag", F.lit("unknown")).alias("flag"))


@query("""SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_size <= b.p_size + 1 AND a.p_size + 1 >= b.p_size""")
def page_overlap_join(t):
    """Intervals of one key that overlap: a join by key and bin."""
    lo, hi = datasets.ordered_range(F.col("p_size") + 1, F.col("p_size"))
    ranges = t.part.select("p_partkey", "p_brand", lo.alias("lo"), hi.alias("hi"))
    a, b = ranges.withColumnRenamed("p_partkey", "left_id"), ranges.withColumnRenamed("p_partkey", "right_id")
    return datasets.overlapping(a, b, "p_brand", bin_width=2).filter("left_id < right_id").select("left_id", "right_id")


@query("""WITH r AS (SELECT doc_id, lang, n_chars AS lo, n_chars + n_chars // 10 AS hi FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL)
SELECT a.doc_id, count(*) AS n FROM r a JOIN r b ON a.lang = b.lang AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL""")
def page_overlap_counts(t):
    """For every document, how many of its language have a range of lengths (the own one to a tenth more) that overlaps its own."""
    ranges = t.documents.select("doc_id", "lang", F.col("n_chars").alias("lo"), F.expr("n_chars + n_chars div 10").alias("hi")).filter("lang IS NOT NULL AND lo IS NOT NULL")
    return datasets.overlap_counts(ranges, ranges.select("lang", "lo", "hi"), "lang").select("doc_id", "n")


@query("SELECT table_id, n FROM (SELECT 'orders' AS table_id, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents)")
def obs_table_counts(t):
    rows = [t.__getattr__(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_id"), "n") for n in ("orders", "events", "documents")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT coalesce(event_type, 'unknown') AS kind, count(*) AS n FROM events GROUP BY ALL")
def obs_group_counts(t):
    return measures.group_counts(t.events, F.col("event_type"), "kind")


@query("""SELECT count(*) AS runs, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, coalesce(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 0)::BIGINT AS tokens,
round(count(*) FILTER (value > 50) / count(value)::DOUBLE, 6) AS slow_rate, round(avg(value), 6) AS avg_value FROM events""")
def obs_summary(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.agg(
        F.count("*").alias("runs"), F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"), F.coalesce(F.sum(k), F.lit(0)).alias("tokens"),
        F.round(measures.rate(F.col("value") > 50), 6).alias("slow_rate"), F.round(measures.mean_known(F.col("value")), 6).alias("avg_value"),
    )


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def obs_recent(t):
    return t.events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(10).select("event_id", "user_id")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_extract(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT query_id, CASE WHEN ex AND (fa OR pa) THEN 'partial' WHEN pa THEN 'partial' WHEN ex THEN 'executed' WHEN fa THEN 'failed' WHEN em THEN 'empty' ELSE 'skipped' END AS status FROM (
SELECT user_id AS query_id, bool_or(event_type = 'click') AS ex, bool_or(event_type = 'error') AS fa, false AS pa, bool_or(event_type = 'view') AS em FROM events GROUP BY ALL)""")
def status_rollup(t):
    status = F.when(F.col("event_type") == "click", "executed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "empty").otherwise("skipped")
    return measures.rollup_status(t.events.select(F.col("user_id").alias("query_id"), status.alias("status")))


@query("""SELECT 'en' AS component, count(*) FILTER (lang = 'en') AS hits, count(*) AS total, round(count(*) FILTER (lang = 'en') / count(*)::DOUBLE, 6) AS rate FROM documents
UNION ALL SELECT 'long', count(*) FILTER (n_chars > 1000), count(*) FILTER (n_chars <> 100), round(count(*) FILTER (n_chars > 1000) / count(*) FILTER (n_chars <> 100)::DOUBLE, 6) FROM documents""")
def presence_rates(t):
    rows = t.documents.select((F.col("lang") == "en").alias("en"), F.when(F.col("n_chars") != 100, F.col("n_chars") > 1000).alias("long"))
    return measures.presence_rates(rows, ["en", "long"])


@query("""SELECT count(*) AS cases, count(*) FILTER (quality = 1) AS hits, round(avg(toxic), 6) AS avg_keyword, round(avg(coalesce(n_chars::DOUBLE, 0)), 6) AS avg_latency, coalesce(sum(n_chars), 0)::BIGINT AS tokens, count(*) FILTER (quality <> 1) AS failures
FROM labels JOIN documents USING (doc_id)""")
def eval_labels_summary(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return measures.eval_summary(rows.select((F.col("quality") == 1).alias("hit"), F.col("toxic").cast("double").alias("keyword_share"), F.col("n_chars").cast("double").alias("latency_ms"), F.col("n_chars").alias("tokens")))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + coalesce(o.m, 0) AS rank FROM conversations LEFT JOIN (SELECT conv_id, max(turn) AS m FROM conversations WHERE role = 'system' GROUP BY ALL) o USING (conv_id)""")
def rank_backfill(t):
    offset = t.conversations.filter("role = 'system'").groupBy("conv_id").agg(F.max("turn").alias("m"))
    rows = t.conversations.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.join(offset, "conv_id", "left").select("conv_id", "turn", (F.col("n") + F.coalesce("m", F.lit(0))).alias("rank"))


@query("""SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY role, left(text, 20)) > 1 THEN left(text, 20) || '-' || substr(md5(conv_id || ':' || turn), 1, 8) ELSE left(text, 20) END AS label FROM conversations""")
def dup_disambiguate(t):
    rows = t.conversations.withColumn("h", F.left("text", F.lit(20)))
    counts = rows.groupBy("role", "h").agg(F.count("*").alias("n"))  # combined map-side; the join back can be split
    rows = rows.join(counts.withColumnRenamed("role", "_role").withColumnRenamed("h", "_h"), F.col("role").eqNullSafe(F.col("_role")) & F.col("h").eqNullSafe(F.col("_h")))
    suffix = F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 8)
    return rows.select("conv_id", "turn", F.when(F.col("n") > 1, F.concat("h", F.lit("-"), suffix)).otherwise(F.col("h")).alias("label"))


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 2")
def duplicate_keys(t):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 2")


@query(r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' [c' || doc_id % 7 || '] and [c3][c' || doc_id % 7 || '] [d1]' END AS text FROM documents),
m AS (SELECT doc_id, source, regexp_extract_all(text, '\[(c[0-9]+)\]', 1) AS m FROM d)
SELECT doc_id, nullif(trim(source), '') AS source, list_filter(m, lambda x, i: list_position(m, x) = i) AS marks FROM m WHERE len(m) > 0""")
def citations_extract(t):
    """The marks of every document that holds one; two documents in three get some at their end."""
    given = F.concat(F.lit(" [c"), F.col("doc_id") % 7, F.lit("] and [c3][c"), F.col("doc_id") % 7, F.lit("] [d1]"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "").otherwise(given))
    rows = t.documents.select("doc_id", T.blank_to_null(F.col("source")).alias("source"), T.citations(text).alias("marks"))
    return rows.filter(F.size("marks") > 0)


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(10) || '  # Head ' || doc_id || '  ' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents)
SELECT doc_id, CASE WHEN regexp_extract(text, '(?m)^\s*#\s+(.+?)\s*$', 1) <> '' THEN regexp_extract(text, '(?m)^\s*#\s+(.+?)\s*$', 1) ELSE 'file-' || doc_id END AS title FROM d""")
def text_title(t):
    """Every second document gets a heading."""
    head = F.concat(F.lit("\n  # Head "), F.col("doc_id").cast("string"), F.lit("  \n"), F.coalesce("text", F.lit("")))
    text = F.when(F.col("doc_id") % 2 == 0, head).otherwise(F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", T.title(text, F.concat(F.lit("file-"), F.col("doc_id").cast("string"))).alias("title"))


@query(r"""WITH x AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority AS p FROM orders),
c AS (SELECT *, k % 10 AS f FROM x)
SELECT k AS o_orderkey,
CASE f WHEN 0 THEN k WHEN 1 THEN -(k + 0.5) WHEN 2 THEN k WHEN 3 THEN k * 1000 WHEN 5 THEN substr(d, 1, 4)::DOUBLE END::DOUBLE AS number,
CASE f WHEN 4 THEN d WHEN 5 THEN substr(d, 1, 4) || '-01-01' WHEN 6 THEN d WHEN 7 THEN substr(d, 1, 7) || '-01' END AS day FROM c""")
def parse_cells(t):
    """A cell a row of orders, in the forms that cells have: thousands, parentheses, currency, exponents, dates in four forms, words."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    date = lambda form: F.date_format(d, form)
    forms = {0: F.format_string("%,d $", k), 1: F.format_string("(%d.5)", k), 2: F.format_string("$%d%%", k), 3: F.format_string("%de3", k), 4: date("yyyy-MM-dd"), 5: date("yyyy"), 6: date("MM/dd/yyyy"), 7: date("yyyy-MM"), 8: F.lit("N/A"), 9: F.col("o_orderpriority")}
    cell = F.coalesce(*[F.when(k % 10 == f, x) for f, x in forms.items()])
    return t.orders.select("o_orderkey", N.parse_number(cell).alias("number"), N.parse_date(cell).cast("string").alias("day"))


_NUMBERS_SQL = r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' rose 5% to $(1.5) and' WHEN 1 THEN ' (2,500) or €3 million' WHEN 2 THEN ' 7 bn' ELSE '' END) AS t FROM documents),
p AS (SELECT doc_id, t, '(\()?([$€£])?(\d[\d,]*(?:\.\d+)?)(\))?\s?(%|(?:thousand|million|billion|trillion|mm|bn|k|m|b)\b)?' AS p FROM d),
g AS (SELECT doc_id, regexp_extract_all(t, p, 1) AS o, regexp_extract_all(t, p, 2) AS c, regexp_extract_all(t, p, 3) AS n, regexp_extract_all(t, p, 4) AS e, regexp_extract_all(t, p, 5) AS s FROM p),
v AS (SELECT doc_id, list_transform(range(1, len(n) + 1), lambda i: {'v': CASE WHEN o[i] = '(' AND e[i] = ')' THEN -1 ELSE 1 END * replace(n[i], ',', '')::DOUBLE,
  'x': CASE s[i] WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'mm' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'b' THEN 1e9 WHEN 'trillion' THEN 1e12 ELSE 1 END,
  'u': CASE WHEN s[i] = '%' THEN '%' WHEN c[i] <> '' THEN c[i] ELSE '' END}) AS x FROM g)
SELECT doc_id, len(x)::BIGINT AS n, coalesce(list_sum(list_transform(x, lambda y: y.v)), 0) AS total, coalesce(list_sum(list_transform(x, lambda y: y.v * y.x)), 0) AS scaled,
array_to_string(list_transform(x, lambda y: y.u), '|') AS units FROM v"""


@query(_NUMBERS_SQL)
def numbers_extract(t):
    """Values, scales and units of all numbers; three documents in four get some at their end."""
    given = F.element_at(F.array(*map(F.lit, (" rose 5% to $(1.5) and", " (2,500) or €3 million", " 7 bn", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = t.documents.select("doc_id", N.extract_numbers(F.concat(F.coalesce("text", F.lit("")), given)).alias("x"))
    total = lambda f: F.aggregate(F.transform("x", lambda y: y[f]), F.lit(0.0), lambda a, v: a + v)
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), total("value").alias("total"), total("scaled").alias("scaled"), F.array_join(F.transform("x", lambda y: y["unit"]), "|").alias("units"))


@query(f"""WITH {RRF_SQL}, a AS (SELECT item_id AS query_id, unnest(list_slice(list_sort({TS.format("text")}), 1, 3)) AS anchor FROM benchmark),
s AS (SELECT f.query_id, f.chunk_id AS evidence_id, count(*) FILTER (contains(lower(d.text), anchor)) AS found, count(anchor) AS total FROM fused f JOIN documents d ON d.doc_id = f.chunk_id LEFT JOIN a ON a.query_id = f.query_id WHERE f.rank <= {OUTPUT_K} GROUP BY ALL),
v AS (SELECT query_id, bool_or(found = total) AS full_, bool_or(found > 0 AND found < total) AS part_ FROM s GROUP BY ALL)
SELECT query_id, CASE WHEN full_ THEN 'supported' WHEN part_ THEN 'partial' ELSE 'insufficient' END AS verdict FROM v""")
def evidence_verdict(t):
    texts = t.documents.select(F.col("doc_id").alias("evidence_id"), "text")
    rows = texts.join(_fused(t).filter(F.col("rank") <= OUTPUT_K).select("query_id", F.col("chunk_id").alias("evidence_id")), "evidence_id")
    anchors = _asked(t).select("query_id", F.explode(F.slice(F.array_sort(T.token_set(F.col("text"))), 1, 3)).alias("anchor"))
    return verification.evidence_verdict(verification.anchor_support(rows, anchors))


@query(f"""WITH {RRF_SQL}, a AS (SELECT item_id AS query_id, unnest(list_slice(list_sort({TS.format("text")}), 1, 3)) AS anchor FROM benchmark),
e AS (SELECT f.query_id, f.chunk_id AS evidence_id, f.rank, regexp_replace(lower(d.text), '[0-9]+', 'x', 'g') AS text, CASE WHEN f.query_id % 3 = 0 THEN 1500000 WHEN f.chunk_id % 2 = 0 THEN 2000000 ELSE 2500000 END AS number
      FROM fused f JOIN documents d ON d.doc_id = f.chunk_id WHERE f.rank <= {OUTPUT_K}),
s AS (SELECT e.query_id, evidence_id, number, count(*) FILTER (contains(text, regexp_replace(anchor, '[0-9]+', 'x', 'g'))) AS found, count(anchor) AS total FROM e LEFT JOIN a ON a.query_id = e.query_id GROUP BY ALL),
v AS (SELECT query_id, bool_or(found = total) AS full_, bool_or(found > 0 AND found < total) AS part_, count(DISTINCT number) FILTER (found = total) > 1 AS clash FROM s GROUP BY ALL)
SELECT query_id, CASE WHEN clash THEN 'contradicted' WHEN full_ THEN 'supported' WHEN part_ THEN 'partial' ELSE 'insufficient' END AS verdict FROM v""")
def evidence_conflicts(t):
    """Verdicts over evidence that states one number each: numbers of the texts are taken out, and one put at their end, the same for a
    third of the questions and one of two for the others. Supporting texts that differ contradict."""
    number = F.when(F.col("query_id") % 3 == 0, " of $1.5 million").when(F.col("evidence_id") % 2 == 0, " of $2,000,000").otherwise(" of $2.5 mm")
    plain = lambda c: F.regexp_replace(F.lower(F.col(c)), "[0-9]+", "x")
    found = _fused(t).filter(F.col("rank") <= OUTPUT_K).select("query_id", F.col("chunk_id").alias("evidence_id"), "rank")
    rows = t.documents.select(F.col("doc_id").alias("evidence_id"), plain("text").alias("text")).join(found, "evidence_id").withColumn("text", F.concat("text", number))
    anchors = _asked(t).select("query_id", F.explode(F.slice(F.array_sort(T.token_set(F.col("text"))), 1, 3)).alias("anchor")).withColumn("anchor", plain("anchor"))
    support = verification.anchor_support(rows, anchors)
    conflicts = verification.numeric_conflicts(rows.join(support.select("query_id", "evidence_id", "support"), ["query_id", "evidence_id"]))
    return verification.evidence_verdict(support, conflicts)


def _guard(t: Tables, table: str, columns: dict[str, str], sql: str) -> DataFrame:
    return guarded_sql.run(t.__getattr__(table), sql, guarded_sql.TableContext(table, columns))


_ORDERS = {"o_orderkey": "bigint", "o_orderpriority": "string", "o_orderstatus": "string", "o_totalprice": "double"}


@query("SELECT COUNT(*) AS row_count FROM lineitem")
def guard_count_rows(t):
    table = guarded_sql.TableContext("lineitem", {"l_orderkey": "bigint", "l_quantity": "double"})
    return guarded_sql.run(t.lineitem, guarded_sql.compile_question("How many rows are there per region?", table), table)


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY o_orderpriority ORDER BY 2 DESC LIMIT 5")
def guard_group_sum_topk(t):
    table = guarded_sql.TableContext("orders", _ORDERS)
    found = guarded_sql.run(t.orders, guarded_sql.compile_question("average o_totalprice by o_orderpriority", table), table)
    return found.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("SELECT round(max(o_totalprice), 4) AS max_o_totalprice FROM orders")
def guard_scalar_aggs(t):
    table = guarded_sql.TableContext("orders", _ORDERS)
    return guarded_sql.run(t.orders, guarded_sql.compile_question("highest o_totalprice", table), table).select(F.round("max_o_totalprice", 4).alias("max_o_totalprice"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand LIKE 'Brand%' AND p_size BETWEEN 5 AND 9 AND p_type IN ('ECONOMY', 'STANDARD') OR p_partkey = 7 ORDER BY p_partkey LIMIT 100")
def guard_filter_projection(t):
    columns = {"p_partkey": "bigint", "p_brand": "string", "p_size": "int", "p_type": "string"}
    return _guard(t, "part", columns, "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand LIKE 'Brand%' AND p_size BETWEEN 5 AND 9 AND p_type IN ('ECONOMY', 'STANDARD') OR p_partkey = 7 ORDER BY p_partkey LIMIT 500")


#: Statements that the dialect refuses, and that it allows.
REFUSED = (
    "SELECT * FROM orders", "SELECT DISTINCT o_orderkey FROM orders", "SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey + 1 FROM orders",
    "SELECT o_orderkey FROM orders; DROP TABLE orders", "SELECT row_number() OVER (ORDER BY o_orderkey) FROM orders", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT 1)",
    "SELECT o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority HAVING COUNT(*) > 1", "SELECT CAST(o_orderkey AS STRING) FROM orders", "SELECT o_orderkey FROM orders UNION SELECT 1",
    "WITH x AS (SELECT 1) SELECT o_orderkey FROM orders", "DELETE FROM orders", "SELECT o_comment FROM orders", "SELECT upper(o_orderstatus) FROM orders", "SELECT o_orderkey FROM orders -- x", "SELECT o_orderkey FROM lineitem",
)
ALLOWED = (
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 10 AND o_orderstatus IN ('F', 'O') ORDER BY o_totalprice DESC LIMIT 5", "SELECT COUNT(*) AS n FROM orders",
    "SELECT o_orderpriority, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a FROM orders WHERE o_orderkey BETWEEN 1 AND 9 AND NOT o_orderstatus IS NULL GROUP BY o_orderpriority ORDER BY s DESC",
)


def _outcomes_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    refused = [f"SELECT {quoted(x)} AS sql, 'refused' AS outcome, n AS table_rows, NULL::BIGINT AS result_rows FROM o" for x in REFUSED]
    allowed = [f"SELECT {quoted(x)}, 'allowed', n, (SELECT count(*) FROM ({x})) FROM o" for x in ALLOWED]
    return "WITH o AS (SELECT count(*) AS n FROM orders) " + " UNION ALL ".join(refused + allowed)


@query(_outcomes_sql())
def guard_rejects(t):
    """Statements against orders: what the dialect refuses doesn't run, what it allows does; with the table's rows and those of the result."""
    table = guarded_sql.TableContext("orders", _ORDERS)
    n = t.orders.agg(F.count("*").alias("table_rows"))
    rows = None
    for s in REFUSED + ALLOWED:
        try:
            ran = guarded_sql.run(t.orders, s, table).agg(F.count("*").alias("result_rows")).withColumn("outcome", F.lit("allowed"))
            one = n.join(ran)  # a row each
        except ValueError:
            one = n.select("table_rows", F.lit(None).cast("long").alias("result_rows"), F.lit("refused").alias("outcome"))
        one = one.select(F.lit(s).alias("sql"), "outcome", "table_rows", "result_rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows


_WHERE = "o_totalprice >= 1000.5 and o_orderstatus = 'F' and o_orderpriority like '1%' and o_orderkey <> 7"


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_WHERE}")
def guard_plain_where(t):
    """A conjunction of plain comparisons, read without a parser."""
    return guarded_sql.filter_plain(t.orders, _WHERE, guarded_sql.TableContext("orders", _ORDERS)).select("o_orderkey", "o_totalprice")


@query("""WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN -o_orderkey WHEN 2 THEN 1000 + o_orderkey % 1000 WHEN 3 THEN o_orderkey + 0.5 WHEN 4 THEN NULL ELSE o_orderkey END::DOUBLE AS amount,
trunc(CASE o_orderkey % 6 WHEN 1 THEN -o_orderkey WHEN 2 THEN 1000 + o_orderkey % 1000 WHEN 3 THEN o_orderkey + 0.5 WHEN 5 THEN o_orderkey END)::BIGINT AS pieces,
CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS paid FROM orders)
SELECT paid, sum(amount) AS total, sum(pieces)::BIGINT AS pieces, count(amount) AS n FROM x GROUP BY paid""")
def sql_typed_table(t):
    """A table of text cells is read as a typed one, and asked by a guarded statement."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 6 == 0, "").when(k % 6 == 1, F.format_string("(%d)", k)).when(k % 6 == 2, F.format_string("$1,%03d", k % 1000))
        .when(k % 6 == 3, F.format_string("%d.5%%", k)).when(k % 6 == 4, "n/a").otherwise(k.cast("string"))
    )
    flag = F.element_at(F.array(*map(F.lit, ("Yes", "f", " 1 ", "maybe"))), (k % 4 + 1).cast("int"))
    raw = t.orders.select(text.alias("Total ($)"), text.alias("2 pieces"), flag.alias("group"))
    rows, table = guarded_sql.typed_table(raw, "open orders", {"Total ($)": "number", "2 pieces": "integer", "group": "boolean"})
    amount, pieces, paid = table.columns
    found = guarded_sql.run(rows, f"SELECT {paid}, SUM({amount}) AS total, SUM({pieces}) AS pieces, COUNT({amount}) AS n FROM {table.name} GROUP BY {paid}", table)
    return found.withColumnRenamed(paid, "paid")


_ROUTED = ("orders", "part", "customer", "events", "documents")


@query(f"""WITH col AS (SELECT table_name AS table_id, column_name AS c, data_type AS kind FROM information_schema.columns WHERE table_name IN {_ROUTED}),
w AS (SELECT table_id, unnest(list_concat(['table', table_id], string_split(c, '_'))) AS w FROM col),
c AS (SELECT table_id, list(DISTINCT w) FILTER (length(w) > 1) AS toks FROM w GROUP BY ALL),
i AS (SELECT table_id, list(lower(c)) FILTER (kind IN ('BIGINT', 'INTEGER', 'DOUBLE')) AS ids, bool_or(kind = 'DOUBLE') AS num FROM col GROUP BY ALL),
a AS (SELECT item_id AS question_id, lower(text || CASE item_id % 5 WHEN 0 THEN ' total price orders priority status' WHEN 1 THEN ' part brand size type p_size' WHEN 2 THEN ' customer nation' WHEN 3 THEN ' event user_id' ELSE '' END) AS t FROM benchmark),
q AS (SELECT question_id, list_filter(list_distinct(regexp_extract_all(CASE WHEN question_id % 2 = 0 THEN regexp_extract(t, '[^ ]* ?[^ ]*$') ELSE t END, '[a-z0-9_]+')), lambda x: length(x) > 1) AS qt FROM a),
s AS (SELECT question_id, table_id, round(least(1.0, len(list_intersect(qt, toks)) / greatest(3, len(qt))::DOUBLE + CASE WHEN len(list_intersect(qt, ids)) > 0 THEN 0.25 ELSE 0 END + CASE WHEN num THEN 0.05 ELSE 0 END), 6) AS score FROM q, c JOIN i USING (table_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, table_id) AS rank, round(score - coalesce(lead(score) OVER (PARTITION BY question_id ORDER BY score DESC, table_id), 0), 6) AS margin FROM s)
SELECT question_id, table_id, score, margin, CASE WHEN score < 0.15 THEN 'no_match' WHEN margin < 0.1 THEN 'ambiguous' ELSE 'matched' END AS status FROM r WHERE rank = 1""")
def schema_route_scores(t):
    """Every question of the benchmark (four in five get words of a table at their end, every second is its last two words) against cards
    made from the tables' own columns."""
    cards = []
    for name in _ROUTED:
        kinds = t.__getattr__(name).dtypes
        numbers = [c for c, k in kinds if k in ("bigint", "int", "double")]
        cards.append((name, " ".join(["table", name, *(w for c, _ in kinds for w in c.split("_"))]), numbers, any(k == "double" for _, k in kinds)))
    given = F.element_at(F.array(*map(F.lit, (" total price orders priority status", " part brand size type p_size", " customer nation", " event user_id", ""))), (F.col("item_id") % 5 + 1).cast("int"))
    whole = F.lower(F.concat("text", given))
    asked = t.benchmark.select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 2 == 0, F.regexp_extract(whole, "[^ ]* ?[^ ]*$", 0)).otherwise(whole).alias("text"))
    return profiling.route_scores(t.spark.createDataFrame(cards, "table_id string, text string, identifiers array<string>, numeric boolean"), asked)


@query("""WITH q AS (SELECT item_id AS query_id, text || CASE item_id % 4 WHEN 0 THEN ' net sales in FY2023' WHEN 1 THEN ' gross_profit and total assets' WHEN 2 THEN ' from 2021 to 2022' ELSE '' END AS text FROM benchmark),
u AS (SELECT query_id, 0 AS o, 'original' AS purpose, text, 1.0::DOUBLE AS weight FROM q
UNION ALL SELECT query_id, 1, 'metric_alias', text || ' revenue', 1.5 FROM q WHERE query_id % 4 = 0
UNION ALL SELECT query_id, 1, 'metric_alias', text || ' ' || m, 1.5 FROM q, (SELECT unnest(['gross profit', 'total assets']) AS m) WHERE query_id % 4 = 1
UNION ALL SELECT query_id, 2, 'period_anchor', text || CASE query_id % 4 WHEN 0 THEN ' 2023' ELSE ' 2021 2022' END, 1.2 FROM q WHERE query_id % 2 = 0)
SELECT query_id, 'u' || (row_number() OVER (PARTITION BY query_id ORDER BY o, text) - 1) AS unit_id, purpose, text, weight, 'ready' AS status FROM u""")
def plan_tasks(t):
    """Questions that name metrics and years: three in four get some at their end."""
    given = F.element_at(F.array(*map(F.lit, (" net sales in FY2023", " gross_profit and total assets", " from 2021 to 2022", ""))), (F.col("query_id") % 4 + 1).cast("int"))
    asked = _asked(t).withColumn("text", F.concat("text", given))
    units = planning.plan_units(asked, planning.metric_mentions(asked, planning.ontology(t.spark)))
    return planning.unit_tasks(units).select("query_id", "unit_id", "purpose", "text", "weight", "status")


@query("SELECT count(*) AS live FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' OR event_id % 10 = 0")
def cache_ttl_filter(t):
    expires = F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp"))
    return planning.live_entries(t.events.select("event_id", expires.alias("expires_at")), F.lit("2024-01-15 00:00:00").cast("timestamp")).agg(F.count("*").alias("live"))


def _replayed(t: Tables, events: DataFrame) -> DataFrame:
    """A stream over ``events`` in four batches; every file holds events of all times, so later batches change old windows."""
    folder, files = ingest.split_table(events, "event_id", 4, "events")
    return ingest.event_stream(t.spark, folder, events.schema, files)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(t):
    """The stream over the table's files in complete mode gives what the batch gives."""
    rows = ingest.tumbling(_replayed(t, t.events))
    return ingest.to_table(rows, "stream-tumbling").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS window_start, event_type, value FROM events)
SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def stream_sliding(t):
    rows = ingest.sliding(_replayed(t, t.events))
    return ingest.to_table(rows, "stream-sliding").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new_ FROM events),
r AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM r GROUP BY user_id, s""")
def stream_session(t):
    rows = ingest.to_table(ingest.sessions(_replayed(t, t.events), late="36500 days"), "stream-session")  # no event is too late
    return rows.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_dedupe(t):
    """Every event twice; the second is dropped by its idempotency key. Files may come in any order of time."""
    twice = t.events.unionByName(t.events)
    folder, files = ingest.split_table(twice.withColumn("copy", F.monotonically_increasing_id()), "copy", 4, "events-twice")  # copies in other batches too
    rows = ingest.event_stream(t.spark, folder, twice.withColumn("copy", F.lit(0).cast("long")).schema, files)
    kept = ingest.to_table(ingest.distinct_events(rows, late=None).select("event_type"), "stream-dedupe", "append")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT page_id, unnest(CASE page_id % 3 WHEN 0 THEN [page_id] WHEN 1 THEN [page_id, page_id + 1] ELSE [page_id - 1, page_id, page_id + 1] END) AS page FROM pages")
def page_candidates(t):
    kind = F.element_at(F.array(*map(F.lit, ("normalized", "raw", "ambiguous"))), (F.col("page_id") % 3 + 1).cast("int"))
    return t.pages.select("page_id", F.explode(datasets.page_candidates(F.col("page_id"), kind)).alias("page"))


@query("""WITH c AS (SELECT doc_id AS case_id, doc_id // 10 AS doc, doc_id % 10 AS page, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents),
p AS (SELECT a.case_id, a.page AS raw_page, a.t AS e, b.page, b.t FROM c a JOIN c b USING (doc) WHERE b.t <> ''),
s AS (SELECT case_id, page, raw_page, greatest(CASE WHEN e = '' THEN 0 WHEN e = t THEN 80 WHEN contains(t, e) THEN 70 WHEN length(t) >= 200 AND contains(e, t) THEN 65 ELSE 0 END,
  CASE WHEN length(e) >= 240 AND (contains(t, left(e, 180))::INT + contains(t, substr(e, length(e) // 2 + 1, 180))::INT + contains(t, right(e, 180))::INT) > 0
  THEN 40 + 10 * (contains(t, left(e, 180))::INT + contains(t, substr(e, length(e) // 2 + 1, 180))::INT + contains(t, right(e, 180))::INT) ELSE 0 END) AS score FROM p)
SELECT case_id, page, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, least(abs(page - raw_page), abs(page - raw_page - 1), abs(page - raw_page + 1)), page) = 1""")
def page_inference(t):
    """Documents taken as pages, ten to a report: each one's whole text is the evidence of a case, whose page has to be found again."""
    docs = t.documents.select(F.col("doc_id").alias("case_id"), F.floor(F.col("doc_id") / 10).alias("doc_id"), (F.col("doc_id") % 10).alias("page"), "text")
    cases = docs.select("case_id", "doc_id", F.col("page").alias("raw_page"), F.lit(None).cast("string").alias("full_page"), F.col("text").alias("evidence"))
    return datasets.infer_pages(cases, docs.select("doc_id", "page", "text")).withColumn("score", F.col("score").cast("int"))


@query("SELECT role AS lane, count(*) AS n, round(CASE role WHEN 'reranker' THEN max(length(text)) ELSE sum(length(text)) END, 6) AS total_ms, max(length(text)) AS max_ms FROM conversations GROUP BY role")
def lane_metrics(t):
    rows = t.conversations.select(F.col("role").alias("lane"), F.length("text").alias("latency_ms"))
    return traces.lane_metrics(rows)


@query(f"""WITH {LANES_SQL} SELECT query_id, (8 + count(*) FILTER (chunk_id % 11 = 0 OR chunk_id % 7 = 0))::BIGINT AS max_blocks FROM lanes GROUP BY ALL""")
def block_allowance(t):
    policy = F.when((F.col("chunk_id") % 11 == 0) | (F.col("chunk_id") % 7 == 0), "pinned").otherwise("ranked")
    return candidates.block_allowance(_lanes(t).withColumn("policy", policy), 8)


@query("SELECT doc_name, link, row_ids FROM (SELECT md5(text) AS doc_name, min(lang) AS link, list_sort(list(doc_id)) AS row_ids, count(DISTINCT lang) AS n FROM documents GROUP BY ALL) WHERE n <= 1")
def request_groups(t):
    return datasets.group_requests(t.documents.select(F.col("doc_id").alias("row_id"), F.md5("text").alias("doc_name"), F.col("lang").alias("link")))[0]


@query("""WITH r AS (SELECT conv_id AS query_id, turn, role, text FROM conversations)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn) - 1 AS position, role AS lane FROM r""")
def trace_flatten(t):
    """Conversations logged as nested JSON and flattened again."""
    one = F.struct(F.col("text").alias("chunk_id"), F.col("role").alias("lane"), F.col("turn").cast("int").alias("rank"), F.lit(1.0).alias("score"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("c")))), lambda x: x["c"])
    nested = t.conversations.groupBy("conv_id").agg(ordered.alias("candidates"))
    lines = nested.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("query_id"), "candidates")).alias("value"))
    rows = traces.flatten(traces.parse(lines))["candidates"]
    return rows.select(F.col("query_id").cast("long").alias("query_id"), "position", "lane")


@query(f"""WITH {LANES_SQL}, gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
cq AS (SELECT item_id AS query_id FROM benchmark), e AS (SELECT query_id, count(*) AS expected FROM gold GROUP BY ALL),
h AS (SELECT lane AS mode, l.query_id, rank, row_number() OVER (PARTITION BY lane, l.query_id ORDER BY rank) / rank::DOUBLE AS p FROM lanes l JOIN gold g ON g.query_id = l.query_id AND doc_id = chunk_id),
m AS (SELECT mode, query_id, min(rank) AS f, sum(p) AS s FROM h GROUP BY ALL), x AS (SELECT 'bm25' AS mode UNION ALL SELECT 'dense'),
z AS (SELECT x.mode, cq.query_id, f, round(coalesce(1.0 / f, 0), 6) AS rr, round(coalesce(s, 0) / greatest(1, coalesce(expected, 0)), 6) AS ap FROM x CROSS JOIN cq LEFT JOIN m ON m.mode = x.mode AND m.query_id = cq.query_id LEFT JOIN e ON e.query_id = cq.query_id)
SELECT mode, count(*) AS cases, round(avg(coalesce(f <= 1, false)::INT), 6) AS hit_1, round(avg(coalesce(f <= 3, false)::INT), 6) AS hit_3, round(avg(coalesce(f <= 5, false)::INT), 6) AS hit_5, round(avg(coalesce(f <= 10, false)::INT), 6) AS hit_10,
round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map FROM z GROUP BY mode""")
def retrieval_ablation(t):
    gold = _gold(t).withColumnRenamed("doc_id", "item")
    lanes = _lanes(t).withColumnRenamed("chunk_id", "item")
    return traces.ablation(_asked(t), {m: lanes.filter(F.col("lane") == m).select("query_id", "item", "rank") for m in ("bm25", "dense")}, gold)


@query(f"""WITH {_EDGE_SQL} SELECT node AS item_id, round(avg(confidence), 9) AS score, CASE WHEN node LIKE 's%' AND (substr(node, 2)::BIGINT) % 3 = 0 THEN 1.0 ELSE 0.0 END AS grounding FROM u GROUP BY node""")
def graph_item_scores(t):
    """Nodes as graph items: every third supplier has an anchor."""
    sides = graph.undirected(_edges(t)).select(F.col("node").alias("item_id"), F.col("node").alias("object_id"), "confidence")
    anchors = t.supplier.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("object_id"))
    return graph.graph_scores(sides, anchors)


@query("""WITH e AS (SELECT 's' || s_suppkey AS id, 'v' || s_nationkey % 3 AS v FROM supplier UNION ALL SELECT 's' || s_suppkey, 'v9' FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'v' || p_size % 3 END FROM part),
one AS (SELECT id, min(v) AS v FROM e WHERE v IS NOT NULL GROUP BY id HAVING count(DISTINCT v) = 1),
r AS (SELECT DISTINCT 's' || l_suppkey || '-p' || l_partkey AS relationship_id, 's' || l_suppkey AS source, 'p' || l_partkey AS target, CASE WHEN (l_suppkey + l_partkey) % 10 = 0 THEN 'given' END AS v FROM lineitem)
SELECT relationship_id, source, target, coalesce(r.v, CASE WHEN a.v = b.v THEN a.v END) AS graph_version FROM r LEFT JOIN one a ON a.id = source LEFT JOIN one b ON b.id = target""")
def version_two_ends(t):
    """A relationship takes over the version on which both its ends agree."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    version = lambda c: F.concat(F.lit("v"), (F.col(c) % 3).cast("string"))
    suppliers = t.supplier.select(name("s", "s_suppkey").alias("entity_id"), version("s_nationkey").alias("graph_version"))
    twice = t.supplier.filter("s_suppkey % 7 = 0").select(name("s", "s_suppkey").alias("entity_id"), F.lit("v9").alias("graph_version"))
    parts = t.part.select(name("p", "p_partkey").alias("entity_id"), F.when(F.col("p_size") % 5 != 0, version("p_size")).alias("graph_version"))
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    s, p = name("s", "l_suppkey"), name("p", "l_partkey")
    given = F.when((F.col("l_suppkey") + F.col("l_partkey")) % 10 == 0, "given")
    edges = pairs.select(F.concat(s, F.lit("-"), p).alias("relationship_id"), s.alias("source"), p.alias("target"), given.alias("graph_version"))
    return graph.backfill_version(edges, suppliers.unionByName(twice).unionByName(parts))


_HINT_SQL = r"regexp_replace(regexp_replace(regexp_replace(split_part(split_part(lower(trim({0})), '?', 1), '#', 1), '/+$', ''), '^.*/', ''), '[^a-z0-9]+', '', 'g')"


@query(rf"""WITH p AS (SELECT page_id, url, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS last FROM pages),
h AS (SELECT page_id AS case_id, {_HINT_SQL.format("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN left(last, 4) ELSE 'x/a-' || last || '.pdf' END")} AS k FROM p),
d AS (SELECT page_id AS doc_id, {_HINT_SQL.format("url")} AS k FROM pages)
SELECT case_id, doc_id FROM h JOIN d ON h.k <> '' AND d.k <> '' AND (contains(h.k, d.k) OR contains(d.k, h.k))""")
def document_hints(t):
    """Pages found by their whole address, by the start of its last part, and by a longer name that holds it."""
    last = F.regexp_extract("url", "([^/?#]*)([?#].*)?$", 1)
    hint = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.left(last, F.lit(4))).otherwise(F.concat(F.lit("x/a-"), last, F.lit(".pdf")))
    return datasets.hinted_documents(t.pages.select(F.col("page_id").alias("case_id"), hint.alias("hint")), t.pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("name")))


_LANE_STOP = str(list(fusion.LANE_STOP_WORDS))
_LANE_TS = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')), lambda x: NOT list_contains(" + _LANE_STOP + ", x))"


@query(f"""WITH {RRF_SQL},
c AS (SELECT f.query_id, f.chunk_id, d.source, d.lang, trim(regexp_replace(replace(lower(d.text), '_', ' '), '\\s+', ' ', 'g')) AS blob, q.text AS qt, {_LANE_TS.format("q.text")} AS a, {_LANE_TS.format("d.text")} AS b
      FROM fused f JOIN benchmark q ON q.item_id = f.query_id JOIN documents d ON d.doc_id = f.chunk_id WHERE f.rank <= {OUTPUT_K}),
s AS (SELECT *, list_slice(list_sort(a), 1, 2) AS must, list_slice(list_sort(a), 3, 3) AS should, list_slice(list_sort(a), 4, 5) AS al FROM c),
x AS (SELECT *, len(list_intersect(a, b)) AS shared, len(list_intersect(list_concat(must, should), b)) AS asked, (source = 'src1')::INT AS entity, (lang = 'en')::INT AS metric,
      contains(blob, '20')::INT + contains(blob, '7')::INT AS periods, len(list_filter(al, lambda y: contains(blob, y))) AS aliases, regexp_matches(blob, '\\b\\d[\\d,.]*\\b')::INT AS number FROM s)
SELECT query_id, chunk_id, round(0.15 * shared + 1.8 * metric + entity + 0.45 * periods, 6) AS dense, round(0.35 * shared + 0.25 * periods + 0.8 * entity + 0.5 * len(list_filter(must, lambda y: contains(blob, y))), 6) AS bm25,
round(0.2 * asked + 1.2 * aliases + 0.7 * entity + 0.35 * periods, 6) AS metric_alias, round(0.2 * asked + 0.9 * number + 0.5 * (contains(blob, 'cash flow') OR contains(blob, 'statement'))::INT + 0.8 * metric + 0.25 * periods, 6) AS table_score FROM x""")
def ablation_lane_scores(t):
    """The four deterministic lane scores of each question's best fused hits; words of the question stand for its terms."""
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("company"), "lang")
    rows = texts.join(_fused(t).filter(F.col("rank") <= OUTPUT_K).select("query_id", "chunk_id"), "chunk_id").join(_asked(t).withColumnRenamed("text", "unit_text"), "query_id")
    terms = F.array_sort(T.token_set(T.normal_term(F.col("unit_text")), fusion.LANE_STOP_WORDS))
    pairs = rows.withColumns({
        "must": F.slice(terms, 1, 2), "should": F.slice(terms, 3, 1), "aliases": F.slice(terms, 4, 2), "periods": F.array(F.lit("20"), F.lit("7")), "entity": F.lit("src1"),
        "metric": F.lit("en"), "metrics": F.array("lang"), "sparse_text": F.lit(None).cast("string"),
    })
    return fusion.lane_scores(pairs, boost_must=True).select("query_id", "chunk_id", "dense", "bm25", "metric_alias", F.col("table").alias("table_score"))


@query("""WITH c AS (SELECT doc_id AS chunk_id, doc_id // 10 AS doc, (doc_id % 10)::INT AS page FROM documents),
p AS (SELECT DISTINCT doc, page, 'p' || doc || '-' || page AS id FROM c WHERE page % 2 = 0), w AS (SELECT DISTINCT doc, 'd' || doc AS id FROM c WHERE doc % 3 <> 0)
SELECT chunk_id, coalesce(p.id, w.id) AS parent_id FROM c LEFT JOIN p USING (doc, page) LEFT JOIN w USING (doc)""")
def chunk_parent_map(t):
    """Chunks with their page's parent, else their document's, else none."""
    doc, page = F.floor(F.col("doc_id") / 10), (F.col("doc_id") % 10).cast("int")
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), doc.alias("doc_id"), page.alias("page"))
    d, p = F.col("doc_id").cast("string"), F.col("page").cast("string")
    pages = chunks.filter("page % 2 = 0").select("doc_id", "page", F.concat(F.lit("p"), d, F.lit("-"), p).alias("parent_id")).distinct()
    whole = chunks.filter("doc_id % 3 <> 0").select("doc_id", F.lit(None).cast("int").alias("page"), F.concat(F.lit("d"), d).alias("parent_id")).distinct()
    return chunking.chunk_parents(chunks, pages.unionByName(whole)).select("chunk_id", "parent_id")
