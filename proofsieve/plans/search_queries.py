"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.functions.text import canonical_section_key, default_query_text, space_tokens, tokens
from proofsieve.operators import evidence as E
from proofsieve.operators import search as S
from proofsieve.operators import stored as I
from proofsieve.plans import views as V
from proofsieve.sources.scratch import work_dir
from proofsieve.plans.sql import SPACED, normal, intent_ctes, bm25_ctes, dense_ctes

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {V.CHUNKS}, {V.QUERIES}, {V.FILTERED} SELECT q.query_id, count(c.chunk_id) AS n FROM fq q LEFT JOIN chunks c ON {V.MEETS.format('q.section_key IS NOT NULL OR ')} GROUP BY 1")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.count_documents(V.filtered_queries(spark, d), V.chunks(spark, d))


@query(f"WITH {V.CHUNKS}, {V.QUERIES}, {V.FILTERED} SELECT q.query_id, count(c.chunk_id) AS n FROM fq q LEFT JOIN chunks c ON {V.MEETS.format('')} GROUP BY 1")
def metadata_filter_strict(spark: SparkSession, d: str) -> DataFrame:
    return S.count_documents(V.filtered_queries(spark, d), V.chunks(spark, d), strict=True)


@query(f"WITH {V.CHUNKS}, q AS (SELECT DISTINCT ticker, filing_type FROM chunks) SELECT ticker, filing_type, count(*) AS n FROM q JOIN chunks c USING (ticker, filing_type) GROUP BY 1, 2")
def count_documents(spark: SparkSession, d: str) -> DataFrame:
    c = V.chunks(spark, d)
    q = c.select("ticker", "filing_type").distinct().select("*", F.concat_ws("/", "ticker", "filing_type").alias("query_id"), *[F.lit(None).cast("string").alias(x) for x in ("section_key", "section_name", "filing_date")])
    return q.select("query_id", "ticker", "filing_type").join(S.count_documents(q, c), "query_id").drop("query_id")


def _dense(metric: str) -> str:
    return f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {dense_ctes('queries', 'vchunks', 5, metric)} SELECT query_id, chunk_id, rank, distance, round(1 / (1 + distance), 8) AS relevance FROM dense"


@query(_dense("cosine"))
def dense_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return S.dense_topk(V.queries(spark, d), V.vector_chunks(spark, d), 5).withColumn("relevance", F.round("relevance", 8))


@query(_dense("l2"))
def dense_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    return S.dense_topk(V.queries(spark, d), V.vector_chunks(spark, d), 5, "l2").withColumn("relevance", F.round("relevance", 8))


@query("SELECT vec_id, round(1 / (1 + sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))), 9) AS relevance FROM embeddings")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "embeddings").select("vec_id", F.round(S.relevance(S.norm(F.col("embedding"))), 9).alias("relevance"))


@query(f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {V.FILTERED}, pairs AS (SELECT q.query_id, c.chunk_id, q.embedding AS a, c.embedding AS b FROM fq q JOIN vchunks c ON c.embedding IS NOT NULL AND {V.MEETS.format('q.section_key IS NOT NULL OR ')}), "
       "d AS (SELECT query_id, chunk_id, round(greatest(0, 1 - list_cosine_similarity(a::DOUBLE[], b::DOUBLE[])), 9) AS distance FROM pairs) "
       "SELECT query_id, chunk_id, rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d) WHERE rank <= 5")  # fmt: skip
def search_by_ticker(spark: SparkSession, d: str) -> DataFrame:
    return S.dense_topk(V.filtered_queries(spark, d), V.vector_chunks(spark, d), 5).select("query_id", "chunk_id", "rank", "distance")


FALLBACK = """, aq AS (SELECT query_id, upper(ticker) AS ticker, embedding, section, section_pos, CASE section WHEN 'Item 1A Risk Factors' THEN 'risk_factors' WHEN 'MD&A' THEN 'md&a' WHEN 'Market Risk' THEN 'market_risk' END AS k FROM asked),
fp AS (SELECT query_id, section, section_pos, chunk_id, round(greatest(0, 1 - list_cosine_similarity(aq.embedding::DOUBLE[], c.embedding::DOUBLE[])), 9) AS distance,
  CASE WHEN k = c.section_key THEN 0 WHEN coalesce(CASE k WHEN 'risk_factors' THEN 'Risk Factors' WHEN 'md&a' THEN 'MD&A' WHEN 'market_risk' THEN 'Market Risk' END, section) = c.section_name THEN 1 WHEN section = c.section_name THEN 2 END AS strategy
  FROM aq JOIN vchunks c ON aq.ticker = c.ticker AND c.embedding IS NOT NULL),
fk AS (SELECT * FROM (SELECT *, min(strategy) OVER (PARTITION BY query_id, section) AS used FROM fp WHERE strategy IS NOT NULL) WHERE strategy = used),
fr AS (SELECT query_id, section, section_pos, strategy, chunk_id, distance, row_number() OVER (PARTITION BY query_id, section ORDER BY distance, chunk_id) AS rank FROM fk)"""


@query(f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, asked AS (SELECT *, 0 AS section_pos, ['Item 1A Risk Factors', 'MD&A', 'Unheard of', 'Market Risk'][item_id % 4 + 1] AS section FROM queries){FALLBACK} SELECT query_id, section, strategy, chunk_id, rank, distance FROM fr WHERE rank <= 5")
def section_fallback(spark: SparkSession, d: str) -> DataFrame:
    q = V.queries(spark, d).withColumn("section", F.expr("array('Item 1A Risk Factors', 'MD&A', 'Unheard of', 'Market Risk')[item_id % 4]")).select("query_id", "ticker", "section", "embedding")
    return S.section_fallback(q, V.vector_chunks(spark, d)).select("query_id", "section", "strategy", "chunk_id", "rank", "distance")


@query(f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, asked AS (SELECT *, unnest([0, 1]) AS section_pos, unnest(['Market Risk', 'MD&A']) AS section FROM queries){FALLBACK}, "
       "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY section_pos) AS n FROM fr WHERE rank <= 8) WHERE n = 1) "
       "SELECT query_id, chunk_id, section, distance, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 / (1 + distance) DESC, chunk_id) AS r FROM one) WHERE r <= 8")  # fmt: skip
def search_sections(spark: SparkSession, d: str) -> DataFrame:
    q = V.queries(spark, d).select("query_id", "ticker", "embedding", F.array(F.lit("Market Risk"), F.lit("MD&A")).alias("sections"))
    return S.search_sections(q, V.vector_chunks(spark, d)).select("query_id", "chunk_id", "section", "distance", "rank")


@query(f"WITH {V.QUERIES}, {V.WORDED}, {intent_ctes('wq')} SELECT query_id, array_to_string(target_sections, ',') AS target_sections, confidence, array_to_string(matched_terms, ',') AS matched_terms FROM intent")
def section_intent(spark: SparkSession, d: str) -> DataFrame:
    out = S.section_intent(V.worded_queries(spark, d))
    return out.select("query_id", F.array_join("target_sections", ",").alias("target_sections"), "confidence", F.array_join("matched_terms", ",").alias("matched_terms"))


@query(f"""WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {V.WORDED}, {intent_ctes('wq')}, {dense_ctes('wq', 'vchunks', 8, 'cosine')},
tq AS (SELECT w.query_id, w.ticker, w.embedding, t.section, t.section_pos FROM wq w JOIN (SELECT query_id, unnest(target_sections) AS section, unnest(range(len(target_sections))) AS section_pos FROM intent) t USING (query_id)),
tp AS (SELECT query_id, section, section_pos, chunk_id, round(greatest(0, 1 - list_cosine_similarity(tq.embedding::DOUBLE[], c.embedding::DOUBLE[])), 9) AS distance FROM tq JOIN vchunks c ON tq.ticker = c.ticker AND tq.section = c.section_key AND c.embedding IS NOT NULL),
ts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY distance, chunk_id) AS n FROM tp) WHERE n <= 8),
aimed AS (SELECT query_id, chunk_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 / (1 + distance) DESC, chunk_id) AS r FROM ts) WHERE r <= 8),
found AS (SELECT query_id, chunk_id, min(distance) AS distance, max(1 / (1 + distance)) AS relevance, max(t) AS t FROM (SELECT query_id, chunk_id, distance, 0 AS t FROM dense UNION ALL SELECT query_id, chunk_id, distance, 1 FROM aimed) GROUP BY 1, 2),
scored AS (SELECT f.query_id, f.chunk_id, f.t = 1 AS targeted, distance, round(relevance + CASE WHEN list_contains(target_sections, c.section_key) THEN 0.35 ELSE 0 END + CASE WHEN f.t = 1 THEN 0.05 ELSE 0 END
  + least(0.15, 0.03 * len(list_filter(matched_tokens, lambda x: contains({normal('c.text')}, x)))), 6) AS score FROM found f JOIN intent USING (query_id) JOIN vchunks c USING (chunk_id))
SELECT query_id, chunk_id, rank, score, targeted, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5""")
def section_aware_search(spark: SparkSession, d: str) -> DataFrame:
    return S.section_aware_search(V.worded_queries(spark, d), V.vector_chunks(spark, d))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct FROM documents")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = V.table(spark, d, "documents").select("doc_id", tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {SPACED.format('text')} AS t FROM documents)")
def tokenize_spaced(spark: SparkSession, d: str) -> DataFrame:
    """White-space words with their case, as the reranked mode takes them."""
    t = V.table(spark, d, "documents").select("doc_id", space_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"WITH {V.CHUNKS}, {V.QUERIES}, {bm25_ctes('queries', 'chunks', 20)} SELECT query_id, chunk_id, rank, score FROM bm25")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25_topk(V.queries(spark, d), V.chunks(spark, d), 20)


@query(f"WITH {V.CHUNKS}, {V.QUERIES}, {bm25_ctes('queries', 'chunks', 20)} SELECT query_id, chunk_id, rank, score FROM bm25")
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """From postings that are written once, with early stopping."""
    path = work_dir(spark, "postings")
    I.write_postings(V.chunks(spark, d), path)
    return I.bm25_stored(V.queries(spark, d), path, 20)


FUSED = f"""{dense_ctes('queries', 'vchunks', 20, 'cosine')}, {bm25_ctes('queries', 'vchunks', 20)},
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 9) AS fused FROM
  (SELECT query_id, chunk_id, rank, 0.65::DOUBLE AS w FROM dense UNION ALL SELECT query_id, chunk_id, rank, 0.35::DOUBLE FROM bm25) GROUP BY 1, 2))"""
SHARE = "round(coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')))) / len(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+'))), 0), 9)"
RERANKED = f"{FUSED}, over AS (SELECT f.query_id, f.chunk_id, f.rank AS fused_rank, {SHARE.format(c='c.text')} AS overlap FROM fused f JOIN queries q USING (query_id) JOIN vchunks c USING (chunk_id)), ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, fused_rank) AS rank FROM over)"


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, c = V.queries(spark, d), V.vector_chunks(spark, d)
    return q, c, S.rrf_fuse((S.dense_topk(q, c, 20), 0.65), (S.bm25_topk(q, c, 20), 0.35))


@query(f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {FUSED} SELECT query_id, chunk_id, fused, rank FROM fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)[2].select("query_id", "chunk_id", "fused", "rank")


@query(f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {RERANKED} SELECT query_id, chunk_id, fused_rank, overlap, rank FROM ordered WHERE rank <= 20")
def overlap_rerank(spark: SparkSession, d: str) -> DataFrame:
    q, c, fused = _fused(spark, d)
    return S.overlap_rerank(fused, q, c, 20).select("query_id", "chunk_id", "fused_rank", "overlap", "rank")


@query(f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {RERANKED} SELECT query_id, chunk_id, rank, overlap, fused_rank, round((rank - 1) / rank, 9) AS distance, CASE WHEN ticker IN (SELECT ticker FROM vchunks) THEN 'hybrid' ELSE 'dense_fallback' END AS mode FROM ordered JOIN queries USING (query_id) WHERE rank <= 5")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return S.hybrid_search(V.queries(spark, d), V.vector_chunks(spark, d)).withColumn("distance", F.round("distance", 9))


@query(f"WITH {V.CHUNKS}, vchunks AS (SELECT c.* REPLACE (CASE WHEN ticker NOT IN ('SRC3', 'SRC8', 'SRC13', 'SRC18') THEN text END AS text), e.embedding FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.doc_id), {V.QUERIES}, {RERANKED} SELECT query_id, chunk_id, rank, overlap, fused_rank, CASE WHEN ticker IN (SELECT ticker FROM vchunks WHERE text IS NOT NULL) THEN 'hybrid' ELSE 'dense_fallback' END AS mode FROM ordered JOIN queries USING (query_id) WHERE rank <= 5")
def hybrid_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search where the chunks of some tickers have no text."""
    c = V.vector_chunks(spark, d).withColumn("text", F.expr("case when ticker not in ('SRC3', 'SRC8', 'SRC13', 'SRC18') then text end"))
    return S.hybrid_search(V.queries(spark, d), c).select("query_id", "chunk_id", "rank", "overlap", "fused_rank", "mode")


def _merged(pad: bool = False) -> str:
    return f"""{dense_ctes('wq', 'vchunks', 30, 'cosine')}, {bm25_ctes('wq', 'vchunks', 30, SPACED, pad)}, merged AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, d.rank AS dense_rank, b.rank AS bm25_rank,
  least(coalesce(d.rank, 10000), coalesce(b.rank, 10000)) AS best_rank, concat_ws(',', CASE WHEN d.rank IS NOT NULL THEN 'dense' END, CASE WHEN b.rank IS NOT NULL THEN 'bm25' END) AS sources
  FROM dense d FULL OUTER JOIN bm25 b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id)"""


@query(f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {V.WORDED}, {_merged()} SELECT * FROM merged")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    q, c = V.worded_queries(spark, d), V.vector_chunks(spark, d)
    return S.merge_candidates(S.dense_topk(q, c, 30), S.bm25_topk(q, c, 30, split=space_tokens)).withColumn("sources", F.array_join("sources", ","))


def _priors(pad: bool = False) -> str:
    return f"""{_merged(pad)}, {intent_ctes('wq')}, prior AS (SELECT m.*, {SHARE.format(c='c.text[1:4000]')} AS reranker_score, CASE WHEN list_contains(target_sections, c.section_key) THEN 0.2 ELSE 0 END::DOUBLE AS section_prior,
  least(0.15, round(0.03 * len(list_filter(matched_tokens, lambda x: contains({normal('c.text')}, x))), 9))::DOUBLE AS keyword_prior FROM merged m JOIN wq q USING (query_id) JOIN intent USING (query_id) JOIN vchunks c USING (chunk_id))"""


@query(f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {V.WORDED}, {_priors()} SELECT query_id, chunk_id, reranker_score FROM prior")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    q, c = V.worded_queries(spark, d), V.vector_chunks(spark, d)
    return S.rerank(S.merge_candidates(S.dense_topk(q, c, 30), S.bm25_topk(q, c, 30, split=space_tokens)), q, c).select("query_id", "chunk_id", "reranker_score")


@query(f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {V.WORDED}, {_priors(pad=True)} SELECT query_id, chunk_id, section_prior, keyword_prior FROM prior")
def rerank_priors(spark: SparkSession, d: str) -> DataFrame:
    q, c = V.worded_queries(spark, d), V.vector_chunks(spark, d)
    rows = S.merge_candidates(S.dense_topk(q, c, 30), S.bm25_topk(q, c, 30, split=space_tokens, pad=True))
    return S.priors(rows, q, S.section_intent(q), c).select("query_id", "chunk_id", "section_prior", "keyword_prior")


@query(f"""WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {V.WORDED}, {_priors()}, final AS (SELECT *, round(reranker_score + section_prior + keyword_prior, 6) AS final_score FROM prior)
SELECT query_id, chunk_id, rank, dense_rank, bm25_rank, final_score, sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, best_rank, chunk_id) AS rank FROM final) WHERE rank <= 5""")
def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    out = S.reranked_search(V.worded_queries(spark, d), V.vector_chunks(spark, d))
    return out.select("query_id", "chunk_id", "rank", "dense_rank", "bm25_rank", "final_score", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {V.CHUNKS}, entities AS (SELECT DISTINCT ticker AS entity_id, ticker, lower(ticker) || ' the and of' AS name FROM chunks),
mq AS (SELECT entity_id, ticker, i AS query_no, entity_id || '#' || i AS query_id, name || [' business description overview', ' risk factors challenges', ' financial performance revenue', ' competition market position'][i + 1] AS text FROM entities, range(4) t(i)),
{bm25_ctes('mq', 'chunks', 3)},
first AS (SELECT * FROM (SELECT q.entity_id, q.query_no, b.chunk_id, b.score, row_number() OVER (PARTITION BY q.entity_id, md5(c.text[1:100]) ORDER BY q.query_no, b.rank) AS n FROM bm25 b JOIN mq q USING (query_id) JOIN chunks c USING (chunk_id)) WHERE n = 1)
SELECT entity_id, chunk_id, query_no, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, chunk_id) AS rank FROM first) WHERE rank <= 10""")
def multi_query_retrieve(spark: SparkSession, d: str) -> DataFrame:
    c = V.chunks(spark, d)
    names = c.select("ticker").distinct().select(F.col("ticker").alias("entity_id"), "ticker", F.concat(F.lower("ticker"), F.lit(" the and of")).alias("name"))
    return S.multi_query(names, c).select("entity_id", "chunk_id", "query_no", "score", "rank")


PACKETS = f"""{bm25_ctes('queries', 'chunks', 5)}, packets AS (SELECT b.query_id, b.rank, c.ticker, c.text, c.chunk_id, c.filing_type, c.filing_date, c.section_name, b.score AS retrieval_score, 'bm25' AS retrieval_method FROM bm25 b JOIN chunks c USING (chunk_id))"""


def _packets(spark: SparkSession, d: str) -> DataFrame:
    c = V.chunks(spark, d)
    return E.packets(S.bm25_topk(V.queries(spark, d), c, 5).withColumnRenamed("score", "relevance"), c, "bm25")


@query(f"WITH {V.CHUNKS}, {V.QUERIES}, {PACKETS} SELECT * FROM packets")
def evidence_packets(spark: SparkSession, d: str) -> DataFrame:
    return _packets(spark, d)


@query(f"WITH {V.CHUNKS}, {V.QUERIES}, {PACKETS} SELECT * FROM packets")
def bm25_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: best evidence for every benchmark question."""
    return _packets(spark, d)


@query(f"""WITH {V.CHUNKS}, {V.QUERIES}, {PACKETS} SELECT query_id, string_agg('[Ticker: ' || ticker || ' | Section: ' || section_name || ' | Filing: ' || filing_type || ' | Filed: ' || filing_date || ' | Rank: ' || rank || ' | Score: ' || printf('%.3f', retrieval_score + 1e-9) || ']' || chr(10) || {V.sql_strip('text[1:700]')}, chr(10) || chr(10) ORDER BY rank) AS context FROM packets GROUP BY 1""")
def render_context(spark: SparkSession, d: str) -> DataFrame:
    return E.render_context(_packets(spark, d))


@query(f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {RERANKED} SELECT o.query_id, o.chunk_id, o.rank, d.rank AS dense_rank, d.distance AS dense_distance, b.rank AS bm25_rank, b.score AS bm25_score, round((o.rank - 1) / o.rank, 9) AS distance, 'hybrid' AS method FROM ordered o LEFT JOIN dense d ON d.query_id = o.query_id AND d.chunk_id = o.chunk_id LEFT JOIN bm25 b ON b.query_id = o.query_id AND b.chunk_id = o.chunk_id WHERE o.rank <= 5")
def hit_provenance(spark: SparkSession, d: str) -> DataFrame:
    q, c, _ = _fused(spark, d)
    out = E.provenance(S.hybrid_search(q, c), S.dense_topk(q, c, 20), S.bm25_topk(q, c, 20), "hybrid")
    return out.withColumn("distance", F.round("distance", 9))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'q' || doc_id END, nullif(concat_ws(' ', CASE WHEN doc_id % 3 = 1 THEN upper(source) END, CASE WHEN doc_id % 6 = 1 THEN lang END), ''), 'SEC filing') AS query FROM documents")
def default_query(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", default_query_text(F.expr("case when doc_id % 3 = 0 then 'q' || doc_id end"), F.expr("case when doc_id % 3 = 1 then upper(source) end"), F.expr("case when doc_id % 6 = 1 then lang end"), F.lit(None).cast("string")).alias("query"))
