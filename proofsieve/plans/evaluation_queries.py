"""Queries of evaluation, comparison, run log and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.functions import text as T
from proofsieve.operators import evaluate as X
from proofsieve.operators import runlog as R
from proofsieve.operators import search as S
from proofsieve.plans import views as V
from proofsieve.plans.grounding_queries import sql_words
from proofsieve.sources.filings import write_results
from proofsieve.streaming.streams import work_dir
from proofsieve.plans.sql import bm25_ctes, dense_ctes

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: Cases: benchmark items, with the sections and keywords expected by turns.
CASES = """cases AS (SELECT 'Q' || item_id AS case_id, 'SRC' || item_id % 20 AS ticker, text AS query,
  [['Risk Factors'], ['business', 'MD&A'], [], ['Market Risk', 'Legal']][item_id % 4 + 1]::VARCHAR[] AS expected_sections, [['the', 'zzz'], ['and', 'The'], [], ['of & in', 'on', ' ']][item_id % 4 + 1]::VARCHAR[] AS expected_keywords FROM benchmark),
prep AS (SELECT case_id, expected_sections, expected_keywords, list_distinct(list_transform(expected_sections, lambda x: CASE lower(x) WHEN 'risk factors' THEN 'risk_factors' WHEN 'md&a' THEN 'md&a' WHEN 'market risk' THEN 'market_risk' ELSE lower(x) END)) AS keys,
  list_filter(list_transform(expected_keywords, lambda x: replace(lower(trim(x)), '&', 'and')), lambda x: x <> '') AS words FROM cases)"""
PACKETS = f"""{dense_ctes('queries', 'vchunks', 5, 'cosine')}, {bm25_ctes('queries', 'vchunks', 5)}, packets AS (SELECT 'semantic' AS mode, query_id AS case_id, rank, c.section_name, c.section_key, c.text FROM dense JOIN vchunks c USING (chunk_id)
  UNION ALL SELECT 'hybrid', query_id, rank, c.section_name, c.section_key, c.text FROM bm25 JOIN vchunks c USING (chunk_id)), pk AS (SELECT p.*, replace(lower({V.sql_strip('text')}), '&', 'and') AS t FROM packets p WHERE mode = 'semantic')"""
FLAGS = "flags AS (SELECT p.mode, p.case_id, rank, list_contains(keys, section_key) OR len(list_filter(words, lambda w: contains(t, w))) > 0 AS relevant FROM pk p JOIN prep USING (case_id))"
BASE = f"WITH {V.VECTOR_CHUNKS}, {V.QUERIES}, {CASES}, {PACKETS}, {FLAGS}"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "benchmark").select(
        F.concat(F.lit("Q"), "item_id").alias("case_id"), F.concat(F.lit("SRC"), F.col("item_id") % 20).alias("ticker"), F.col("text").alias("query"),
        F.expr("array(array('Risk Factors'), array('business', 'MD&A'), cast(array() as array<string>), array('Market Risk', 'Legal'))[item_id % 4]").alias("expected_sections"),
        F.expr("array(array('the', 'zzz'), array('and', 'The'), cast(array() as array<string>), array('of & in', 'on', ' '))[item_id % 4]").alias("expected_keywords"),
    )


def _packets(spark: SparkSession, d: str, mode: str = "semantic") -> DataFrame:
    q, c = V.queries(spark, d), V.vector_chunks(spark, d)
    hits = S.dense_topk(q, c, 5) if mode == "semantic" else S.bm25_topk(q, c, 5)
    return hits.join(c, "chunk_id").select(F.col("query_id").alias("case_id"), "rank", "section_name", "text")


@query(f"{BASE} SELECT case_id, rank, relevant FROM flags")
def relevance_flags(spark: SparkSession, d: str) -> DataFrame:
    return X.relevance_flags(_cases(spark, d), _packets(spark, d))


RANKING = """per AS (SELECT case_id, count(*) FILTER (relevant) AS n, min(rank) FILTER (relevant) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (relevant), 0) AS dcg FROM flags GROUP BY 1)"""


@query(f"{BASE}, {RANKING} SELECT case_id, coalesce(n, 0) / 5 AS precision_at_5 FROM cases LEFT JOIN per USING (case_id)")
def precision_at_5(spark: SparkSession, d: str) -> DataFrame:
    return X.ranking_metrics(_cases(spark, d), _packets(spark, d)).select("case_id", F.col("precision").alias("precision_at_5"))


@query(f"{BASE}, {RANKING} SELECT case_id, round(coalesce(1 / first, 0), 9) AS mrr_at_5 FROM cases LEFT JOIN per USING (case_id)")
def mrr_at_5(spark: SparkSession, d: str) -> DataFrame:
    return X.ranking_metrics(_cases(spark, d), _packets(spark, d)).select("case_id", F.round("mrr", 9).alias("mrr_at_5"))


@query(f"{BASE}, {RANKING} SELECT case_id, round(CASE WHEN coalesce(n, 0) > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 9) AS ndcg_at_5 FROM cases LEFT JOIN per USING (case_id)")
def ndcg_at_5(spark: SparkSession, d: str) -> DataFrame:
    return X.ranking_metrics(_cases(spark, d), _packets(spark, d)).select("case_id", F.round("ndcg", 9).alias("ndcg_at_5"))


SEEN = "seen AS (SELECT case_id, list(DISTINCT section_key) AS seen, string_agg(t, ' ' ORDER BY rank) AS joined FROM pk GROUP BY 1)"


@query(f"{BASE}, {SEEN} SELECT case_id, round(CASE WHEN len(keys) + len(words) > 0 THEN (coalesce(len(list_intersect(keys, seen)), 0) + len(list_filter(words, lambda w: coalesce(contains(joined, w), false)))) / (len(keys) + len(words)) WHEN seen IS NOT NULL THEN 1 ELSE 0 END, 9) AS recall_at_5 FROM prep LEFT JOIN seen USING (case_id)")
def target_recall_at_5(spark: SparkSession, d: str) -> DataFrame:
    return X.target_recall(_cases(spark, d), _packets(spark, d)).select("case_id", F.round("recall", 9).alias("recall_at_5"))


@query(f"{BASE}, {SEEN} SELECT case_id, CASE WHEN len(keys) > 0 THEN coalesce(len(list_intersect(keys, seen)), 0) > 0 ELSE seen IS NOT NULL END AS section_hit, CASE WHEN len(keys) > 0 THEN coalesce(len(list_intersect(keys, seen)), 0) / len(keys) ELSE 1 END AS section_recall FROM prep LEFT JOIN seen USING (case_id)")
def section_recall(spark: SparkSession, d: str) -> DataFrame:
    return X.section_metrics(_cases(spark, d), _packets(spark, d))


MATCHED = """kw AS (SELECT case_id, i, k FROM (SELECT case_id, unnest(range(len(expected_keywords))) AS i, unnest(expected_keywords) AS k FROM prep)),
hit AS (SELECT DISTINCT kw.case_id, i, k FROM kw JOIN pk ON pk.case_id = kw.case_id AND trim(k) <> '' AND contains(t, replace(lower(trim(k)), '&', 'and'))),
mk AS (SELECT case_id, list(k ORDER BY i) AS matched, count(*) AS n FROM hit GROUP BY 1)"""


@query(f"{BASE}, {MATCHED} SELECT case_id, coalesce(array_to_string(matched, ','), '') AS matched, round(CASE WHEN len(expected_keywords) > 0 THEN coalesce(n, 0) / len(expected_keywords) ELSE 1 END, 9) AS hit_rate FROM prep LEFT JOIN mk USING (case_id)")
def keyword_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return X.matched_keywords(_cases(spark, d), _packets(spark, d)).select("case_id", F.array_join("matched", ",").alias("matched"), F.round("hit_rate", 9).alias("hit_rate"))


@query(f"""{BASE}, {MATCHED}, ok AS (SELECT pk.case_id, pk.rank FROM pk JOIN prep USING (case_id) LEFT JOIN mk USING (case_id) WHERE list_contains(list_transform(expected_sections, lambda x: replace(lower(x), '&', 'and')), replace(lower(section_name), '&', 'and'))
  OR len(list_filter(coalesce(matched, []), lambda w: contains(lower(text), lower(w)))) > 0) SELECT case_id, min(rank) AS first_rank FROM cases LEFT JOIN ok USING (case_id) GROUP BY 1""")
def first_relevant_rank(spark: SparkSession, d: str) -> DataFrame:
    return X.first_relevant_rank(_cases(spark, d), _packets(spark, d))


@query(f"{BASE}, {SEEN} SELECT case_id, len(expected_sections) = 0 OR coalesce(len(list_intersect(keys, seen)), 0) > 0 AND seen IS NOT NULL AS passed, concat_ws(',', CASE WHEN len(expected_sections) > 0 AND coalesce(len(list_intersect(keys, seen)), 0) = 0 THEN 'No expected sections found in top-k' END, CASE WHEN seen IS NULL THEN 'No chunks retrieved' END) AS issues FROM prep LEFT JOIN seen USING (case_id)")
def case_verdict(spark: SparkSession, d: str) -> DataFrame:
    return X.case_metrics(_cases(spark, d), _packets(spark, d)).select("case_id", "passed", F.array_join("issues", ",").alias("issues"))


@query(f"{BASE}, f AS (SELECT case_id, section_name, min(rank) AS r FROM pk GROUP BY 1, 2) SELECT case_id, string_agg(section_name, ',' ORDER BY r) AS sections FROM f GROUP BY 1")
def retrieved_sections(spark: SparkSession, d: str) -> DataFrame:
    return X.retrieved_sections(_packets(spark, d)).select("case_id", F.array_join("sections", ",").alias("sections"))


#: Results of four methods by rule over the labelled documents: one row a (mode, case).
RESULTS = """results AS (SELECT m.mode, CASE WHEN doc_id % 10 = 0 AND k = 1 THEN 'x' ELSE 'c' END || doc_id AS case_id, 'T' || doc_id % 5 AS ticker, quality = 1 OR k = 2 AS passed, ((doc_id * (k + 3)) % 11) / 10 AS precision_at_5, ((doc_id * (k + 5)) % 7) / 6 AS mrr_at_5,
  CASE WHEN (doc_id + k) % 4 <> 0 THEN (doc_id + k) % 5 + 1 END AS first_relevant_rank, 10.0::DOUBLE + (doc_id * (k + 1)) % 13 AS latency_ms, 5 AS top_k
  FROM (SELECT DISTINCT doc_id, quality FROM labels) l, (VALUES ('semantic', 0), ('section_aware', 1), ('hybrid', 2), ('reranked_hybrid', 3)) m(mode, k))"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    labels = V.table(spark, d, "labels").select("doc_id", "quality").distinct()
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(k).alias("k")) for k, m in enumerate(X.MODES)])).alias("m")
    rows = labels.select("doc_id", "quality", modes).select("doc_id", "quality", "m.mode", "m.k")
    i, k = F.col("doc_id"), F.col("k")
    return rows.select(
        "mode", F.concat(F.when((i % 10 == 0) & (k == 1), "x").otherwise("c"), i).alias("case_id"), F.concat(F.lit("T"), i % 5).alias("ticker"), ((F.col("quality") == 1) | (k == 2)).alias("passed"), ((i * (k + 3)) % 11 / 10).alias("precision_at_5"), ((i * (k + 5)) % 7 / 6).alias("mrr_at_5"),
        F.when((i + k) % 4 != 0, ((i + k) % 5 + 1).cast("int")).alias("first_relevant_rank"), (F.lit(10.0) + (i * (k + 1)) % 13).alias("latency_ms"), F.lit(5).alias("top_k"),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in columns})


@query(f"WITH {RESULTS} SELECT mode, ticker, count(*) AS total, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 8) AS pass_rate, round(avg(precision_at_5), 8) AS avg_precision_at_5, round(avg(mrr_at_5), 8) AS avg_mrr_at_5 FROM results GROUP BY ROLLUP (mode, ticker)")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    full = reduce(lambda df, m: df if m in df.columns else df.withColumn(m, F.lit(0.0)), X.AVERAGED, _results(spark, d))
    return _rounded(X.summarize(full, "mode", "ticker"), "pass_rate", "avg_precision_at_5", "avg_mrr_at_5").select("mode", "ticker", "total", "passed", "pass_rate", "avg_precision_at_5", "avg_mrr_at_5")


@query(f"WITH {RESULTS} SELECT mode, round(avg(precision_at_5), 8) AS precision_at_5, round(avg(mrr_at_5), 8) AS mrr_at_5, count(*) AS total FROM results GROUP BY 1")
def report_summary_rows(spark: SparkSession, d: str) -> DataFrame:
    """The results and their summary written by the report writer, and the summary made again of what it wrote."""
    path, rows = work_dir(spark, "report"), _results(spark, d)
    write_results(rows, rows.groupBy("mode").agg(F.count("*").alias("total")), path)
    totals = spark.read.parquet(f"{path}/summary")
    means = spark.read.parquet(f"{path}/results").groupBy("mode").agg(F.round(F.avg("precision_at_5"), 8).alias("precision_at_5"), F.round(F.avg("mrr_at_5"), 8).alias("mrr_at_5"))
    return means.hint("merge").join(totals.hint("merge"), "mode")


PAIR = f"WITH {RESULTS}, b AS (SELECT case_id FROM results WHERE mode = 'semantic'), c AS (SELECT case_id FROM results WHERE mode = 'section_aware')"


@query(f"{PAIR} SELECT case_id FROM b JOIN c USING (case_id)")
def paired_cases(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d)
    return X.pair_results(r.where("mode = 'semantic'"), r.where("mode = 'section_aware'")).where("side = 'both'").select("case_id")


@query(f"{PAIR} SELECT coalesce(b.case_id, c.case_id) AS case_id, CASE WHEN b.case_id IS NULL THEN 'candidate' ELSE 'baseline' END AS side FROM b FULL OUTER JOIN c USING (case_id) WHERE b.case_id IS NULL OR c.case_id IS NULL")
def unpaired_cases(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d)
    return X.pair_results(r.where("mode = 'semantic'"), r.where("mode = 'section_aware'")).where("side <> 'both'")


LONG = f"""WITH {RESULTS}, wide AS (SELECT mode, case_id, CASE WHEN passed THEN 1 ELSE 0 END::DOUBLE AS passed, precision_at_5, mrr_at_5, first_relevant_rank::DOUBLE AS first_relevant_rank, latency_ms, CASE WHEN first_relevant_rank IS NULL THEN 1 ELSE 0 END::DOUBLE AS miss_rate, first_relevant_rank::DOUBLE AS first_relevant_rank_mean_among_hits FROM results),
long AS (SELECT * FROM wide UNPIVOT (value FOR metric IN (passed, precision_at_5, mrr_at_5, first_relevant_rank, latency_ms, miss_rate, first_relevant_rank_mean_among_hits)))"""
PAIRS = """, pr AS (SELECT c.mode, c.case_id, c.metric, b.value AS b, c.value AS c FROM long c JOIN long b ON b.mode = 'semantic' AND b.case_id = c.case_id AND b.metric = c.metric WHERE c.mode <> 'semantic'),
pairs AS (SELECT * FROM pr UNION ALL SELECT mode, case_id, 'latency_ms_warm', b, c FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY case_id) AS n, count(*) OVER (PARTITION BY mode) AS a FROM pr WHERE metric = 'latency_ms') WHERE n > 1 OR a = 1)"""
LOWER = "('latency_ms', 'miss_rate', 'first_relevant_rank_mean_among_hits', 'latency_ms_warm', 'first_relevant_rank')"
COMPARED = f"""{LONG}{PAIRS} SELECT mode, metric, round(avg(b), 8) AS baseline_mean, round(avg(c), 8) AS candidate_mean, round(avg(c - b), 8) AS paired_delta, round(CASE WHEN abs(avg(b)) > 1e-9 THEN avg(c - b) / avg(b) END, 8) AS relative_delta,
count(*) FILTER (CASE WHEN metric IN {LOWER} THEN b - c ELSE c - b END > 1e-9) AS wins, count(*) FILTER (abs(c - b) <= 1e-9) AS ties, count(*) FILTER (CASE WHEN metric IN {LOWER} THEN b - c ELSE c - b END < -1e-9) AS losses, count(*) AS shared_count FROM pairs GROUP BY 1, 2"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    return X.metric_long(_results(spark, d).drop("ticker"), ["mode", "case_id"])


@query(f"{LONG} SELECT mode, case_id, metric, round(value, 9) AS value FROM long")
def metric_long(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).withColumn("value", F.round("value", 9))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(X.compare(_long(spark, d), "semantic"), "baseline_mean", "candidate_mean", "paired_delta", "relative_delta")


@query(f"SELECT mode, metric, baseline_mean, candidate_mean, paired_delta, relative_delta, shared_count FROM ({COMPARED})")
def compare_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("mode", "metric", "baseline_mean", "candidate_mean", "paired_delta", "relative_delta", "shared_count")


@query(f"SELECT mode, metric, wins, ties, losses FROM ({COMPARED})")
def win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("mode", "metric", "wins", "ties", "losses")


@query(COMPARED)
def method_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)


@query(f"""{LONG}{PAIRS}, cases AS (SELECT DISTINCT case_id FROM pairs), u AS (SELECT case_id, 4 * block + k AS b, CAST('0x' || md5('13:' || block || ':' || case_id)[8 * k + 1:8 * k + 8] AS BIGINT) AS u FROM cases, range(500) t(block), range(4) r(k)),
drawn AS (SELECT case_id, b, {' + '.join(f'(u >= {least})::INTEGER' for least in X.DRAWN)} AS times FROM u),
means AS (SELECT mode, metric, sample, round(sum((c - p.b) * times) / sum(times), 9) AS m FROM (SELECT mode, metric, case_id, b, c FROM pairs) p JOIN (SELECT case_id, b AS sample, times FROM drawn WHERE times > 0) d USING (case_id) GROUP BY mode, metric, sample)
SELECT mode, metric, list_sort(list(m))[1 + CAST(floor(0.025 * (len(list(m)) - 1)) AS INTEGER)] AS ci_low, list_sort(list(m))[1 + CAST(floor(0.975 * (len(list(m)) - 1)) AS INTEGER)] AS ci_high FROM means GROUP BY 1, 2""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return X.bootstrap_ci(X.paired(_long(spark, d), "semantic"))


@query("SELECT 'c' || doc_id AS case_id, CASE WHEN doc_id % 9 = 0 THEN 'semantic' ELSE 'hybrid' END AS mode, concat_ws(',', CASE WHEN doc_id % 4 <> 0 THEN 'bm25' END, CASE WHEN doc_id % 3 = 0 THEN 'dense' END) AS methods FROM labels WHERE doc_id % 9 = 0 OR NOT (doc_id % 3 = 0)")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = V.table(spark, d, "labels").select(F.concat(F.lit("c"), i).alias("case_id"), F.when(i % 9 == 0, "semantic").otherwise("hybrid").alias("mode"), F.when(i % 4 != 0, "bm25").alias("method"), F.array(F.when(i % 3 == 0, "dense"), F.when(i % 4 != 0, "bm25")).alias("packet_methods"))
    return X.contract_violations(rows, "hybrid", "dense").withColumn("methods", F.array_join("methods", ","))


RULES = """c AS (SELECT 'src' || item_id % 3 || '_' || item_id AS case_id, CASE WHEN item_id % 4 = 0 THEN 'toolong' ELSE 'src' END AS ticker, text || CASE WHEN item_id % 2 = 0 THEN '?' ELSE '' END AS query, item_id FROM benchmark)"""


@query(f"""WITH {RULES} SELECT case_id, concat_ws(',', CASE WHEN ticker = 'toolong' THEN 'ticker' END, 'prefix', CASE WHEN len(list_filter(regexp_split_to_array(query, '{V.SPACE}+'), lambda x: x <> '')) < 5 THEN 'query words' END, CASE WHEN item_id % 2 <> 0 THEN 'query question' END,
CASE WHEN item_id % 5 = 0 THEN 'sections' END, CASE WHEN item_id % 7 = 0 THEN 'keywords' END, CASE WHEN item_id % 25 NOT BETWEEN 1 AND 20 THEN 'top_k' END) AS violations FROM c""")
def validate_cases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    rows = V.table(spark, d, "benchmark").select(
        F.concat(F.lit("src"), i % 3, F.lit("_"), i).alias("case_id"), F.when(i % 4 == 0, "toolong").otherwise("src").alias("ticker"), F.concat("text", F.when(i % 2 == 0, "?").otherwise("")).alias("query"),
        F.when(i % 5 == 0, F.array(F.lit("unheard"))).otherwise(F.array(F.lit("business"))).alias("expected_sections"), F.when(i % 7 == 0, F.array(F.lit("aa"), F.lit("AA "))).otherwise(F.array(F.lit("aa"), F.lit("bb"))).alias("expected_keywords"), (i % 25).cast("int").alias("top_k"),
    )
    return X.validate_cases(rows).withColumn("violations", F.array_join("violations", ","))


CASE_ROWS = "cr AS (SELECT 'c' || doc_id AS case_id, upper(source) AS ticker, CASE WHEN source = 'src1' THEN 'business' ELSE ['business', 'risk_factors', 'md&a', 'market_risk'][doc_id % 4 + 1] END AS section FROM documents)"


def _case_rows(spark: SparkSession, d: str) -> DataFrame:
    c = V.chunks(spark, d)
    return c.select(F.concat(F.lit("c"), "doc_id").alias("case_id"), "ticker", F.array(F.when(F.col("ticker") == "SRC1", "business").otherwise(F.col("section_key"))).alias("expected_sections"))


@query(f"""WITH {CASE_ROWS}, grid AS (SELECT * FROM (SELECT DISTINCT ticker FROM cr), (VALUES ('business'), ('risk_factors'), ('md&a'), ('market_risk')) s(section))
SELECT 'count' AS rule, CAST(count(*) AS VARCHAR) AS subject FROM cr HAVING count(*) NOT BETWEEN 50 AND 100 UNION ALL SELECT 'missing section', ticker || '/' || section FROM grid WHERE (ticker, section) NOT IN (SELECT (ticker, section) FROM cr)""")
def validate_set(spark: SparkSession, d: str) -> DataFrame:
    return X.validate_set(_case_rows(spark, d))


@query(f"WITH {CASE_ROWS} SELECT ticker, section, count(*) AS n FROM cr GROUP BY GROUPING SETS ((ticker), (section))")
def case_distribution(spark: SparkSession, d: str) -> DataFrame:
    return X.distribution(_case_rows(spark, d))


@query("SELECT 'Q' || item_id AS case_id, mode FROM benchmark, (VALUES ('semantic'), ('section_aware'), ('hybrid'), ('reranked_hybrid')) m(mode)")
def method_matrix_cases(spark: SparkSession, d: str) -> DataFrame:
    return X.method_matrix_cases(_cases(spark, d).withColumn("mode", F.lit("query")), X.MODES).select("case_id", "mode")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'semantic' WHEN 1 THEN 'section_aware' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'reranked_hybrid' END AS mode FROM documents")
def normalize_mode(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", X.normalize_mode(F.expr("array(' Query', 'section-aware', 'QDRANT_hybrid', 'hybrid_rerank', 'other')[doc_id % 5]")).alias("mode"))


@query(rf"SELECT doc_id, md5(replace(lower({V.sql_strip('text')}), '&', 'and')) AS text_md5 FROM documents")
def eval_normalize(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.eval_normalize("text")).alias("text_md5"))


@query("SELECT 'Q' || item_id AS case_id FROM benchmark ORDER BY item_id LIMIT 10")
def select_cases(spark: SparkSession, d: str) -> DataFrame:
    """The first ten cases: the limit is what this operator does."""
    return X.select_cases(_cases(spark, d).withColumn("pos", F.substring("case_id", 2, 9).cast("int")), limit=10).select("case_id")


JUDGED = "j AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS judge, CASE WHEN doc_id % 3 = 0 THEN 'faith' ELSE 'relevance' END AS metric, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 11) / 10 END AS score, CASE WHEN doc_id % 7 = 0 THEN 'failed' END AS error FROM labels)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return V.table(spark, d, "labels").select("doc_id", F.when(i % 2 == 0, "a").otherwise("b").alias("judge"), F.when(i % 3 == 0, "faith").otherwise("relevance").alias("metric"), F.when(i % 7 != 0, i % 11 / 10).alias("score"), F.when(i % 7 == 0, "failed").alias("error"))


@query(f"WITH {JUDGED} SELECT judge || '.' || metric AS judge_metric, round(avg(score), 8) AS mean, count(score) AS n, count(error) AS errors FROM j GROUP BY 1")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(X.judge_summary(_judged(spark, d)), "mean")


@query(f"WITH {JUDGED} SELECT doc_id, score >= 0.7 AS passed FROM j")
def judge_pass(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("doc_id", X.judge_pass("score").alias("passed"))


@query(f"SELECT source, count(*) FILTER ({V.sql_strip('text')} <> '') AS n, sum(least(length(text), 2500)) FILTER ({V.sql_strip('text')} <> '')::BIGINT AS chars FROM documents GROUP BY 1")
def truncate_contexts(spark: SparkSession, d: str) -> DataFrame:
    kept = V.table(spark, d, "documents").select("source", X.truncate_contexts(F.array("text")).alias("c")).select("source", F.explode("c").alias("t"))
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))


@query(f"""WITH {V.MEMOS}, {V.EVIDENCE}, ctx AS (SELECT memo_id, flatten(list({sql_words('text')})) AS w FROM evidence GROUP BY 1), said AS (SELECT memo_id, list_distinct({sql_words('text')}) AS w FROM memos)
SELECT CAST(memo_id AS VARCHAR) AS case_id, 'faithfulness' AS metric, round(CASE WHEN len(said.w) > 0 THEN len(list_intersect(said.w, ctx.w)) / len(said.w) ELSE 0 END, 9)::DOUBLE AS score, CAST(NULL AS VARCHAR) AS error FROM said JOIN ctx USING (memo_id)""")
def score_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = V.evidence(spark, d).groupBy("memo_id").agg(F.array_sort(F.collect_list("text")).alias("retrieval_context")).join(V.memos(spark, d), "memo_id")
    out = X.score_samples(rows.select(F.col("memo_id").cast("string").alias("case_id"), F.col("text").alias("actual_output"), "retrieval_context"), ["faithfulness"])
    return out.withColumn("score", F.round("score", 9))


#: Events as run transitions: the type gives the status, the user is the job.
STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'running' ELSE 'pending' END"
RUNS = f"runs AS (SELECT event_id, user_id AS job_id, ts, {STATUS} AS status, 'e' || event_id AS error FROM events)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), "ts", F.expr(STATUS).alias("status"), F.concat(F.lit("e"), "event_id").alias("error"))


LATEST = f"WITH {RUNS}, last AS (SELECT job_id, status, ts, CASE WHEN status <> 'completed' THEN error END AS error FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n FROM runs) WHERE n = 1)"


@query(f"{LATEST} SELECT job_id, status, CAST(ts AS VARCHAR) AS ts, error FROM last")
def latest_run_state(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_run_state(_runs(spark, d)).withColumn("ts", F.col("ts").cast("string"))


@query(f"{LATEST} SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in R.STATUSES)} FROM last")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.run_stats(R.latest_run_state(_runs(spark, d)))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(text) > 0 THEN 'completed' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM documents")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    errors = F.when(i % 3 == 1, F.array(F.struct(F.lit(False).alias("recoverable")), F.struct((i % 2 == 0).alias("recoverable"))))
    return V.table(spark, d, "documents").select("doc_id", R.run_status(F.when(i % 3 == 0, F.col("text")), errors).alias("status"))


@query("SELECT DISTINCT user_id AS run_id FROM events WHERE event_type = 'error'")
def fatal_runs(spark: SparkSession, d: str) -> DataFrame:
    return R.fatal_runs(V.table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("event_type") != "error").alias("recoverable")))


@query("SELECT event_type, user_id % 10 AS endpoint, count(*) AS n FROM events GROUP BY 1, 2")
def request_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.counts(V.table(spark, d, "events").withColumn("endpoint", F.col("user_id") % 10), "event_type", "endpoint")


HIST = "h AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (VALUES (0.1), (0.5), (1.0), (2.0), (5.0), (10.0), (30.0), (60.0), (120.0), ('inf'::DOUBLE)) b(le) GROUP BY 1, 2)"


@query(f"WITH {HIST} SELECT event_type, CAST(le AS VARCHAR) AS le, n FROM h")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = R.latency_histogram(V.table(spark, d, "events"), "event_type", "value")
    return h.withColumn("le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")))


@query(f"""WITH {HIST}, r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY event_type) AS total FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS k FROM r WHERE n >= 0.95 * total AND total > 0) SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE coalesce(lo + (le - lo) * (0.95 * total - below) / nullif(n - below, 0), lo) END, 8) AS value FROM f WHERE k = 1""")
def histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.histogram_quantile(R.latency_histogram(V.table(spark, d, "events"), "event_type", "value"), "event_type", 0.95), "value")


@query("SELECT event_id, sum(CASE WHEN event_type IN ('error', 'purchase') THEN -1 ELSE 1 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS active FROM events")
def active_runs(spark: SparkSession, d: str) -> DataFrame:
    """The gauge over all time."""
    e = V.table(spark, d, "events").withColumn("delta", F.when(F.col("event_type").isin("error", "purchase"), -1).otherwise(1))
    return R.active_runs(e).select("event_id", "active")


@query("SELECT event_id, sum(CASE WHEN event_type IN ('error', 'purchase') THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS active FROM events")
def active_runs_by_user(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").withColumn("delta", F.when(F.col("event_type").isin("error", "purchase"), -1).otherwise(1))
    return R.active_runs(e, "user_id").select("event_id", "active")


@query(f"{LATEST} SELECT 'SRC' || job_id % 20 AS ticker, status, count(*) AS n FROM last GROUP BY 1, 2")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.run_counts(R.latest_run_state(_runs(spark, d)).withColumn("ticker", F.concat(F.lit("SRC"), F.col("job_id") % 20)))


@query("SELECT event_type AS component, count(*) AS n, count(*) FILTER (value > 100) AS fatal FROM events WHERE event_type = 'error' OR value > 100 GROUP BY 1")
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").where("event_type = 'error' or value > 100")
    return R.error_counts(e.select(F.col("event_type").alias("component"), (~F.coalesce(F.col("value") > 100, F.lit(False))).alias("recoverable")))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM events")
def event_rate(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return R.trailing_count(e, "event_type", 86_400).select("event_id", "n")


@query("SELECT event_type, CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, count(*) AS n, round(count(*) / 3600, 9) AS rate FROM events GROUP BY 1, 2")
def rate_windows(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.rate_windows(e, "event_type", "1 hour").select("event_type", F.col("start").cast("string").alias("start"), "n", F.round("rate", 9).alias("rate"))


@query(f"{LATEST} SELECT job_id, status, error FROM last WHERE job_id IN (SELECT item_id FROM benchmark)")
def get_runs(spark: SparkSession, d: str) -> DataFrame:
    ids = V.table(spark, d, "benchmark").select(F.col("item_id").alias("job_id"))
    return R.get_runs(R.latest_run_state(_runs(spark, d)), ids).select("job_id", "status", "error")
