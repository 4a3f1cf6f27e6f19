"""Queries of grounding, citations, sentiment and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.functions import text as T
from proofsieve.functions.terms import CLAIM_HINTS, STOP_WORDS
from proofsieve.operators import evidence as E
from proofsieve.operators import grounding as G
from proofsieve.operators import sentiment as N
from proofsieve.plans import views as V

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


SPACE, strip = V.SPACE, V.sql_strip


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_words(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9][A-Za-z0-9&''\\-/]*'), lambda w: lower(w)), lambda w: NOT list_contains({sql_list(STOP_WORDS)}, w) AND length(w) > 1)"


def sql_numbers(x: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({x}, '\$?[0-9][0-9,]*(?:\.[0-9]+)?%?'), lambda w: replace(w, ',', '')))"


def sql_sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({x}, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def sql_cited(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '\[([0-9]+)\]', 1), lambda w: CAST(w AS INTEGER))"


CLAIMS = rf"""sents AS (SELECT memo_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT memo_id, {sql_sentences('text')} AS s FROM memos)),
claims AS (SELECT memo_id, pos, sentence, {strip(rf"regexp_replace(regexp_replace(sentence, '\[([0-9]+)\]', '', 'g'), '{SPACE}+', ' ', 'g')")} AS claim, {sql_cited('sentence')} AS citations FROM sents
  WHERE sentence NOT LIKE '#%' AND len({sql_words('sentence')}) >= 3 AND (len({sql_numbers('sentence')}) > 0 OR list_has_any({sql_words('sentence')}, {sql_list(CLAIM_HINTS)}))),
feat AS (SELECT *, list_distinct({sql_words('claim')}) AS words, {sql_numbers('claim')} AS figures FROM claims),
src AS (SELECT memo_id, "index", list_distinct({sql_words('text')}) AS e_words, {sql_numbers('text')} AS e_figures FROM evidence),
cited AS (SELECT f.memo_id, f.pos, f.place, CASE WHEN len(words) > 0 THEN len(list_intersect(words, e_words)) / len(words) ELSE 0 END AS overlap, len(list_filter(figures, lambda x: NOT list_contains(e_figures, x))) = 0 AS fits
  FROM (SELECT memo_id, pos, words, figures, unnest(citations) AS i, unnest(range(len(citations))) AS place FROM feat) f JOIN src s ON s.memo_id = f.memo_id AND s."index" = f.i),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memo_id, pos ORDER BY overlap DESC, place) AS n FROM cited WHERE overlap > 0) WHERE n = 1),
assessed AS (SELECT f.memo_id, f.pos, f.claim, f.citations, coalesce(b.overlap, 0.0) AS overlap_score, len(f.citations) > 0 AND coalesce(b.overlap, 0) >= 0.2 AND coalesce(b.fits, false) AS supported, len(f.citations) = 0 AS missing_citation,
  CASE WHEN len(f.citations) = 0 THEN 'claim is missing a citation' WHEN coalesce(b.overlap, 0) >= 0.2 AND coalesce(b.fits, false) THEN NULL WHEN len(figures) > 0 AND NOT coalesce(b.fits, false) THEN 'claim numbers do not match cited evidence' ELSE 'claim does not align with cited evidence' END AS reason
  FROM feat f LEFT JOIN best b ON b.memo_id = f.memo_id AND b.pos = f.pos)"""


@query(f"SELECT doc_id, len({sql_sentences('text')}) AS n, md5(array_to_string({sql_sentences('text')}, '|')) AS pieces_md5 FROM documents")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").select("doc_id", T.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("pieces_md5"))


@query(f"SELECT doc_id, len({sql_words('text')}) AS n, md5(array_to_string({sql_words('text')}, ' ')) AS words_md5 FROM documents")
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").select("doc_id", T.content_tokens("text").alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query(f"SELECT doc_id, array_to_string(list_sort({sql_numbers('text')}), ' ') AS numbers FROM documents")
def extract_numbers(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.numbers("text")), " ").alias("numbers"))


@query(f"WITH {V.MEMOS}, {V.EVIDENCE}, {CLAIMS} SELECT memo_id, pos, claim, array_to_string(citations, ',') AS citations FROM claims")
def claim_sentences(spark: SparkSession, d: str) -> DataFrame:
    return G.claim_sentences(V.memos(spark, d)).select("memo_id", "pos", "claim", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"))


@query(rf"WITH {V.MEMOS} SELECT memo_id, {strip(rf'''regexp_replace(regexp_replace(text, '\[([0-9]+)\]', '', 'g'), '{SPACE}+', ' ', 'g')''')} AS claim, array_to_string({sql_cited('text')}, ',') AS citations FROM memos")
def claim_citations(spark: SparkSession, d: str) -> DataFrame:
    return V.memos(spark, d).select("memo_id", T.strip_citations("text").alias("claim"), F.array_join(T.citations("text").cast("array<string>"), ",").alias("citations"))


@query(f"WITH {V.MEMOS} SELECT memo_id, array_to_string(list_sort(list_distinct({sql_cited('text')})), ',') AS used FROM memos")
def used_citations(spark: SparkSession, d: str) -> DataFrame:
    return G.used_citations(V.memos(spark, d)).withColumn("used", F.array_join(F.col("used").cast("array<string>"), ","))


@query(f"WITH {V.MEMOS}, {V.EVIDENCE}, u AS (SELECT DISTINCT memo_id, i FROM (SELECT memo_id, unnest({sql_cited('text')}) AS i FROM memos)) SELECT u.memo_id, u.i AS \"index\" FROM u ANTI JOIN evidence e ON e.memo_id = u.memo_id AND e.\"index\" = u.i")
def orphan_citations(spark: SparkSession, d: str) -> DataFrame:
    return G.orphan_citations(V.memos(spark, d), V.evidence(spark, d))


@query(f"WITH {V.MEMOS}, {V.EVIDENCE}, {CLAIMS} SELECT memo_id, pos, claim, round(overlap_score, 9) AS overlap_score, supported, missing_citation, reason FROM assessed")
def assess_claims(spark: SparkSession, d: str) -> DataFrame:
    return G.assess_claims(V.memos(spark, d), V.evidence(spark, d)).withColumn("overlap_score", F.round("overlap_score", 9)).drop("citations")


@query(f"""WITH {V.MEMOS}, {V.EVIDENCE}, {CLAIMS}, per AS (SELECT memo_id, count(*) AS total, count(*) FILTER (NOT missing_citation) AS cited, count(*) FILTER (supported) AS grounded FROM assessed GROUP BY 1),
orph AS (SELECT DISTINCT u.memo_id, u.i FROM (SELECT memo_id, unnest({sql_cited('text')}) AS i FROM memos) u ANTI JOIN evidence e ON e.memo_id = u.memo_id AND e."index" = u.i), o AS (SELECT memo_id, string_agg(i, ',' ORDER BY i) AS orphans FROM orph GROUP BY 1),
r AS (SELECT m.memo_id, coalesce(total, 0) AS total, coalesce(cited, 0) AS cited, coalesce(grounded, 0) AS grounded, coalesce(orphans, '') AS orphans FROM memos m LEFT JOIN per USING (memo_id) LEFT JOIN o USING (memo_id))
SELECT *, round(CASE WHEN total > 0 THEN cited / total ELSE 0 END, 9) AS coverage, round(CASE WHEN cited > 0 THEN grounded / cited ELSE 0 END, 9) AS grounded_rate, total > 0 AND cited > 0 AND cited / total >= 0.8 AND grounded / cited >= 0.75 AND orphans = '' AS passed FROM r""")
def memo_verdict(spark: SparkSession, d: str) -> DataFrame:
    out = G.memo_verdict(V.memos(spark, d), V.evidence(spark, d))
    return out.withColumn("orphans", F.array_join(F.col("orphans").cast("array<string>"), ",")).withColumn("coverage", F.round("coverage", 9)).withColumn("grounded_rate", F.round("grounded_rate", 9))


@query(f"""SELECT doc_id, coalesce(nullif({strip("regexp_replace(" + strip("split_part(string_split(t, 'Executive Summary')[2], chr(10) || chr(10), 1)") + ", '^#+|#+$', '', 'g')")}[1:500], ''), 'Analysis completed for ' || source) AS summary
FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '# Executive Summary #' || chr(10) || text || chr(10) || chr(10) || 'Rest' ELSE text END AS t FROM documents)""")
def executive_summary(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Executive Summary #\n"), F.col("text"), F.lit("\n\nRest"))).otherwise(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", G.executive_summary(t, "source").alias("summary"))


@query(rf"""WITH q AS (SELECT doc_id AS memo_id, length(trim(text)) >= 0 AS x, len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '')) < 200 AS a, NOT contains(upper(text), upper(source)) AS b,
 len(list_filter(['summary', 'overview', 'risk', 'financial', 'conclusion'], lambda s: contains(lower(text), s))) < 3 AS c, NOT (contains(text, '[1]') OR contains(text, 'Source:')) AS e, len(regexp_extract_all(text, '\$[0-9,]+|[0-9]+%')) < 3 AS f FROM documents)
SELECT memo_id, round(greatest(0, 1 - CASE WHEN a THEN 0.3 ELSE 0 END - CASE WHEN b THEN 0.2 ELSE 0 END - CASE WHEN c THEN 0.2 ELSE 0 END - CASE WHEN e THEN 0.1 ELSE 0 END - CASE WHEN f THEN 0.1 ELSE 0 END), 4)::DOUBLE AS score,
concat_ws(',', CASE WHEN a THEN 'short' END, CASE WHEN b THEN 'ticker missing' END, CASE WHEN c THEN 'sections' END, CASE WHEN e THEN 'no citations' END, CASE WHEN f THEN 'few numbers' END) AS issues FROM q""")
def memo_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("memo_id"), F.col("source").alias("ticker"), "text")
    return G.memo_quality(docs).withColumn("issues", F.array_join("issues", ","))


@query("""SELECT doc_id, round(comp, 9) AS completeness, round((quality + comp + coalesce(toxic, 0)) / CASE WHEN toxic IS NULL THEN 2 ELSE 3 END, 9) AS overall, (quality + comp + coalesce(toxic, 0)) / CASE WHEN toxic IS NULL THEN 2 ELSE 3 END >= 0.6 AND has_memo AS passed
FROM (SELECT doc_id, quality::DOUBLE AS quality, CASE WHEN doc_id % 2 = 0 THEN toxic END::DOUBLE AS toxic, doc_id % 5 <> 0 AS has_memo, (CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END) / 2 AS comp FROM labels)""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "labels").withColumn("has_memo", F.col("doc_id") % 5 != 0).withColumn("has_news", F.col("doc_id") % 3 != 0).withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, F.col("toxic")))
    out = G.completeness(rows, ["has_memo", "has_news"], ["quality", "toxic"], "has_memo")
    return out.select("doc_id", F.round("completeness", 9).alias("completeness"), F.round("overall", 9).alias("overall"), "passed")


#: Runs are sources: the pages of a source by number are its articles, its documents its chunks.
RUNS = """art AS (SELECT 'SRC' || page_id % 20 AS run_id, page_id AS pos, 'Page ' || page_id AS title, CASE WHEN page_id % 7 = 0 THEN ' ' ELSE url END AS snippet, url, CASE WHEN page_id % 2 = 0 THEN '2024-05-01' END AS published_date, 'web' AS source FROM pages),
chk AS (SELECT upper(source) AS run_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, 'Business' AS section, lang AS filing_type, text, CAST(NULL AS VARCHAR) AS source_url, '2024-03-01' AS filing_date, 'D' || doc_id AS chunk_id FROM documents)"""
REGISTRY = RUNS + f""", reg AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY kind, pos) AS "index" FROM (
  SELECT run_id, 0 AS kind, pos, 'news' AS source_type, title, {strip('snippet')} AS text, url, published_date AS date, source, NULL AS chunk_id FROM art WHERE {strip('snippet')} <> ''
  UNION ALL SELECT run_id, 1, pos, 'sec_filing', section || ' - ' || filing_type, {strip('text')}, source_url, filing_date, NULL, chunk_id FROM chk WHERE pos < 5 AND {strip('text')} <> ''))"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = F.col("page_id")
    art = V.table(spark, d, "pages").select(F.concat(F.lit("SRC"), p % 20).alias("run_id"), p.alias("pos"), F.concat(F.lit("Page "), p).alias("title"), F.when(p % 7 == 0, " ").otherwise(F.col("url")).alias("snippet"), "url", F.when(p % 2 == 0, "2024-05-01").alias("published_date"), F.lit("web").alias("source"))
    docs = V.numbers_in_source(spark, d).hint("merge").join(V.table(spark, d, "documents").select("doc_id", "lang", "text").hint("merge"), "doc_id")
    chk = docs.select(F.upper("source").alias("run_id"), (F.col("n") - 1).alias("pos"), F.lit("Business").alias("section"), F.col("lang").alias("filing_type"), "text", F.lit(None).cast("string").alias("source_url"), F.lit("2024-03-01").alias("filing_date"), F.concat(F.lit("D"), "doc_id").alias("chunk_id"))
    return art, chk


@query(f'WITH {REGISTRY} SELECT run_id, "index", source_type, title, md5(text) AS text_md5, url, date, source, chunk_id FROM reg')
def citation_registry(spark: SparkSession, d: str) -> DataFrame:
    return E.citation_registry(*_runs(spark, d)).select("run_id", "index", "source_type", "title", F.md5("text").alias("text_md5"), "url", "date", "source", "chunk_id")


@query(rf"""WITH {REGISTRY}, shown AS (SELECT run_id, string_agg('[' || "index" || '] ' || title || coalesce(' (' || nullif(concat_ws(' | ', source_type, source, date), '') || ')', '') || chr(10) || text[1:700] || chr(10), chr(10) ORDER BY "index") AS l FROM reg GROUP BY 1)
SELECT run_id, coalesce(chr(10) || '## Available Sources (use these citation numbers exactly)' || chr(10) || l, chr(10) || '## Available Sources' || chr(10) || 'No numbered evidence sources are available. Avoid unsupported factual claims.') AS sources FROM (SELECT run_id FROM chk UNION SELECT 'EMPTY') LEFT JOIN shown USING (run_id)""")
def render_registry(spark: SparkSession, d: str) -> DataFrame:
    art, chk = _runs(spark, d)
    runs = chk.select("run_id").distinct().union(chk.groupBy().agg(F.lit("EMPTY").alias("run_id")))
    return E.render_registry(runs, E.citation_registry(art, chk))


@query(f'WITH {REGISTRY} SELECT run_id, "index", source_type, title, url, date FROM reg')
def api_citations(spark: SparkSession, d: str) -> DataFrame:
    return E.api_citations(E.citation_registry(*_runs(spark, d)))


@query(f"WITH {REGISTRY} SELECT run_id, md5(string_agg(text, '|' ORDER BY \"index\")) AS contexts_md5, count(*) AS n FROM reg GROUP BY 1")
def registry_contexts(spark: SparkSession, d: str) -> DataFrame:
    return E.registry_contexts(E.citation_registry(*_runs(spark, d))).select("run_id", F.md5(F.array_join("contexts", "|")).alias("contexts_md5"), F.size("contexts").alias("n"))


@query("SELECT doc_id AS run_id, doc_id IN (SELECT page_id FROM pages) AS has_news, doc_id IN (SELECT vec_id FROM embeddings) AS has_filings, concat_ws(',', CASE WHEN doc_id NOT IN (SELECT page_id FROM pages) THEN 'news' END, CASE WHEN doc_id NOT IN (SELECT vec_id FROM embeddings) THEN 'filings' END) AS missing FROM documents")
def data_availability(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n, k: V.table(spark, d, n).select(F.col(k).alias("run_id"))
    return G.data_availability(t("documents", "doc_id"), news=t("pages", "page_id"), filings=t("embeddings", "vec_id")).withColumn("missing", F.array_join("missing", ","))


@query(f"""WITH {RUNS}, n AS (SELECT run_id, '## Recent News' || chr(10) || string_agg('- ' || title || chr(10) || '  Source: ' || source || chr(10) || '  ' || snippet[1:200] || chr(10), chr(10) ORDER BY pos) AS b FROM art GROUP BY 1),
k AS (SELECT run_id, '## SEC Filing Excerpts' || chr(10) || string_agg('- ' || section || chr(10) || '  ' || text[1:500] || chr(10), chr(10) ORDER BY pos) AS e FROM chk WHERE pos < 5 GROUP BY 1),
s AS (SELECT run_id, count(*) AS p FROM chk GROUP BY 1)
SELECT run_id, concat_ws(chr(10), '## Stock Data' || chr(10) || 'Company: N/A' || chr(10) || 'Price: $12.5' || chr(10) || 'Sector: ' || run_id || chr(10), b, '## Sentiment Analysis' || chr(10) || 'Overall: neutral' || chr(10) || 'Positive: ' || p || ' articles' || chr(10) || 'Negative: 0 articles' || chr(10), e) AS context
FROM (SELECT DISTINCT run_id FROM chk) LEFT JOIN n USING (run_id) LEFT JOIN s USING (run_id) LEFT JOIN k USING (run_id)""")
def assemble_context(spark: SparkSession, d: str) -> DataFrame:
    art, chk = _runs(spark, d)
    runs = chk.select("run_id").distinct()
    quotes = runs.select("run_id", F.lit(None).cast("string").alias("company_name"), F.lit(12.5).alias("current_price"), F.col("run_id").alias("sector"))
    sentiment = chk.groupBy("run_id").agg(F.count("*").alias("positive_count")).select("run_id", F.lit("neutral").alias("overall_sentiment"), "positive_count", F.lit(None).cast("int").alias("negative_count"))
    return G.assemble_context(runs, quotes, art, sentiment, chk)


@query("SELECT user_id AS run_id, CASE WHEN bool_or(event_type = 'error' OR value > 100) THEN 'error' ELSE 'draft' END AS step, count(*) AS n_errors FROM events GROUP BY 1")
def run_error_state(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select(F.col("user_id").alias("run_id"), (~((F.col("event_type") == "error") | (F.col("value") > 100))).alias("recoverable"))
    return G.run_error_state(e.select("run_id").distinct().withColumn("step", F.lit("draft")), e)


@query(f"""WITH c AS (SELECT doc_id, len(list_filter(t, lambda x: list_contains({sql_list(N.POSITIVE)}, x)))::DOUBLE AS p, len(list_filter(t, lambda x: list_contains({sql_list(N.NEGATIVE)}, x)))::DOUBLE AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents))
SELECT doc_id, CASE WHEN n >= p AND n >= 0.5 THEN 'negative' WHEN 0.5 >= p THEN 'neutral' ELSE 'positive' END AS label, round(1 / (exp(p - greatest(p, n, 0.5)) + exp(n - greatest(p, n, 0.5)) + exp(0.5 - greatest(p, n, 0.5))), 9) AS confidence FROM c""")
def classify_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return N.classify(V.table(spark, d, "documents")).select("doc_id", "label", F.round("confidence", 9).alias("confidence"))


#: Naive Bayes from the labelled documents whose number isn't divisible by five, over all documents.
LEARNT = """lab AS (SELECT doc_id, text, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label FROM documents JOIN labels USING (doc_id)), train AS (SELECT * FROM lab WHERE doc_id % 5 <> 0),
tok AS (SELECT label, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM train), class AS (SELECT unnest(['negative', 'neutral', 'positive']) AS label),
vocabulary AS (SELECT DISTINCT token FROM tok), size AS (SELECT c.label, count(t.token) AS n, (SELECT count(*) FROM vocabulary) AS v FROM class c LEFT JOIN tok t USING (label) GROUP BY 1),
cnt AS (SELECT label, token, count(*) AS c FROM tok GROUP BY 1, 2), weight AS (SELECT s.label, v.token, ln((coalesce(c, 0) + 1) / (s.n + s.v)) AS w FROM vocabulary v CROSS JOIN size s LEFT JOIN cnt ON cnt.label = s.label AND cnt.token = v.token),
prior AS (SELECT label, ln(count(*) / (SELECT count(*) FROM train)) AS p FROM train GROUP BY 1), word AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY 1, 2),
total AS (SELECT doc_id, label, sum(tf * w) AS s FROM word JOIN weight USING (token) GROUP BY 1, 2), score AS (SELECT d.doc_id, p.label, round(coalesce(t.s, 0) + p.p, 9) AS s FROM documents d CROSS JOIN prior p LEFT JOIN total t ON t.doc_id = d.doc_id AND t.label = p.label),
learnt AS (SELECT doc_id, label, round(1 / sum(exp(s - best)) OVER (PARTITION BY doc_id), 6) AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, label) AS n FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS best FROM score))"""


def _learnt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(what the model says of every document, the labelled documents)."""
    docs, label = V.table(spark, d, "documents").select("doc_id", "text"), F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    rows = docs.hint("merge").join(V.table(spark, d, "labels").select("doc_id", label.alias("label")).hint("merge"), "doc_id")
    return N.classify_learnt(docs, N.learn(rows.where("doc_id % 5 <> 0")), "doc_id"), rows


@query(f"WITH {LEARNT} SELECT doc_id, label, confidence FROM learnt WHERE n = 1")
def sentiment_learnt(spark: SparkSession, d: str) -> DataFrame:
    return _learnt(spark, d)[0].withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {LEARNT} SELECT b.label, count(*) AS n, count(*) FILTER (a.label = b.label) AS hit FROM learnt a JOIN lab b USING (doc_id) WHERE a.n = 1 AND doc_id % 5 = 0 GROUP BY 1")
def sentiment_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Of each label how many of the documents that weren't learnt from are given it."""
    said, rows = _learnt(spark, d)
    held = rows.where("doc_id % 5 = 0").select("doc_id", F.col("label").alias("given"))
    both = held.hint("merge").join(said.hint("merge"), "doc_id")
    return both.groupBy(F.col("given").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("given")).alias("hit"))


LABELLED = "lab AS (SELECT source AS entity_id, CASE WHEN l.doc_id IS NULL THEN 'neutral' WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label, text AS snippet, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return rows.select(F.col("source").alias("entity_id"), label.alias("label"), F.col("text").alias("snippet"), "quality", "toxic")


@query(f"""WITH {LABELLED} SELECT entity_id, p AS positive_count, n AS negative_count, z AS neutral_count, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS overall_sentiment FROM (
SELECT entity_id, count(*) FILTER (label = 'positive') AS p, count(*) FILTER (label = 'negative') AS n, count(*) FILTER (label = 'neutral') AS z FROM lab WHERE {strip('snippet')} <> '' GROUP BY 1)""")
def sentiment_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    return N.summary(rows, rows)


@query(f"WITH {LABELLED} SELECT entity_id, round(avg(coalesce(quality, 0) * 0.5 + 0.25), 9)::DOUBLE AS avg_positive, round(avg(coalesce(toxic, 0) * 0.5), 9)::DOUBLE AS avg_negative FROM lab GROUP BY 1")
def sentiment_averages(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("positive"), F.coalesce("quality", F.lit(0)) * 0.5 + 0.25, F.lit("negative"), F.coalesce("toxic", F.lit(0)) * 0.5)
    return N.averages(_labelled(spark, d).withColumn("scores", m)).withColumn("avg_positive", F.round("avg_positive", 9)).withColumn("avg_negative", F.round("avg_negative", 9))


@query("SELECT o_orderkey, CASE WHEN v >= 1e12 THEN '$' || printf('%.2f', v / 1e12) || 'T' WHEN v >= 1e9 THEN '$' || printf('%.2f', v / 1e9) || 'B' WHEN v <> 0 THEN '$' || printf('%.2f', v / 1e6) || 'M' END AS cap FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE floor(o_totalprice) * [1000, 1000000, 100000000][CAST(o_orderkey % 3 AS INTEGER) + 1] + 1 END::DOUBLE AS v FROM orders)")
def format_market_cap(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 10 == 0, F.lit(0.0)).otherwise(F.floor("o_totalprice") * F.expr("array(1000L, 1000000L, 100000000L)[cast(o_orderkey % 3 as int)]") + 1)
    return V.table(spark, d, "orders").select("o_orderkey", T.format_market_cap(v).alias("cap"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN text[1:97] || '...' ELSE text END AS shown, round(n_chars / 7, 4) AS score FROM documents")
def sentiment_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").withColumn("scores", F.create_map(F.lit("positive"), F.col("n_chars") / 7))
    return N.report_rows(rows).select("doc_id", "shown", F.col("scores")["positive"].alias("score"))
