"""Queries of the sources, text functions and index operators."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofsieve.functions import text as T
from proofsieve.operators import index as I
from proofsieve.operators import stored as K
from proofsieve.plans import views as V
from proofsieve.plans.grounding_queries import sql_sentences
from proofsieve.streaming.streams import work_dir
from proofsieve.plans.sql import normal
from proofsieve.sources import filings as A

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


SPACE, strip = V.SPACE, V.sql_strip


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays of each source, as submissions documents have them, a row for every 1,000 filings."""
    docs = V.numbers_in_source(spark, d).hint("merge").join(V.table(spark, d, "documents").select("doc_id", "lang").hint("merge"), "doc_id")
    rows = docs.groupBy("source", F.floor((F.col("n") - 1) / 1000).alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))).alias("r"))
    pick = lambda f: F.transform("r", f)
    return rows.select(
        F.regexp_replace("source", "[^0-9]", "").alias("cik"), F.upper("source").alias("ticker"), F.lit(None).cast("string").alias("company_name"), "block", pick(lambda x: x["lang"]).alias("form"),
        pick(lambda x: F.concat(F.lit("000-"), x["doc_id"])).alias("accession_number"), pick(lambda x: F.concat(F.lit("2024-01-"), x["doc_id"] % 28 + 1)).alias("filing_date"),
        pick(lambda x: F.when(x["doc_id"] % 2 == 0, F.lit("2023-12-31"))).alias("report_date"), pick(lambda x: F.concat(F.lit("d"), x["doc_id"], F.lit(".htm"))).alias("primary_document"),
    )


@query("""SELECT ticker, company_name, accession_number, filing_date, report_date FROM (SELECT upper(source) AS ticker, upper(source) AS company_name, '000-' || doc_id AS accession_number, '2024-01-' || (doc_id % 28 + 1) AS filing_date,
CASE WHEN doc_id % 2 = 0 THEN '2023-12-31' END AS report_date, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE lang = 'en') WHERE n <= 3""")
def recent_filings(spark: SparkSession, d: str) -> DataFrame:
    return A.recent_filings(_submissions(spark, d), "en", 3).select("ticker", "company_name", "accession_number", "filing_date", "report_date")


@query("SELECT doc_id, source AS ticker, CASE WHEN source <> 'src3' THEN lpad(source[4:], 10, '0') END AS cik FROM documents")
def resolve_cik(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", F.col("source").alias("ticker"))
    known = docs.select("ticker").distinct().where("ticker <> 'src3'").select(F.upper("ticker").alias("ticker"), F.regexp_replace("ticker", "[^0-9]", "").cast("int").alias("cik"))
    return A.resolve_cik(docs, known)


@query("SELECT doc_id, 'https://filings.example/data/' || source[4:] || '/' || '000' || doc_id || '/d' || doc_id || '.htm' AS filing_url FROM documents")
def filing_url(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").select("doc_id", F.regexp_replace("source", "[^0-9]", "").alias("cik"), F.concat(F.lit("000-"), F.col("doc_id")).alias("accession_number"), F.concat(F.lit("d"), F.col("doc_id"), F.lit(".htm")).alias("primary_document"))
    return A.filing_links(rows, "https://filings.example/data").select("doc_id", "filing_url")


@query(f"SELECT doc_id AS document_id, length(text) AS n, CASE WHEN {strip('text')} = '' THEN 'no content' END AS error FROM documents")
def load_filings(spark: SparkSession, d: str) -> DataFrame:
    return A.load_filings(spark, f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.length("content").alias("n"), "error")


ARTICLE = """SELECT page_id, '' || page_id AS title, url, regexp_replace(html, '<[^>]+>', ' ', 'g') AS snippet FROM pages"""


@query(f"""SELECT page_id, url, title, snippet[1:500] AS snippet, 0.0::DOUBLE AS relevance_score FROM ({ARTICLE})""")
def articles_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = V.table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("title"), "url", F.regexp_replace("html", "<[^>]+>", " ").alias("snippet"), F.lit(None).cast("double").alias("relevance_score"))
    return A.articles(raw).select("page_id", "url", "title", "snippet", "relevance_score")


@query(r"""SELECT page_id, coalesce(nullif(upper(h[1]) || lower(h[2:]), ''), 'Unknown') AS name FROM (SELECT page_id, split_part(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), '^www\.', ''), '.', 1) AS h FROM pages)""")
def source_name(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "pages").select("page_id", T.source_name("url").alias("name"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal WHEN s_suppkey % 2 = 0 THEN round(s_acctbal + 1, 2) END AS current_price,
CASE WHEN s_suppkey % 4 <> 0 THEN s_name WHEN s_suppkey % 8 <> 0 THEN 'short' ELSE 'T' || s_suppkey END AS company_name, s_suppkey % 5 <> 0 AND (s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0) AS success FROM supplier""")
def quotes_normalize(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    raw = V.table(spark, d, "supplier").select(
        key.alias("id"), F.concat(F.lit("T"), key).alias("ticker"), F.when(key % 3 != 0, F.col("s_acctbal")).otherwise(F.lit(0.0)).alias("current_price"), F.when(key % 2 == 0, F.round(F.col("s_acctbal") + 1, 2)).alias("regular_market_price"),
        F.when(key % 4 != 0, F.col("s_name")).otherwise("").alias("long_name"), F.when(key % 8 != 0, "short").alias("short_name"), F.when(key % 5 == 0, "no data").alias("error"),
    )
    return A.quotes(raw).select("id", "current_price", "company_name", "success")


def _written(df: DataFrame, name: str) -> str:
    """The rows as JSON, one a line, in a new folder."""
    path = work_dir(df.sparkSession, name)
    df.write.json(path)
    return path


@query("SELECT 'src_' || doc_id AS id, 'SRC' AS ticker, text AS query, CAST(NULL AS VARCHAR) AS filing_type, CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE '' END AS sections, '' AS keywords, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE 5 END AS top_k, 'query' AS mode FROM documents")
def load_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases made of the documents, written as JSON and read by the reader, with the defaults."""
    i = F.col("doc_id")
    raw = V.table(spark, d, "documents").select(
        F.concat(F.lit("src_"), i).alias("id"), F.lit("src").alias("ticker"), F.col("text").alias("query"), F.lit("").alias("filing_type"), F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("expected_sections"),
        F.when(i % 3 == 0, 7).alias("top_k"), F.lit("Query").alias("mode"),
    )
    out = A.load_retrieval_cases(spark, _written(raw, "cases"), lines=True)
    return out.select("id", "ticker", "query", "filing_type", F.array_join("expected_sections", ",").alias("sections"), F.array_join("expected_keywords", ",").alias("keywords"), "top_k", "mode")


@query("""SELECT 'c' || conv_id || '_' || turn || '_' || n AS id, upper(role) AS ticker, concat_ws(',', CASE WHEN length(text) < 1 THEN 'input' END, CASE WHEN turn * 7 > 20 THEN 'max_news_articles' END) AS violations FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS n FROM conversations)""")
def load_rag_cases(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("text"))
    raw = V.table(spark, d, "conversations").select(F.concat(F.lit("c"), F.concat_ws("_", "conv_id", "turn", n)).alias("id"), F.concat(F.lit(" "), "role").alias("ticker"), F.col("text").alias("input"), F.lit("x").alias("expected_output"), (F.col("turn") * 7).cast("int").alias("max_news_articles"))
    return A.load_rag_cases(spark, _written(raw, "rag-cases"), lines=True).select("id", "ticker", F.array_join("violations", ",").alias("violations"))


@query("SELECT doc_id AS case_id, n_chars AS score FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'c' || doc_id END AS doc_id, n_chars FROM documents) WHERE doc_id <> ' '")
def load_results(spark: SparkSession, d: str) -> DataFrame:
    """Reports with lists of results, one a source and block of ids, written as JSON and read by the reader: rows without an id are left out."""
    rows = V.table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit("c"), "doc_id")).alias("case_id"), F.col("n_chars").alias("score"), F.floor(F.col("doc_id") / 1000).alias("block"))
    reports = rows.groupBy("source", "block").agg(F.collect_list(F.struct("case_id", "score")).alias("results")).select("source", "results")
    return A.load_result_payload(spark, _written(reports, "results"), lines=True).select("case_id", "score")


#: The index is the whole table; a batch has two versions of every chunk, half of them under a new id, some of them blank.
EXISTING = f"{V.CHUNKS}, existing AS (SELECT chunk_id, text, ticker, 0::BIGINT AS version FROM chunks), batch AS (SELECT CASE WHEN doc_id % 2 = 0 THEN chunk_id ELSE 'N' || doc_id END AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text || v END AS text, ticker, v AS version FROM chunks, range(1, 3) t(v))"


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = V.chunks(spark, d)
    existing = c.select("chunk_id", "text", "ticker", F.lit(0).cast("bigint").alias("version"))
    batch = c.withColumn("version", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    chunk_id = F.when(F.col("doc_id") % 2 == 0, F.col("chunk_id")).otherwise(F.concat(F.lit("N"), "doc_id"))
    return existing, batch.select(chunk_id.alias("chunk_id"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.concat("text", "version")).alias("text"), "ticker", "version")


@query(f"""WITH {EXISTING}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC) AS n FROM batch WHERE {strip('text')} <> '') WHERE n = 1)
SELECT chunk_id, md5(text) AS text_md5, version FROM last UNION ALL SELECT chunk_id, md5(text), version FROM existing WHERE chunk_id NOT IN (SELECT chunk_id FROM last)""")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.upsert(*_index(spark, d)).select("chunk_id", F.md5("text").alias("text_md5"), "version")


LAST = f"WITH {EXISTING}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC) AS n FROM batch WHERE {strip('text')} <> '') WHERE n = 1)"


def _stored(spark: SparkSession, d: str) -> tuple[str, dict[str, int]]:
    """An index on storage after a batch has been put into it, and the counts."""
    existing, batch = _index(spark, d)
    path = work_dir(spark, "index")
    K.write_chunks(existing, path, slots=4)
    return path, K.upsert_stored(spark, path, batch, slots=4)


@query(f"{LAST} SELECT chunk_id, ticker, md5(text) AS text_md5, version FROM last UNION ALL SELECT chunk_id, ticker, md5(text), version FROM existing WHERE chunk_id NOT IN (SELECT chunk_id FROM last)")
def upsert_stored(spark: SparkSession, d: str) -> DataFrame:
    path, _ = _stored(spark, d)
    return K.read_chunks(spark, path).select("chunk_id", "ticker", F.md5("text").alias("text_md5"), "version")


@query(f"{LAST} SELECT (SELECT count(*) FROM batch) AS given, (SELECT count(*) FROM batch WHERE {strip('text')} = '') AS blank, (SELECT count(*) FROM last WHERE chunk_id NOT IN (SELECT chunk_id FROM existing)) AS added, (SELECT count(*) FROM last WHERE chunk_id IN (SELECT chunk_id FROM existing)) AS replaced")
def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    _, n = _stored(spark, d)
    return spark.createDataFrame([(n["given"], n["blank"], n["added"], n["replaced"])], "given long, blank long, added long, replaced long")


@query(f"WITH {V.CHUNKS} SELECT ticker, count(*) AS n, (SELECT count(*) FROM chunks WHERE ticker = 'SRC3') AS removed FROM chunks WHERE ticker <> 'SRC3' GROUP BY 1")
def delete_stored(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark, "index")
    K.write_chunks(V.chunks(spark, d).withColumn("version", F.lit(0)), path, slots=4)
    removed = K.delete_stored(spark, path, " src3 ")
    return K.read_chunks(spark, path).groupBy("ticker").agg(F.count("*").alias("n")).withColumn("removed", F.lit(removed).cast("long"))


@query(f"WITH {V.CHUNKS} SELECT chunk_id FROM chunks WHERE ticker <> 'SRC3'")
def delete_by_ticker(spark: SparkSession, d: str) -> DataFrame:
    return I.delete_ticker(V.chunks(spark, d), " src3 ").select("chunk_id")


@query(f"WITH {V.CHUNKS}, {V.QUERIES} SELECT c.chunk_id, 0.0::DOUBLE AS distance, length(c.text) AS n FROM chunks c JOIN queries q ON c.chunk_id = 'D' || q.item_id")
def get_by_id(spark: SparkSession, d: str) -> DataFrame:
    ids = V.queries(spark, d).select(F.concat(F.lit("D"), "item_id").alias("chunk_id"))
    return I.get_by_id(V.chunks(spark, d), ids).select("chunk_id", "distance", F.length("text").alias("n"))


@query(f"WITH {V.CHUNKS}, t AS (SELECT DISTINCT upper(source) AS ticker FROM documents UNION SELECT 'NONE') SELECT ticker, count(c.chunk_id) AS n_chunks, count(c.chunk_id) > 0 AS indexed FROM t LEFT JOIN chunks c USING (ticker) GROUP BY 1")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    c = V.chunks(spark, d)
    asked = c.select(F.lower("ticker").alias("ticker")).distinct().union(c.groupBy().agg(F.lit(" none ").alias("ticker")))
    return I.index_status(asked, c)


@query(f"""WITH {V.CHUNKS}, h AS (SELECT chunk_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS d FROM chunks)
SELECT chunk_id, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || ['8', '9', 'a', 'b'][CAST('0x' || d[17] AS INTEGER) % 4 + 1] || d[18:20] || '-' || d[21:32] AS point_id FROM h""")
def point_id(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).select("chunk_id", T.point_id("chunk_id").alias("point_id"))


@query(f"WITH {V.CHUNKS} SELECT CASE WHEN doc_id % 3 = 0 THEN 'R' || doc_id ELSE chunk_id END AS chunk_id, length(text) AS n FROM chunks WHERE {strip('text')} <> ''")
def sparse_corpus(spark: SparkSession, d: str) -> DataFrame:
    c = V.chunks(spark, d).withColumn("retrieval_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("R"), "doc_id")).otherwise(" ")).withColumn("id", F.col("doc_id").cast("string"))
    return I.sparse_corpus(c).select("chunk_id", F.length("text").alias("n"))


@query(f"WITH {V.CHUNKS} SELECT * FROM chunks WHERE false")
def drop_index(spark: SparkSession, d: str) -> DataFrame:
    return I.drop_index(V.chunks(spark, d))


quote = lambda x: "'" + x.replace("'", "''") + "'"
#: Character references piece by piece: each piece begins behind an ampersand and is joined with the table of names.
HTML = f"""names(name, c) AS (VALUES {', '.join(f'({quote(k)}, {quote(v)})' for k, v in html5.items())}),
cut AS (SELECT page_id, i, p, regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;', 0) AS long, regexp_extract(p, '^({'|'.join(T.SHORT)})', 0) AS short, regexp_extract(p, '^#([0-9]+);?', 1) AS number
  FROM (SELECT page_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS p FROM (SELECT page_id, string_split(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&') AS s FROM pages))),
shown AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN p WHEN number <> '' THEN chr(CAST(number AS INTEGER)) || regexp_replace(p, '^#[0-9]+;?', '') WHEN l.c IS NOT NULL THEN l.c || p[len(long) + 1:] WHEN s.c IS NOT NULL THEN s.c || p[len(short) + 1:] ELSE '&' || p END, '' ORDER BY i) AS t
  FROM cut LEFT JOIN names l ON l.name = long LEFT JOIN names s ON s.name = short GROUP BY page_id)"""


@query(f"WITH {HTML} SELECT page_id, trim(regexp_replace(t, '{T.ANY_SPACE}+', ' ', 'g')) AS text FROM shown")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "pages").select("page_id", T.html_to_text("html").alias("text"))


@query(f"WITH {V.FILINGS}, {V.FILING_PIECES} SELECT document_id, pos, section_key, length(content) AS n FROM pieces")
def section_markers(spark: SparkSession, d: str) -> DataFrame:
    return V.filings(spark, d).select("document_id", F.posexplode(T.section_pieces("text")).alias("pos", "p")).select("document_id", "pos", F.col("p.name").alias("section_key"), F.length("p.content").alias("n"))


@query(f"WITH {V.FILINGS}, {V.FILING_PIECES} SELECT document_id, section_key, length(content) AS n, md5(content) AS content_md5 FROM sections")
def slice_sections(spark: SparkSession, d: str) -> DataFrame:
    return I.slice_sections(V.filings(spark, d)).select("document_id", "section_key", F.length("content").alias("n"), F.md5("content").alias("content_md5"))


@query(rf"SELECT doc_id, md5({strip('''regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')''')}) AS text_md5 FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.clean_section_text("text")).alias("text_md5"))


@query(f"SELECT doc_id, md5({normal('text')}) AS text_md5 FROM documents")
def normalize_token(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.normalize_token("text")).alias("text_md5"))


RAW_NAME = "['Item 1A. Risk Factors', 'Management’s Discussion and Analysis', 'Business Overview', 'Notes & Exhibits', 'Item 7A', ' ', 'MD&A', 'Legal Proceedings']"
KEYED = f"named AS (SELECT doc_id, source, lang, {RAW_NAME}[doc_id % 8 + 1] AS raw, [2, 3, 1, NULL, 4, NULL, 3, NULL][doc_id % 8 + 1] AS k FROM documents)"
SLUG = "CASE k WHEN 1 THEN 'business' WHEN 2 THEN 'risk_factors' WHEN 3 THEN '{m}' WHEN 4 THEN 'market_risk' ELSE coalesce(nullif(regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown_section') END"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").withColumn("raw_name", F.expr("array('Item 1A. Risk Factors', 'Management’s Discussion and Analysis', 'Business Overview', 'Notes & Exhibits', 'Item 7A', ' ', 'MD&A', 'Legal Proceedings')[doc_id % 8]"))


@query(f"WITH {KEYED} SELECT doc_id, CASE k WHEN 1 THEN 'business' WHEN 2 THEN 'risk_factors' WHEN 3 THEN 'md&a' WHEN 4 THEN 'market_risk' END AS section_key FROM named")
def canonical_section(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("doc_id", T.canonical_section_key("raw_name").alias("section_key"))


@query(f"WITH {KEYED} SELECT doc_id, {SLUG.format(m='md&a')} AS key, coalesce(['Business', 'Risk Factors', 'MD&A', 'Market Risk'][k], nullif(trim(raw), ''), 'Unknown Section') AS display_name, {SLUG.format(m='md_and_a')} AS slug FROM named")
def section_descriptor(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("doc_id", T.section_descriptor("raw_name").alias("s")).select("doc_id", "s.*")


@query(f"""WITH {V.FILINGS}, {V.FILING_PIECES}, wanted(o, section_key) AS (VALUES (0, 'business'), (1, 'risk_factors'), (2, 'md&a'), (3, 'market_risk')),
has AS (SELECT DISTINCT document_id, section_key FROM sections), grid AS (SELECT d.document_id, w.o, w.section_key, h.document_id IS NOT NULL AS there FROM (SELECT DISTINCT document_id FROM sections) d CROSS JOIN wanted w LEFT JOIN has h ON h.document_id = d.document_id AND h.section_key = w.section_key)
SELECT document_id, coalesce(string_agg(section_key, ',' ORDER BY o) FILTER (there), '') AS found, coalesce(string_agg(section_key, ',' ORDER BY o) FILTER (NOT there), '') AS skipped FROM grid GROUP BY 1""")
def resolve_sections(spark: SparkSession, d: str) -> DataFrame:
    sections = I.slice_sections(V.filings(spark, d)).select("document_id", F.lit(0).alias("pos"), F.when(F.col("section_key") == "md&a", "MD&A").otherwise(F.col("section_key")).alias("raw_name"), "content")
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate(("business", "risk_factors", "md&a", "market_risk"))], "pos int, section_key string")
    return I.resolve_sections(sections, wanted).select("document_id", F.array_join("found", ",").alias("found"), F.array_join("skipped", ",").alias("skipped"))


FIXED = f"""cut AS (SELECT doc_id, source, lang, n_chars, i AS chunk_index, {strip('text[i * 800 + 1:i * 800 + 1000]')} AS chunk_text FROM (SELECT *, unnest(range(0, greatest(length(text) - 201, 0) // 800 + 1)) AS i FROM documents WHERE length(text) > 0)), fixed AS (SELECT * FROM cut WHERE chunk_text <> '')"""


@query(f"WITH {FIXED} SELECT doc_id, chunk_index, md5(chunk_text) AS text_md5 FROM fixed")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return I.chunk_fixed(V.table(spark, d, "documents"), "text").select("doc_id", "chunk_index", F.md5("chunk_text").alias("text_md5"))


PACKED = "list_reduce(list_transform(s, lambda x: [x]), lambda acc, x: CASE WHEN acc[-1] = '' THEN list_concat(acc[:-2], x) WHEN length(acc[-1]) + length(x[1]) + 1 <= 1000 THEN list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, x) END)"


@query(f"SELECT doc_id, unnest(range(len(c)))::INTEGER AS chunk_index, md5(unnest(c)) AS text_md5 FROM (SELECT doc_id, list_filter({PACKED}, lambda x: x <> '') AS c FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents) WHERE len(s) > 0)")
def chunk_packed(spark: SparkSession, d: str) -> DataFrame:
    return I.chunk_packed(V.table(spark, d, "documents"), "text").select("doc_id", "chunk_index", F.md5("chunk_text").alias("text_md5"))


@query()
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return I.chunk_recursive(V.table(spark, d, "documents"), "text").select("doc_id", "chunk_index", "chunk_text")


@query(f"""WITH {FIXED}, k AS (SELECT *, [2, 3, 1, NULL, 4, NULL, 3, NULL][doc_id % 8 + 1] AS k, {RAW_NAME}[doc_id % 8 + 1] AS raw FROM fixed),
s AS (SELECT *, {SLUG.format(m='md_and_a')} AS slug, upper(source) || '_' || lang || '_' || CASE WHEN doc_id % 2 = 0 THEN '2024-01-01' ELSE 'unknown_date' END AS document_id FROM k)
SELECT document_id, document_id || ':' || slug AS parent_section_id, document_id || '_' || slug || '_' || printf('%03d', chunk_index) AS chunk_id, md5(chunk_text) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 7 END - 1 AS n_keys FROM s""")
def build_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = I.chunk_fixed(_named(spark, d), "text").select(F.col("source").alias("ticker"), F.lit(None).cast("string").alias("company_name"), F.col("lang").alias("filing_type"), F.when(F.col("doc_id") % 2 == 0, "2024-01-01").alias("filing_date"), "raw_name", "chunk_index", "chunk_text")
    return I.build_chunks(rows).select("document_id", "parent_section_id", "chunk_id", F.md5("text").alias("text_md5"), F.size("metadata").alias("n_keys"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN lang = 'en' THEN 'lang' END, 'source') AS keys FROM documents")
def sanitize_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("lang"), F.when(F.col("lang") == "en", F.col("lang")), F.lit("source"), F.col("source"))
    return V.table(spark, d, "documents").select("doc_id", F.array_join(F.map_keys(I.sanitized(m)), ",").alias("keys"))


@query(f"""WITH {V.FILINGS}, {V.FILING_PIECES} SELECT f.document_id, count(s.section_key) AS total_chunks, coalesce(string_agg(DISTINCT s.section_key, ',' ORDER BY s.section_key), '') AS sections, count(s.section_key) > 0 AS success,
CASE WHEN count(s.section_key) = 0 THEN 'No content found in requested sections' END AS error FROM filings f LEFT JOIN (SELECT document_id, section_key, unnest(range(0, greatest(length(content) - 201, 0) // 800 + 1)) FROM sections) s USING (document_id) GROUP BY 1""")
def ingestion_report(spark: SparkSession, d: str) -> DataFrame:
    f = V.filings(spark, d)
    return I.ingestion_report(f, I.chunk_fixed(I.slice_sections(f))).withColumn("sections", F.array_join("sections", ","))


@query(f"WITH {V.CHUNKS} SELECT chunk_id, ticker FROM chunks UNION ALL SELECT 'B' || chunk_id, 'NEW' || ticker FROM chunks WHERE ticker >= 'SRC5'")
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A batch of all chunks again, those of some tickers under a new one."""
    c = V.chunks(spark, d).select("chunk_id", "ticker")
    again = c.select(F.concat(F.lit("B"), "chunk_id").alias("chunk_id"), F.when(F.col("ticker") < "SRC5", F.col("ticker")).otherwise(F.concat(F.lit("NEW"), "ticker")).alias("ticker"))
    return I.ingest(c, again)


@query()
def embed_hashed(spark: SparkSession, d: str) -> DataFrame:
    return I.embed_hashed(V.table(spark, d, "documents")).select("doc_id", "embedding")
