"""The given tables as filings, chunks, queries, memos and cases, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.operators.ordered import numbered

KEYS = "array('business', 'risk_factors', 'md&a', 'market_risk')"
NAMES = "array('Business', 'Risk Factors', 'MD&A', 'Market Risk')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is the ticker, the language the filing type."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("D"), F.col("doc_id")).alias("chunk_id"), "text", F.upper("source").alias("ticker"), F.col("lang").alias("filing_type"),
        F.expr(f"{KEYS}[doc_id % 4]").alias("section_key"), F.expr(f"{NAMES}[doc_id % 4]").alias("section_name"),
        F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-15")).alias("filing_date"),
    )


CHUNKS = """chunks AS (SELECT doc_id, 'D' || doc_id AS chunk_id, text, upper(source) AS ticker, lang AS filing_type,
  ['business', 'risk_factors', 'md&a', 'market_risk'][doc_id % 4 + 1] AS section_key, ['Business', 'Risk Factors', 'MD&A', 'Market Risk'][doc_id % 4 + 1] AS section_name,
  '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-15' AS filing_date FROM documents)"""


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, with the vector of the same number where there is one."""
    return chunks(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")


VECTOR_CHUNKS = CHUNKS + ", vchunks AS (SELECT c.*, e.embedding FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.doc_id)"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, each in the scope of one ticker."""
    items = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    return items.select(
        "item_id", F.concat(F.lit("Q"), F.col("item_id")).alias("query_id"), "text", F.concat(F.lit("SRC"), F.col("item_id") % 20).alias("ticker"),
        F.lit(None).cast("string").alias("filing_type"), F.lit(None).cast("string").alias("section_key"), F.lit(None).cast("string").alias("section_name"), F.lit(None).cast("string").alias("filing_date"), "embedding",
    )


QUERIES = """queries AS (SELECT b.item_id, 'Q' || b.item_id AS query_id, b.text, 'SRC' || b.item_id % 20 AS ticker, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""


def filtered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with filters of every kind by turns; some name a key and a name that differ."""
    q = queries(spark, sf_dir)
    turn = F.col("item_id") % 5
    return q.withColumns({
        "ticker": F.when(turn != 3, F.lower("ticker")), "filing_type": F.when(turn.isin(1, 3), "en"), "section_key": F.when(turn.isin(2, 4), "risk_factors"),
        "section_name": F.when(turn == 4, "Business").when(turn == 0, "MD&A"), "filing_date": F.when(turn == 3, "2024-03-15"),
    })


FILTERED = """fq AS (SELECT item_id, query_id, text, embedding, CASE WHEN item_id % 5 <> 3 THEN lower(ticker) END AS ticker, CASE WHEN item_id % 5 IN (1, 3) THEN 'en' END AS filing_type,
  CASE WHEN item_id % 5 IN (2, 4) THEN 'risk_factors' END AS section_key, CASE WHEN item_id % 5 = 4 THEN 'Business' WHEN item_id % 5 = 0 THEN 'MD&A' END AS section_name,
  CASE WHEN item_id % 5 = 3 THEN '2024-03-15' END AS filing_date FROM queries)"""
MEETS = """(q.ticker IS NULL OR upper(q.ticker) = c.ticker) AND (q.filing_type IS NULL OR q.filing_type = c.filing_type) AND (q.filing_date IS NULL OR q.filing_date = c.filing_date)
  AND (q.section_key IS NULL OR q.section_key = c.section_key) AND ({}q.section_name IS NULL OR q.section_name = c.section_name)"""


def worded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with words of the filings world put before them, by turns."""
    words = F.expr("array('supply chain risk and suppliers', 'foreign exchange rates & hedging', 'revenue growth and cash flow', 'products, R&D and competition', 'weather')[item_id % 5]")
    return queries(spark, sf_dir).withColumn("text", F.concat_ws(" ", words, "text"))


WORDED = """wq AS (SELECT item_id, query_id, ticker, embedding, ['supply chain risk and suppliers', 'foreign exchange rates & hedging', 'revenue growth and cash flow', 'products, R&D and competition', 'weather'][item_id % 5 + 1] || ' ' || text AS text FROM queries)"""


def numbers_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n): documents numbered in their source, on narrow rows and in ranges, since a third of them may be of one source."""
    return numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], "n")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw filings: four texts in a row of a source, each under a heading, one heading missing by turns."""
    head = F.expr("array('Item 1. Business ', 'ITEM 1A.  Risk Factors ', 'Item 7. Management ', 'Item 7A. Quantitative ')[cast((n - 1) % 4 as int)]")
    docs = numbers_in_source(spark, sf_dir).hint("merge").join(table(spark, sf_dir, "documents").select("doc_id", "text").hint("merge"), "doc_id")
    part = docs.withColumn("part", F.concat(F.when(F.col("doc_id") % 7 != 0, head).otherwise(F.lit("")), F.col("text"), F.lit(" ")))
    made = part.groupBy("source", F.floor((F.col("n") - 1) / 4).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "").alias("text"))
    return made.select(F.concat_ws("-", "source", "k").alias("document_id"), F.upper("source").alias("ticker"), "k", "text")


FILINGS = """parts AS (SELECT source, n, CASE WHEN doc_id % 7 <> 0 THEN ['Item 1. Business ', 'ITEM 1A.  Risk Factors ', 'Item 7. Management ', 'Item 7A. Quantitative '][(n - 1) % 4 + 1] ELSE '' END || text || ' ' AS part
  FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)),
filings AS (SELECT source || '-' || k AS document_id, upper(source) AS ticker, k, text FROM (SELECT source, (n - 1) // 4 AS k, string_agg(part, '' ORDER BY n) AS text FROM parts GROUP BY 1, 2))"""

SPACE = r"[ \t\r\n\f]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


MARK = "chr(1)"
FILING_PIECES = rf"""marked AS (SELECT document_id, ticker, string_split(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(Item\s*1[.\s]+Business)', chr(1) || '0' || chr(1) || '\1', 'g'), '(?i)(Item\s*1A[.\s]+Risk\s*Factors)', chr(1) || '1' || chr(1) || '\1', 'g'),
    '(?i)(Item\s*7[.\s]+Management)', chr(1) || '2' || chr(1) || '\1', 'g'), '(?i)(Item\s*7A[.\s]+Quantitative)', chr(1) || '3' || chr(1) || '\1', 'g'), chr(1)) AS p FROM filings),
pieces AS (SELECT document_id, ticker, i - 1 AS pos, ['business', 'risk_factors', 'md&a', 'market_risk'][CAST(p[2 * i] AS INTEGER) + 1] AS section_key, p[2 * i + 1] AS content
  FROM (SELECT document_id, ticker, p, unnest(range(1, (len(p) - 1) // 2 + 1)) AS i FROM marked)),
sections AS (SELECT document_id, section_key, content[1:50000] AS content FROM (SELECT document_id, section_key, content, row_number() OVER (PARTITION BY document_id, section_key ORDER BY length(content) DESC, pos) AS n
  FROM (SELECT document_id, section_key, pos, {sql_strip('content')} AS content FROM pieces) WHERE length(content) > 500) WHERE n = 1)"""


def memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's assistant turns as one memo: sentences of the turn with hints, numbers and citations by rule."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    tag = F.expr("array(' Total revenue of all products grew [1].', ' Segment sales demand grew 12% [2].', ' Market risk stands near $1,200 exposure [3] [1].', ' Cash flow and inventory growth.', ' Gross margin reached 44% of sales [9].')[(conv_id + turn) % 5]")
    text = F.concat(F.col("text"), tag)
    made = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("x")))), lambda r: r["x"]), "\n").alias("text"))
    return made.select(F.col("conv_id").alias("memo_id"), "text")


MEMOS = """memos AS (SELECT conv_id AS memo_id, string_agg(text || [' Total revenue of all products grew [1].', ' Segment sales demand grew 12% [2].', ' Market risk stands near $1,200 exposure [3] [1].', ' Cash flow and inventory growth.', ' Gross margin reached 44% of sales [9].'][(conv_id + turn) % 5 + 1], chr(10) ORDER BY turn, text) AS text
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sources of each memo: the user's turns."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("memo_id"), n.alias("index"), F.concat_ws(" ", "text", F.expr("array('segment sales grew 12% on demand', 'market risk exposure of $1200', 'total revenue products')[(conv_id + turn) % 3]")).alias("text"))


EVIDENCE = """evidence AS (SELECT memo_id, i AS "index", text FROM (SELECT conv_id AS memo_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i,
  text || ' ' || ['segment sales grew 12% on demand', 'market risk exposure of $1200', 'total revenue products'][(conv_id + turn) % 3 + 1] AS text FROM conversations WHERE role = 'user'))"""
