"""Filings, articles, quotes, cases and results: reading, normalising and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofsieve.functions.text import filing_url, given, source_name, stripped


def load_filings(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """(document_id, content, error) of the files under ``path`` (Parquet, JSON lines, or whole text files); what can't be read is a row with an error."""
    if path.rstrip("/").endswith((".html", ".htm", ".txt")):
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document_id"), F.col("value").alias("content"))
        return with_error(files, "content")
    if path.endswith(".json"):
        rows = spark.read.option("mode", "PERMISSIVE").schema(f"document_id string, {text} string, _corrupt_record string").json(path)
        return rows.select("document_id", F.col(text).alias("content"), F.when(F.col("_corrupt_record").isNotNull(), "record can't be read").when(given(text).isNull(), "no content").alias("error"))
    return with_error(spark.read.parquet(path).withColumnRenamed(text, "content"), "content")


def with_error(filings: DataFrame, content: str) -> DataFrame:
    """Adds ``error``, set where there is no content."""
    return filings.withColumn("error", F.when(given(content).isNull(), "no content"))


def recent_filings(submissions: DataFrame, filing_type: str = "10-K", count: int = 1) -> DataFrame:
    """The first ``count`` filings of a type of each company, from rows with parallel arrays
    form, accession_number, filing_date, report_date, primary_document. A company with many filings has them in several rows, in the order of ``block``."""
    fields = ["form", "accession_number", "filing_date", "report_date", "primary_document"]
    block = F.col("block") if "block" in submissions.columns else F.lit(0)
    rows = submissions.select("cik", "ticker", "company_name", block.alias("block"), F.posexplode(F.arrays_zip(*fields)).alias("pos", "f")).select("cik", "ticker", "company_name", "block", "pos", "f.*").where(F.col("form") == filing_type)
    nth = F.row_number().over(Window.partitionBy("cik").orderBy("block", "pos"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= count).withColumn("company_name", F.coalesce("company_name", "ticker"))


def resolve_cik(tickers: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """(ticker, cik): the ten-digit number of each ticker, any case; null if it is unknown."""
    known = ticker_map.select(F.upper("ticker").alias("__key"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik")).dropDuplicates(["__key"])
    return tickers.withColumn("__key", F.upper("ticker")).join(known, "__key", "left").drop("__key")


def filing_links(filings: DataFrame, base: str) -> DataFrame:
    return filings.withColumn("filing_url", filing_url(base, "cik", "accession_number", "primary_document"))


def articles(raw: DataFrame, most: int = 500) -> DataFrame:
    """Articles with '' for missing title, url and snippet, the snippet cut, score 0.0 by default, and the source's name."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.withColumns({"title": text("title"), "url": text("url"), "snippet": F.substring(text("snippet"), 1, most), "relevance_score": F.coalesce("relevance_score", F.lit(0.0)), "source": source_name("url")})


def or_else(*columns: Column | str) -> Column:
    """The first value that isn't null, 0 or ''."""
    pick = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*[F.when((c.cast("string") != "") & F.coalesce(c.try_cast("double") != 0, F.lit(True)), c) for c in pick])


def quotes(raw: DataFrame) -> DataFrame:
    """Quotes with current_price (else the regular market price), company_name (long, else short, else ticker) and success."""
    out = raw.withColumn("current_price", or_else("current_price", "regular_market_price")).withColumn("company_name", or_else("long_name", "short_name", "ticker"))
    return out.withColumn("success", F.col("error").isNull() & F.col("current_price").isNotNull())


CASE = "id string, ticker string, query string, filing_type string, expected_sections array<string>, expected_keywords array<string>, top_k int, mode string, notes string"


def load_retrieval_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Labelled cases from a JSON list, or with ``lines`` one a line, with their defaults."""
    return case_defaults(spark.read.schema(CASE).json(path, multiLine=not lines))


def case_defaults(raw: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return raw.withColumns({
        "ticker": F.upper("ticker"), "mode": F.lower("mode"), "top_k": F.coalesce("top_k", F.lit(5)), "filing_type": given("filing_type"),
        "expected_sections": F.coalesce("expected_sections", empty), "expected_keywords": F.coalesce("expected_keywords", empty),
    })


SAMPLE = "id string, ticker string, input string, expected_output string, tags array<string>, include_filing_analysis boolean, include_news_sentiment boolean, max_news_articles int"


def load_rag_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return memo_cases(spark.read.schema(SAMPLE).json(path, multiLine=not lines))


def memo_cases(raw: DataFrame) -> DataFrame:
    """Memo cases with their defaults and ``violations`` of their rules."""
    out = raw.withColumns({"ticker": F.upper(stripped("ticker")), "max_news_articles": F.coalesce("max_news_articles", F.lit(10))})
    rules = {"id": F.length("id") >= 1, "ticker": F.length("ticker").between(1, 10), "input": F.length("input") >= 1, "expected_output": F.length("expected_output") >= 1, "max_news_articles": F.col("max_news_articles").between(0, 20)}
    return out.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])))


def load_result_payload(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The rows of the ``results`` list of a JSON report, or with ``lines`` of many, one a line; rows without a case_id are left out, a missing list or a repeated id is an error."""
    raw = spark.read.json(path, multiLine=not lines)
    if "results" not in raw.columns:
        raise ValueError("the report has no list 'results'")
    rows = raw.select(F.explode("results").alias("r")).select("r.*").where(given("case_id").isNotNull())
    return checked_unique(rows, "case_id")


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1")


def checked_unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows``; raises if a key occurs twice."""
    twice = [r[0] for r in repeated_ids(rows, key).limit(10).collect()]
    if twice:
        raise ValueError(f"repeated {key}: {sorted(twice)}")
    return rows


def write_results(rows: DataFrame, summary: DataFrame, path: str, by: str = "mode") -> None:
    """Result rows as Parquet by mode, and the summary as a table of its own."""
    rows.write.mode("overwrite").partitionBy(by).parquet(f"{path}/results")
    summary.write.mode("overwrite").parquet(f"{path}/summary")
