"""Hits as evidence: packets, rendering, provenance, citation registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.functions.text import given, stripped


def listed(order: list[str], text: Column, separator: str) -> Column:
    """Aggregate: texts joined in an order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("__x"))))
    return F.array_join(F.transform(rows, lambda r: r["__x"]), separator)


def packets(hits: DataFrame, chunks: DataFrame, method: str) -> DataFrame:
    """Evidence packets of hits (query_id, chunk_id, rank, relevance)."""
    rows = hits.join(chunks, "chunk_id")
    return rows.select("query_id", "rank", F.upper("ticker").alias("ticker"), "text", "chunk_id", "filing_type", "filing_date", "section_name", F.col("relevance").alias("retrieval_score"), F.lit(method).alias("retrieval_method"))


def context(max_chars: int = 700) -> Column:
    """A packet as text: a header of what is known, then the text's beginning."""
    part = lambda label, c, shown=None: F.when(F.coalesce(given(F.col(shown or c).cast("string")).isNotNull(), F.lit(False)), F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    score = F.when(F.coalesce(F.col("retrieval_score") != 0, F.lit(False)), F.concat(F.lit("Score: "), F.format_string("%.3f", F.col("retrieval_score"))))
    header = F.concat_ws(" | ", part("Ticker", "ticker"), part("Section", "section_name"), part("Filing", "filing_type", "filing_date"), part("Filed", "filing_date"), part("Rank", "rank"), score)
    return F.concat(F.lit("["), F.coalesce(given(header), F.lit("Evidence Packet")), F.lit("]\n"), stripped(F.substring("text", 1, max_chars)))


def render_context(packets: DataFrame, most: int = 5, max_chars: int = 700) -> DataFrame:
    """(query_id, context): the first packets of each query as one text."""
    return packets.where(F.col("rank") <= most).groupBy("query_id").agg(listed(["rank"], context(max_chars), "\n\n").alias("context"))


def provenance(hits: DataFrame, dense: DataFrame, sparse: DataFrame, method: str) -> DataFrame:
    """Hits with the ranks, distance and score that they had in each source; distance becomes (rank - 1) / rank."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("distance").alias("dense_distance"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    rows = hits.select("query_id", "chunk_id", "rank").join(d, ["query_id", "chunk_id"], "left").join(s, ["query_id", "chunk_id"], "left")
    return rows.withColumn("distance", (F.col("rank") - 1) / F.col("rank")).withColumn("method", F.lit(method))


def citation_registry(articles: DataFrame, chunks: DataFrame, max_chunks: int = 5) -> DataFrame:
    """Numbered sources of each run: articles (run_id, pos, title, snippet, url, published_date, source) that have a snippet, then those of the first ``max_chunks``
    chunks (run_id, pos, section, filing_type, text, source_url, filing_date, chunk_id) that have a text."""
    news = articles.where(given("snippet").isNotNull()).select(
        "run_id", F.lit(0).alias("kind"), "pos", F.lit("news").alias("source_type"), F.coalesce("title", F.lit("Untitled")).alias("title"), stripped("snippet").alias("text"),
        F.coalesce("url", F.lit("")).alias("url"), F.col("published_date").alias("date"), F.coalesce("source", F.lit("Unknown")).alias("source"), F.lit(None).cast("string").alias("chunk_id"),
    )
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("pos"))
    filings = chunks.withColumn("__n", nth).where(F.col("__n") <= max_chunks).where(given("text").isNotNull()).select(
        "run_id", F.lit(1).alias("kind"), "pos", F.lit("sec_filing").alias("source_type"), F.concat_ws(" - ", F.coalesce("section", F.lit("Unknown")), F.coalesce("filing_type", F.lit("10-K"))).alias("title"), stripped("text").alias("text"),
        F.col("source_url").alias("url"), F.col("filing_date").alias("date"), F.lit(None).cast("string").alias("source"), "chunk_id",
    )
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("kind", "pos"))
    return news.unionByName(filings).withColumn("index", number).drop("kind", "pos")


def render_registry(runs: DataFrame, registry: DataFrame, most: int = 700) -> DataFrame:
    """(run_id, sources): the registry of each run as a numbered list, a fixed sentence if it has none."""
    meta = F.concat_ws(" | ", given("source_type"), given("source"), given("date"))
    entry = F.concat(F.format_string("[%d] %s", F.col("index"), F.col("title")), F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(F.lit("")), F.lit("\n"), F.substring("text", 1, most), F.lit("\n"))
    made = registry.groupBy("run_id").agg(listed(["index"], entry, "\n").alias("list"))
    none = "\n## Available Sources\nNo numbered evidence sources are available. Avoid unsupported factual claims."
    shown = F.concat(F.lit("\n## Available Sources (use these citation numbers exactly)\n"), F.col("list"))
    return runs.select("run_id").distinct().join(made, "run_id", "left").select("run_id", F.coalesce(shown, F.lit(none)).alias("sources"))


def api_citations(registry: DataFrame) -> DataFrame:
    return registry.select("run_id", "index", F.coalesce("source_type", F.lit("unknown")).alias("source_type"), F.coalesce("title", F.lit("Untitled")).alias("title"), "url", "date")


def registry_contexts(registry: DataFrame) -> DataFrame:
    """(run_id, contexts): texts that aren't blank, in the order of their numbers."""
    rows = registry.where(given("text").isNotNull()).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("index", "text"))).alias("r"))
    return rows.select("run_id", F.transform("r", lambda x: x["text"]).alias("contexts"))
