"""Claims of memos against their cited evidence, memo quality, and the state of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.functions.text import citations, content_tokens, given, is_claim, numbers, sentences, strip_citations, stripped
from proofsieve.operators.evidence import listed


def used_citations(memos: DataFrame) -> DataFrame:
    return memos.select("memo_id", F.array_sort(F.array_distinct(citations("text"))).alias("used"))


def orphan_citations(memos: DataFrame, evidence: DataFrame) -> DataFrame:
    """(memo_id, index): cited numbers that the memo has no source for."""
    used = memos.select("memo_id", F.explode(F.array_distinct(citations("text"))).alias("index"))
    return used.hint("merge").join(evidence.select("memo_id", "index").hint("merge"), ["memo_id", "index"], "left_anti")


def claim_sentences(memos: DataFrame) -> DataFrame:
    """(memo_id, pos, sentence, claim, citations): the claims of each memo, citations stripped from ``claim``."""
    rows = memos.select("memo_id", F.posexplode(sentences("text")).alias("pos", "sentence")).where(is_claim("sentence"))
    return rows.select("memo_id", "pos", "sentence", strip_citations("sentence").alias("claim"), citations("sentence").alias("citations"))


MISSING, NUMBERS, UNALIGNED = "claim is missing a citation", "claim numbers do not match cited evidence", "claim does not align with cited evidence"


def assess_claims(memos: DataFrame, evidence: DataFrame, least: float = 0.20) -> DataFrame:
    """One row for each claim: overlap with its best citation (the first one on ties), supported, missing_citation, reason.

    A citation counts with a share of the claim's words above 0. It supports the claim from ``least`` on if it has all the claim's numbers.
    """
    claims = claim_sentences(memos).withColumn("words", F.array_distinct(content_tokens("claim"))).withColumn("figures", numbers("claim"))
    sources = evidence.select("memo_id", "index", F.array_distinct(content_tokens("text")).alias("e_words"), numbers("text").alias("e_figures"))
    cited = claims.select("memo_id", "pos", "words", "figures", F.posexplode("citations").alias("at", "index")).hint("merge").join(sources.hint("merge"), ["memo_id", "index"])
    overlap = F.when(F.size("words") > 0, F.size(F.array_intersect("words", "e_words")) / F.size("words")).otherwise(0.0)
    fits = F.size(F.array_except("figures", "e_figures")) == 0
    scored = cited.select("memo_id", "pos", F.struct(overlap.alias("overlap"), (-F.col("at")).alias("first"), fits.alias("fits")).alias("c")).where("c.overlap > 0")
    best = scored.groupBy("memo_id", "pos").agg(F.max("c").alias("best"))
    rows = claims.hint("merge").join(best.hint("merge"), ["memo_id", "pos"], "left")
    score, match = F.coalesce("best.overlap", F.lit(0.0)), F.coalesce("best.fits", F.lit(False))
    missing = F.size("citations") == 0
    supported = (score >= least) & match
    reason = F.when(missing, MISSING).when(supported, None).when((F.size("figures") > 0) & ~match, NUMBERS).otherwise(UNALIGNED)
    return rows.select("memo_id", "pos", "claim", "citations", score.alias("overlap_score"), (supported & ~missing).alias("supported"), missing.alias("missing_citation"), reason.alias("reason"))


def memo_verdict(memos: DataFrame, evidence: DataFrame, min_coverage: float = 0.80, min_grounded: float = 0.75) -> DataFrame:
    """Totals and rates of each memo, and whether it passes; a cited number without a source fails it. A memo without claims has zeros and fails."""
    per = assess_claims(memos, evidence).groupBy("memo_id").agg(F.count("*").alias("total"), F.count_if(~F.col("missing_citation")).alias("cited"), F.count_if("supported").alias("grounded"))
    orphans = orphan_citations(memos, evidence).groupBy("memo_id").agg(F.sort_array(F.collect_set("index")).alias("orphans"))
    rows = memos.select("memo_id").hint("merge").join(per.hint("merge"), "memo_id", "left").hint("merge").join(orphans.hint("merge"), "memo_id", "left").na.fill(0, ["total", "cited", "grounded"])
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = rows.withColumn("coverage", rate("cited", "total")).withColumn("grounded_rate", rate("grounded", "cited")).withColumn("orphans", F.coalesce("orphans", F.array().cast("array<int>")))
    passed = (F.col("total") > 0) & (F.col("coverage") >= min_coverage) & (F.col("grounded_rate") >= min_grounded) & (F.size("orphans") == 0)
    return rows.withColumn("passed", passed)


def executive_summary(memo: Column | str, company: Column | str, most: int = 500) -> Column:
    """What follows 'Executive Summary' up to an empty line, without #, or a fixed sentence."""
    text = F.col(memo) if isinstance(memo, str) else memo
    after = F.split_part(F.get(F.split(text, "Executive Summary"), F.lit(1)), F.lit("\n\n"), F.lit(1))
    clean = F.substring(stripped(F.regexp_replace(stripped(after), "^#+|#+$", "")), 1, most)
    return F.coalesce(given(clean), F.concat(F.lit("Analysis completed for "), F.col(company) if isinstance(company, str) else company))


def memo_quality(memos: DataFrame, compat: bool = False) -> DataFrame:
    """(memo_id, score, issues) of memos (memo_id, ticker, text): from 1.0 less a penalty for each issue, 0 at least; ``compat`` starts from 0."""
    low = F.lower("text")
    sections = F.size(F.filter(F.array(*[F.lit(s) for s in ("summary", "overview", "risk", "financial", "conclusion")]), lambda s: F.contains(low, s)))
    words = F.size(F.filter(F.split("text", r"[ \t\r\n\f]+"), lambda x: x != ""))
    figures = F.size(F.regexp_extract_all("text", F.lit(r"\$[0-9,]+|[0-9]+%"), F.lit(0)))
    checks = [
        ("short", words < 200, 0.3), ("ticker missing", ~F.contains(F.upper("text"), F.upper("ticker")), 0.2), ("sections", sections < 3, 0.2),
        ("no citations", ~(F.contains("text", F.lit("[1]")) | F.contains("text", F.lit("Source:"))), 0.1), ("few numbers", figures < 3, 0.1),
    ]
    lost = sum((F.when(bad, p).otherwise(0.0) for _, bad, p in checks), F.lit(0.0))
    return memos.select("memo_id", F.round(F.greatest(F.lit(0.0), F.lit(0.0 if compat else 1.0) - lost), 4).alias("score"), F.array_compact(F.array(*[F.when(bad, name) for name, bad, _ in checks])).alias("issues"))


def completeness(runs: DataFrame, parts: list[str], scores: list[str], needed: str, least: float = 0.6) -> DataFrame:
    """Adds completeness, the share of the flags ``parts`` that hold, overall, its mean with those of ``scores`` that are known, and passed."""
    share = sum((F.col(p).cast("double") for p in parts), F.lit(0.0)) / len(parts)
    known = F.array_compact(F.array(*[F.col(s).cast("double") for s in scores], F.col("completeness")))
    overall = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return runs.withColumn("completeness", share).withColumn("overall", overall).withColumn("passed", (F.col("overall") >= least) & F.col(needed))


def data_availability(runs: DataFrame, **sources: DataFrame) -> DataFrame:
    """(run_id, has_<source>..., missing): which sources have rows for a run; ``missing`` names the others."""
    out = runs.select("run_id").distinct()
    for name, rows in sources.items():
        out = out.join(rows.select("run_id").distinct().withColumn(f"has_{name}", F.lit(True)), "run_id", "left")
    out = out.na.fill(False)
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(~F.col(f"has_{n}"), n) for n in sources])))


def assemble_context(runs: DataFrame, quotes: DataFrame, articles: DataFrame, sentiment: DataFrame, chunks: DataFrame, most_chunks: int = 5) -> DataFrame:
    """(run_id, context): quote, articles (200 characters), sentiment and the first chunks (500 characters) of each run as one text; a part without data is left out."""
    text = lambda c, none="N/A": F.coalesce(F.col(c).cast("string"), F.lit(none))
    q = quotes.select("run_id", F.concat(F.lit("## Stock Data\nCompany: "), text("company_name"), F.lit("\nPrice: $"), text("current_price"), F.lit("\nSector: "), text("sector"), F.lit("\n")).alias("a"))
    item = F.concat(F.lit("- "), text("title", "Untitled"), F.lit("\n  Source: "), text("source", "Unknown"), F.lit("\n  "), F.substring(F.coalesce("snippet", F.lit("")), 1, 200), F.lit("\n"))
    n = articles.groupBy("run_id").agg(F.concat(F.lit("## Recent News\n"), listed(["pos"], item, "\n")).alias("b"))
    s = sentiment.select("run_id", F.concat(F.lit("## Sentiment Analysis\nOverall: "), text("overall_sentiment"), F.lit("\nPositive: "), text("positive_count", "0"), F.lit(" articles\nNegative: "), text("negative_count", "0"), F.lit(" articles\n")).alias("c"))
    piece = F.concat(F.lit("- "), text("section", "Unknown Section"), F.lit("\n  "), F.substring(F.coalesce("text", F.lit("")), 1, 500), F.lit("\n"))
    k = chunks.where(F.col("pos") < most_chunks).groupBy("run_id").agg(F.concat(F.lit("## SEC Filing Excerpts\n"), listed(["pos"], piece, "\n")).alias("d"))
    rows = runs.select("run_id").distinct()
    for part in (q, n, s, k):
        rows = rows.join(part, "run_id", "left")
    return rows.select("run_id", F.concat_ws("\n", "a", "b", "c", "d").alias("context"))


def append_errors(errors: DataFrame, new: DataFrame) -> DataFrame:
    return errors.unionByName(new)


def run_error_state(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """(run_id, step, n_errors): the run's step, or 'error' once it has an error that isn't recoverable."""
    per = errors.groupBy("run_id").agg(F.count("*").alias("n"), F.bool_or(~F.col("recoverable")).alias("fatal"))
    rows = runs.join(per, "run_id", "left")
    return rows.select("run_id", F.when(F.coalesce("fatal", F.lit(False)), "error").otherwise(F.col("step")).alias("step"), F.coalesce("n", F.lit(0)).alias("n_errors"))
