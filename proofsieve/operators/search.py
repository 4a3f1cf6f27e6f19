"""Answering a table of queries from a table of chunks: filters, exact vector search, BM25, fusion, re-scoring.

Queries have query_id and, where used, text, ticker, filing_type, section_key, section_name, filing_date and embedding; a null
filter column is no filter. Chunks have chunk_id, text, ticker, filing_type, section_key, section_name, filing_date, embedding. Hits are
(query_id, chunk_id, rank, ...), ties always to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofsieve.functions.terms import SIGNAL_TERMS
from proofsieve.functions.text import canonical_section_key, given, normalize_python, normalize_token, space_tokens, tokens
from proofsieve.operators.models import predict

#: So many rows, or bytes, of a table of queries are sent to every task at a time.
BROADCAST_QUERIES, BROADCAST_BYTES = 10_000, 32 << 20
#: So many terms that are asked for may be sent to every task; more are met by a shuffled join.
BROADCAST_TERMS = 500_000


def top(rows: DataFrame, k: int | Column, *order: Column | str, by: str | list[str] = "query_id", rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each ``by`` in an order, with their rank from 1."""
    keys = [by] if isinstance(by, str) else by
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def meets(query: str, chunk: str, strict: bool = False) -> Column:
    """Whether a chunk passes a query's filters. Unless ``strict``, a section key wins over a section name."""
    q, c = (lambda n: F.col(f"{query}.{n}")), (lambda n: F.col(f"{chunk}.{n}"))
    same = lambda n: q(n).isNull() | (q(n) == c(n))
    named = same("section_name")
    section = same("section_key") & (named if strict else q("section_key").isNotNull() | named)
    return (q("ticker").isNull() | (F.upper(q("ticker")) == c("ticker"))) & same("filing_type") & same("filing_date") & section


def in_rounds(queries: DataFrame) -> list[tuple[bool, DataFrame]]:
    """(whether they have a ticker, queries): parts of a checked size, to be sent to every task one after the other."""
    sizes = {"text": F.octet_length} | {c: lambda x: 8 * F.size(x) for c in ("embedding", "q_embedding", "__q")}
    width = sum([F.coalesce(sizes[c](F.col(c)), F.lit(0)) for c in queries.columns if c in sizes], F.lit(200))
    scoped, out = F.col("ticker").isNotNull(), []
    for r in queries.groupBy(scoped.alias("scoped")).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).collect():
        rounds = max(-(-r.n // BROADCAST_QUERIES), -(-r.bytes // BROADCAST_BYTES))
        own = queries.where(scoped if r.scoped else ~scoped)
        out += [(r.scoped, own.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == k) if rounds > 1 else own) for k in range(rounds)]
    return out or [(True, queries.limit(0))]


def candidates(queries: DataFrame, chunks: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs (q.*, c.*) that pass the filters. Queries are sent to every task, in rounds of a checked size, so that chunks stay where they are and no
    ticker's chunks meet in one task; those with a ticker are looked up by it."""
    on = meets("q", "c", strict)
    by_ticker = (F.upper("q.ticker") == F.col("c.ticker")) & on
    parts = [chunks.alias("c").join(F.broadcast(part).alias("q"), by_ticker if scoped else on).select("q.*", "c.*") for scoped, part in in_rounds(queries)]
    return reduce(DataFrame.union, parts)


def count_documents(queries: DataFrame, chunks: DataFrame, strict: bool = False) -> DataFrame:
    """(query_id, n): chunks that pass each query's filters, 0 included."""
    n = candidates(queries, chunks.drop("text", "embedding"), strict).groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str, norms: Column | None = None) -> Column:
    """``norms``: the product of both norms, where they are known."""
    if metric == "cosine":
        return F.greatest(F.lit(0.0), 1 - dot(a, b) / (norm(a) * norm(b) if norms is None else norms))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y), F.lit(0.0), lambda s, x: s + x * x))


def relevance(d: Column) -> Column:
    return 1 / (1 + d)


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, metric: str = "cosine", digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, rank, distance, relevance) of the nearest chunks under the filters, of those that have a vector; distances rounded before ranking."""
    # Norms are taken once a row, so a pair costs one inner product.
    there = chunks.drop("text").where("embedding is not null").withColumnRenamed("embedding", "c_embedding").withColumn("c_norm", norm(F.col("c_embedding")))
    asked = queries.withColumnRenamed("embedding", "q_embedding").withColumn("q_norm", norm(F.col("q_embedding")))
    pairs = candidates(asked, there)
    d = F.round(distance(F.col("q_embedding"), F.col("c_embedding"), metric, F.col("q_norm") * F.col("c_norm")), digits)
    near = top(pairs.select("query_id", "chunk_id", d.alias("distance")), k, "distance", "chunk_id")
    return near.select("query_id", "chunk_id", "rank", "distance", relevance(F.col("distance")).alias("relevance"))


def section_fallback(queries: DataFrame, chunks: DataFrame, k: int = 5, metric: str = "cosine") -> DataFrame:
    """Nearest chunks of a query's ``section``: by canonical key, or if that finds nothing by display name, or else by the name as given. Keeps which way it was (strategy 0, 1, 2)."""
    from proofsieve.functions.text import section_descriptor

    q = queries.withColumn("__key", canonical_section_key("section")).withColumn("__display", section_descriptor("section")["display_name"]).withColumnRenamed("embedding", "__q")
    c = chunks.where("embedding is not null").select("chunk_id", F.col("ticker").alias("__ticker"), F.col("section_key").alias("__c_key"), F.col("section_name").alias("__c_name"), F.col("embedding").alias("__c"))
    way = F.when(F.col("__key") == F.col("__c_key"), 0).when(F.col("__display") == F.col("__c_name"), 1).when(F.col("section") == F.col("__c_name"), 2)
    met = [c.join(F.broadcast(part), F.upper("ticker") == F.col("__ticker")) for scoped, part in in_rounds(q) if scoped]
    pairs = reduce(DataFrame.union, met or [c.join(q.limit(0), F.upper("ticker") == F.col("__ticker"))]).withColumn("strategy", way).where("strategy is not null")
    used = pairs.groupBy("query_id", "section").agg(F.min("strategy").alias("strategy"))
    kept = pairs.hint("merge").join(used.hint("merge"), ["query_id", "section", "strategy"])
    d = F.round(distance(F.col("__q"), F.col("__c"), metric), 9)
    near = top(kept.select("query_id", "section", "strategy", "chunk_id", d.alias("distance")), k, "distance", "chunk_id", by=["query_id", "section"])
    return near.withColumn("relevance", relevance(F.col("distance")))


def search_sections(queries: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """Best chunks over a query's ``sections``: the fallback search in each, of a chunk found twice the first section's hit, by relevance."""
    each = queries.select("*", F.posexplode("sections").alias("section_pos", "section")).drop("sections")
    hits = section_fallback(each, chunks, k).hint("merge").join(each.select("query_id", "section", "section_pos").distinct().hint("merge"), ["query_id", "section"])
    first = top(hits.drop("rank"), 1, "section_pos", by=["query_id", "chunk_id"], rank="__n").drop("__n")
    return top(first, k, F.col("relevance").desc(), "chunk_id").select("query_id", "chunk_id", "rank", "section", "distance", "relevance")


def signal_terms(spark: SparkSession) -> DataFrame:
    """(section_key, term, token, weight): weight 2.5 for three words and more, 1.75 for two, 1 for one."""
    rows = [(key, term, token, {1: 1.0, 2: 1.75}.get(len(token.split()), 2.5)) for key, terms in SIGNAL_TERMS.items() for term in terms for token in [normalize_python(term)]]
    return spark.createDataFrame(rows, "section_key string, term string, token string, weight double")


def section_intent(queries: DataFrame, max_sections: int = 3) -> DataFrame:
    """(query_id, target_sections, confidence, matched_terms, section_scores) for each query.

    A term counts if its normalized form is in the normalized text. The table of terms is a fixed list of under a hundred rows.
    """
    q = queries.select("query_id", normalize_token("text").alias("__n"))
    hit = q.join(F.broadcast(signal_terms(queries.sparkSession)), F.contains(F.col("__n"), F.col("token")))
    per = hit.groupBy("query_id", "section_key").agg(F.sum("weight").alias("score"), F.collect_set(F.struct("token", "term")).alias("terms"))
    out = per.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("section_key").alias("k")))).alias("ranked"), F.max("score").alias("best"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"),
    )
    empty = F.array().cast("array<string>")
    scores = F.map_from_entries(F.transform("ranked", lambda x: F.struct(x["k"], F.round(-x["s"], 4))))
    return queries.select("query_id").join(out, "query_id", "left").select(
        "query_id", F.coalesce(F.slice(F.transform("ranked", lambda x: x["k"]), 1, max_sections), empty).alias("target_sections"),
        F.when(F.col("best") > 0, F.round(F.least(F.lit(0.95), F.col("best") / (F.col("best") + 2)), 4)).otherwise(0.0).alias("confidence"),
        F.coalesce(F.transform("terms", lambda x: x["term"]), empty).alias("matched_terms"), F.coalesce(scores, F.create_map().cast("map<string,double>")).alias("section_scores"),
    )


def matched_in(text: Column, terms: Column) -> Column:
    """How many of the terms are in a text, both normalized; the text once, as the start of the count."""
    start = F.struct(normalize_token(text).alias("t"), F.lit(0).alias("n"))
    step = lambda s, term: F.struct(s["t"].alias("t"), (s["n"] + F.coalesce(F.contains(s["t"], normalize_token(term)).cast("int"), F.lit(0))).alias("n"))
    return F.coalesce(F.aggregate(terms, start, step, lambda s: s["n"]), F.lit(0))


def section_aware_search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Vector hits of the ticker and of the inferred sections; relevance + 0.35 in a target section + 0.05 if found there + up to 0.15 for matched terms."""
    intent = section_intent(queries)
    q = queries.hint("merge").join(intent.hint("merge").select("query_id", "target_sections", "matched_terms"), "query_id")
    plain = q.select("query_id", "text", "ticker", "embedding", *[F.lit(None).cast("string").alias(c) for c in ("filing_type", "filing_date", "section_key", "section_name")])
    wide = max(k, 8)
    general = dense_topk(plain, chunks, wide).select("query_id", "chunk_id", "distance", "relevance", F.lit(False).alias("targeted"))
    aimed = search_sections(q.where(F.size("target_sections") > 0).select("query_id", "ticker", "embedding", F.col("target_sections").alias("sections")), chunks, wide).select("query_id", "chunk_id", "distance", "relevance", F.lit(True).alias("targeted"))
    found = general.unionByName(aimed).groupBy("query_id", "chunk_id").agg(F.min("distance").alias("distance"), F.max("relevance").alias("relevance"), F.max("targeted").alias("targeted"))
    rows = found.hint("merge").join(q.select("query_id", "target_sections", "matched_terms").hint("merge"), "query_id").hint("merge").join(chunks.select("chunk_id", "text", "section_key").hint("merge"), "chunk_id")
    final = F.col("relevance") + F.when(F.array_contains("target_sections", F.col("section_key")), 0.35).otherwise(0.0) + F.when(F.col("targeted"), 0.05).otherwise(0.0) + F.least(F.lit(0.15), 0.03 * matched_in(F.col("text"), F.col("matched_terms")))
    return top(rows.withColumn("score", F.round(final, 6)), k, F.col("score").desc(), "chunk_id").select("query_id", "chunk_id", "rank", "score", "targeted", "distance")


SCOPE = ["ticker", "filing_type"]


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 20, scope: list[str] | None = None, k1: float = 1.5, b: float = 0.75, digits: int = 6, split: Callable[[str], Column] = tokens, pad: bool = False) -> DataFrame:
    """(query_id, chunk_id, rank, score) by BM25 with smoothed idf, counts per scope (columns of both tables). ``split`` is the tokenizer. Chunks without a common term are no hits;
    with ``pad`` those of the scope that have text follow at score 0 until there are ``k``.

    The corpus is tokenized once. A term's row is dropped where it stands unless it is asked for in its scope, by a hash join with the terms if these are
    few enough to be sent to every task, and only what is left is counted and shuffled; one row without a term tells of each chunk's length.
    """
    scope = scope if scope is not None else ["ticker"]
    asked = queries.select("query_id", *scope, F.explode(F.array_distinct(split("text"))).alias("term"))
    terms = asked.select(*scope, "term").distinct().withColumn("__asked", F.lit(True))
    words = corpus.select(*scope, "chunk_id", split("text").alias("__t")).withColumn("dl", F.size("__t"))
    each = words.select(*scope, "chunk_id", "dl", F.explode(F.concat(F.array(F.lit("")), F.coalesce("__t", F.array().cast("array<string>")))).alias("term"))
    few = terms.count() <= BROADCAST_TERMS
    used = (each.join(F.broadcast(terms), [*scope, "term"], "left") if few else each.hint("merge").join(terms.hint("merge"), [*scope, "term"], "left")).where("__asked or term = ''")
    every = used.groupBy(*scope, "term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    stats = every.where("term = ''").groupBy(*scope).agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).alias("avgdl"))
    post = every.where("term <> ''")
    df = post.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = post.hint("merge").join(df.hint("merge").join(stats.hint("merge"), scope).hint("merge"), [*scope, "term"]).select(*scope, "term", "chunk_id", weight.alias("w"))
    parts = asked.hint("merge").join(weighed.hint("merge"), [*scope, "term"]).select("query_id", "chunk_id", "w")
    if pad:
        # Fewer than k hits leave enough of a scope's first k chunks to fill up with.
        nth = F.dense_rank().over(Window.partitionBy(*scope).orderBy("chunk_id"))
        first = corpus.where(given("text").isNotNull()).select(*scope, "chunk_id").withColumn("__n", nth).where(F.col("__n") <= k)
        parts = parts.union(queries.select("query_id", *scope).hint("merge").join(first.hint("merge"), scope).select("query_id", "chunk_id", F.lit(0.0)))
    scored = parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("w"), digits).alias("score"))
    return top(scored, k, F.col("score").desc(), "chunk_id").select("query_id", "chunk_id", "rank", "score")


def rrf_fuse(*ranked: tuple[DataFrame, float], c: int = 60, digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, rank, fused): weighted reciprocal rank fusion of (hits, weight)."""
    if not sum(w for _, w in ranked):
        raise ValueError("all weights are 0")
    parts = None
    for hits, w in ranked:
        own = hits.select("query_id", "chunk_id", (w / (c + F.col("rank"))).alias("part"))
        parts = own if parts is None else parts.union(own)
    fused = parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), digits).alias("fused"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "chunk_id")))


def overlap_share(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that are in the text."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)), F.lit(0.0))


def overlap_rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Hits by overlap with the query, then by their rank; distance becomes (rank - 1) / rank."""
    asked, there = queries.select("query_id", F.col("text").alias("__q")), chunks.select("chunk_id", F.col("text").alias("__c"))
    rows = fused.withColumnRenamed("rank", "fused_rank").hint("merge").join(asked.hint("merge"), "query_id").hint("merge").join(there.hint("merge"), "chunk_id")
    rows = rows.withColumn("overlap", F.round(overlap_share(F.col("__q"), F.col("__c")), 9)).drop("__q", "__c")
    return top(rows, k, F.col("overlap").desc(), "fused_rank").withColumn("distance", (F.col("rank") - 1) / F.col("rank"))


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 5, wide: int = 20, weights: tuple[float, float] = (0.65, 0.35)) -> DataFrame:
    """Dense and BM25 hits fused by rank, then ordered by overlap. A query whose ticker has no text has dense hits alone and says so in ``mode``."""
    dense, sparse = dense_topk(queries, chunks, wide), bm25_topk(queries, chunks, wide)
    out = overlap_rerank(rrf_fuse((dense, weights[0]), (sparse, weights[1])), queries, chunks, k)
    there = chunks.where(given("text").isNotNull()).select("ticker").distinct()
    has = queries.select("query_id", F.upper("ticker").alias("ticker")).join(there, "ticker", "left_semi").select("query_id", F.lit("hybrid").alias("mode"))
    return out.join(has, "query_id", "left").withColumn("mode", F.coalesce("mode", F.lit("dense_fallback"))).select("query_id", "chunk_id", "rank", "overlap", "fused_rank", "distance", "mode")


def merge_candidates(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Union by chunk with both ranks, best_rank (10000 if none) and sources, in the order of the best rank."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    rows = d.join(s, ["query_id", "chunk_id"], "full_outer")
    best = F.least(F.coalesce("dense_rank", F.lit(10_000)), F.coalesce("bm25_rank", F.lit(10_000)))
    sources = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("bm25_rank").isNotNull(), "bm25")))
    return rows.withColumn("best_rank", best).withColumn("sources", sources)


def with_texts(rows: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds ``__q`` and ``__c``, the texts of query and chunk, and ``__section``, the chunk's; rows that have them stay as they are."""
    if "__c" in rows.columns:
        return rows
    asked, there = queries.select("query_id", F.col("text").alias("__q")), chunks.select("chunk_id", F.col("text").alias("__c"), F.col("section_key").alias("__section"))
    return rows.hint("merge").join(asked.hint("merge"), "query_id").hint("merge").join(there.hint("merge"), "chunk_id")


def rerank(rows: DataFrame, queries: DataFrame, chunks: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]] | None = None, batch_size: int = 16, most: int = 4000, strict: bool = True) -> DataFrame:
    """Adds ``reranker_score`` of (query, text cut to ``most``): by a user's scorer, made once a task, which must return a score for each pair or the job fails; else the overlap.
    Without ``strict`` a pair that it fails on has no score, and the column ``error`` says why."""
    both, cut, given_texts = with_texts(rows, queries, chunks), F.substring("__c", 1, most), "__c" in rows.columns
    drop = [] if given_texts else ["__q", "__c", "__section"]
    if make is None:
        return both.withColumn("reranker_score", F.round(overlap_share(F.col("__q"), cut), 9)).drop(*drop)
    pairs = both.withColumns({"__asked": F.coalesce("__q", F.lit("")), "__cut": F.coalesce(cut, F.lit(""))})
    return predict(pairs, make, ["__asked", "__cut"], "reranker_score", "double", batch_size, strict).drop("__asked", "__cut", *drop, *(["error"] if strict else []))


def priors(rows: DataFrame, queries: DataFrame, intent: DataFrame, chunks: DataFrame, use: bool = True) -> DataFrame:
    """Adds section_prior (0.20 in a target section) and keyword_prior (0.03 a matched term, 0.15 at most)."""
    drop = [] if "__c" in rows.columns else ["__q", "__c", "__section"]
    if not use:
        return rows.withColumn("section_prior", F.lit(0.0)).withColumn("keyword_prior", F.lit(0.0))
    both = with_texts(rows, queries, chunks).hint("merge").join(intent.select("query_id", "target_sections", "matched_terms").hint("merge"), "query_id")
    section = F.when(F.array_contains("target_sections", F.col("__section")), 0.20).otherwise(0.0)
    return both.withColumn("section_prior", section).withColumn("keyword_prior", F.least(F.lit(0.15), F.round(0.03 * matched_in(F.col("__c"), F.col("matched_terms")), 9))).drop(*drop, "target_sections", "matched_terms")


def reranked_search(queries: DataFrame, chunks: DataFrame, k: int = 5, wide: int = 30, make: Callable | None = None, fail_open: bool = False) -> DataFrame:
    """Dense and BM25 candidates (white-space words, case kept), re-scored with priors; ``fail_open`` plans the dense order instead of the scorer."""
    if k > 2 * wide:
        raise ValueError("k is larger than the number of candidates")
    dense = dense_topk(queries, chunks, wide)
    if fail_open:
        return dense.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", (1 / F.col("rank")).alias("final_score"))
    rows = with_texts(merge_candidates(dense, bm25_topk(queries, chunks, wide, split=space_tokens)), queries, chunks)
    scored = priors(rerank(rows, queries, chunks, make), queries, section_intent(queries), chunks)
    final = F.round(F.col("reranker_score") + F.col("section_prior") + F.col("keyword_prior"), 6)
    return top(scored.withColumn("final_score", final), k, F.col("final_score").desc(), "best_rank", "chunk_id").select("query_id", "chunk_id", "rank", "dense_rank", "bm25_rank", "reranker_score", "section_prior", "keyword_prior", "final_score", "sources")


#: The questions asked of each company.
TEMPLATES = ["{} business description overview", "{} risk factors challenges", "{} financial performance revenue", "{} competition market position"]


def multi_query(entities: DataFrame, chunks: DataFrame, per_query: int = 3, k: int = 10) -> DataFrame:
    """Four questions for each entity (entity_id, name, ticker), by BM25 in its ticker, ``per_query`` hits each; texts that begin with the same 100 characters count once; the best ``k``."""
    asked = F.array(*[F.concat(*[x for part in t.split("{}") for x in (F.lit(part), F.col("name"))][:-1]) for t in TEMPLATES])
    q = entities.select("entity_id", "ticker", F.posexplode(asked).alias("query_no", "text")).withColumn("query_id", F.concat_ws("#", "entity_id", "query_no"))
    hits = bm25_topk(q, chunks, per_query).hint("merge").join(q.select("query_id", "entity_id", "query_no").hint("merge"), "query_id").hint("merge").join(chunks.select("chunk_id", F.md5(F.substring("text", 1, 100)).alias("head")).hint("merge"), "chunk_id")
    first = top(hits, 1, "query_no", "rank", by=["entity_id", "head"], rank="__n").drop("__n", "rank")
    return top(first, k, F.col("score").desc(), "chunk_id", by="entity_id").select("entity_id", "chunk_id", "rank", "query_no", "score")
