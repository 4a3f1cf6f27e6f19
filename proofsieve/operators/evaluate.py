"""Scoring retrieval against labelled cases, and comparing methods case by case.

Cases: case_id, expected_sections, expected_keywords. Packets: case_id, rank, section_name, text. Results: one row a case with its metrics.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.functions.text import canonical_section_key, eval_normalize, given, stripped
from proofsieve.operators.models import predict

K = 5


def section_key(name: Column | str) -> Column:
    """Canonical key of a section, else its name in lower case; null if blank."""
    return F.when(given(name).isNotNull(), F.coalesce(canonical_section_key(name), F.lower(stripped(name))))


def prepared(cases: DataFrame) -> DataFrame:
    """Cases with expected section keys and keyword tokens, each once."""
    keys = F.array_distinct(F.filter(F.transform("expected_sections", section_key), lambda x: x.isNotNull()))
    words = F.filter(F.transform("expected_keywords", eval_normalize), lambda x: x != "")
    return cases.withColumn("keys", keys).withColumn("words", words)


def relevance_flags(cases: DataFrame, packets: DataFrame) -> DataFrame:
    """(case_id, rank, relevant): a packet is relevant by its section or by any keyword."""
    rows = packets.join(prepared(cases).select("case_id", "keys", "words"), "case_id")
    text = eval_normalize("text")
    relevant = F.coalesce(F.array_contains("keys", section_key("section_name")), F.lit(False)) | F.exists("words", lambda w: F.contains(text, w))
    return rows.select("case_id", "rank", relevant.alias("relevant"))


def ranking_metrics(cases: DataFrame, packets: DataFrame, k: int = K) -> DataFrame:
    """(case_id, precision, mrr, ndcg) at ``k``; cases without packets have zeros."""
    flags = relevance_flags(cases, packets).where(F.col("rank") <= k)
    gain = F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = flags.groupBy("case_id").agg(F.count_if("relevant").alias("n"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = cases.select("case_id").join(per, "case_id", "left")
    return rows.select("case_id", (F.coalesce("n", F.lit(0)) / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.coalesce("n", F.lit(0)) > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def target_recall(cases: DataFrame, packets: DataFrame, k: int = K) -> DataFrame:
    """(case_id, recall): the share of expected sections and keywords that the first ``k`` packets have; keywords are looked for in their texts, joined."""
    rows = packets.where(F.col("rank") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", eval_normalize("text").alias("t")))), lambda r: r["t"]), " ")
    seen = rows.groupBy("case_id").agg(F.collect_set(section_key("section_name")).alias("seen"), joined.alias("joined"), F.count("*").alias("n"))
    both = prepared(cases).join(seen, "case_id", "left")
    hits = F.coalesce(F.size(F.array_intersect("keys", "seen")), F.lit(0)) + F.size(F.filter("words", lambda w: F.coalesce(F.contains(F.col("joined"), w), F.lit(False))))
    targets = F.size("keys") + F.size("words")
    hits = F.when(F.col("n").isNotNull(), hits).otherwise(0)
    return both.select("case_id", F.when(targets > 0, hits / targets).when(F.col("n").isNotNull(), 1.0).otherwise(0.0).alias("recall"))


def section_metrics(cases: DataFrame, packets: DataFrame) -> DataFrame:
    """(case_id, section_hit, section_recall) over all packets; nothing expected: hit if there is a packet, recall 1."""
    seen = packets.groupBy("case_id").agg(F.collect_set(section_key("section_name")).alias("seen"), F.count("*").alias("n"))
    rows = prepared(cases).join(seen, "case_id", "left")
    found = F.coalesce(F.size(F.array_intersect("keys", "seen")), F.lit(0))
    found = F.when(F.col("seen").isNotNull(), found).otherwise(0)
    some = F.size("keys") > 0
    return rows.select("case_id", F.when(some, found > 0).otherwise(F.col("n").isNotNull()).alias("section_hit"), F.when(some, found / F.size("keys")).otherwise(1.0).alias("section_recall"))


def matched_keywords(cases: DataFrame, packets: DataFrame) -> DataFrame:
    """(case_id, matched, hit_rate): expected keywords that are in any one packet, in their order; nothing expected: 1.

    Each packet marks the keywords that it has, so the texts of a case are never gathered.
    """
    words = cases.select("case_id", F.transform("expected_keywords", eval_normalize).alias("w"))
    text = eval_normalize("text")
    here = packets.join(words, "case_id").select("case_id", F.transform("w", lambda x: F.when((x != "") & F.contains(text, x), 1).otherwise(0)).alias("h"))
    marks = here.select("case_id", F.posexplode("h").alias("i", "hit")).where("hit = 1").groupBy("case_id").agg(F.collect_set("i").alias("there"))
    rows = cases.select("case_id", "expected_keywords").hint("merge").join(marks.hint("merge"), "case_id", "left").withColumn("there", F.coalesce("there", F.array().cast("array<int>")))
    matched = F.filter("expected_keywords", lambda x, i: F.array_contains(F.col("there"), i))
    n = F.size("expected_keywords")
    return rows.select("case_id", matched.alias("matched"), F.when(n > 0, F.size(matched) / n).otherwise(1.0).alias("hit_rate"))


def first_relevant_rank(cases: DataFrame, packets: DataFrame) -> DataFrame:
    """(case_id, first_rank): by the section's name as written, or by a matched keyword; null if none."""
    want = cases.join(matched_keywords(cases, packets).select("case_id", "matched"), "case_id").select("case_id", F.transform("expected_sections", eval_normalize).alias("s"), F.transform("matched", F.lower).alias("m"))
    low = F.lower("text")
    ok = F.coalesce(F.array_contains("s", eval_normalize("section_name")), F.lit(False)) | F.exists("m", lambda w: F.contains(low, w))
    first = packets.join(want, "case_id").where(ok).groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    return cases.select("case_id").join(first, "case_id", "left")


def retrieved_sections(packets: DataFrame) -> DataFrame:
    """(case_id, sections): names in the order of their first rank, of names that differ only in case the first one."""
    named = packets.where(given("section_name").isNotNull())
    first = named.groupBy("case_id", eval_normalize("section_name").alias("k")).agg(F.min(F.struct("rank", "section_name")).alias("f"))
    return first.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["section_name"]).alias("sections"))


def case_metrics(cases: DataFrame, packets: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """All metrics of each case, with its verdict: it fails if an expected section isn't hit or nothing was retrieved."""
    out = cases.select("case_id", F.size("expected_sections").alias("__e"))
    n = packets.groupBy("case_id").agg(F.count("*").alias("retrieved_count"))
    for part in (n, ranking_metrics(cases, packets), target_recall(cases, packets), section_metrics(cases, packets), matched_keywords(cases, packets).select("case_id", "hit_rate"), first_relevant_rank(cases, packets)):
        out = out.join(part, "case_id", "left")
    if latency is not None:
        out = out.join(latency, "case_id", "left")
    out = out.na.fill(0, ["retrieved_count"])
    issues = F.array_compact(F.array(F.when((F.col("__e") > 0) & ~F.col("section_hit"), "No expected sections found in top-k"), F.when(F.col("retrieved_count") == 0, "No chunks retrieved")))
    names = {"precision": "precision_at_5", "recall": "recall_at_5", "mrr": "mrr_at_5", "ndcg": "ndcg_at_5", "section_hit": "section_hit_at_k", "section_recall": "section_recall_at_k", "hit_rate": "keyword_hit_rate", "first_rank": "first_relevant_rank"}
    return out.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0).drop("__e").withColumnsRenamed(names)


#: Metrics that are averaged in a summary.
AVERAGED = ["section_recall_at_k", "keyword_hit_rate", "precision_at_5", "recall_at_5", "mrr_at_5", "ndcg_at_5"]


def summarize(results: DataFrame, *by: str) -> DataFrame:
    """total, passed, pass_rate and means; by columns, and rolled up over them; zeros where there are no rows."""
    grouped = results.rollup(*by) if by else results.groupBy()
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}") for m in AVERAGED]
    return grouped.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.coalesce(F.count_if("passed") / F.when(F.count("*") > 0, F.count("*")), F.lit(0.0)).alias("pass_rate"), *means)


#: Sections that every ticker's cases have to cover.
REQUIRED = ["business", "risk_factors", "md&a", "market_risk"]


def validate_cases(cases: DataFrame) -> DataFrame:
    """(case_id, violations) of the row rules."""
    words = F.transform("expected_keywords", lambda x: F.lower(stripped(x)))
    rules = {
        "id": F.col("case_id").rlike("^[a-z0-9]+(_[a-z0-9]+)*$"), "ticker": F.upper("ticker").rlike("^[A-Z]{1,5}$"), "prefix": F.startswith(F.col("case_id"), F.concat(F.lower("ticker"), F.lit("_"))),
        "query words": F.size(F.filter(F.split("query", r"[ \t\r\n\f]+"), lambda x: x != "")) >= 5, "query question": F.endswith(stripped("query"), F.lit("?")),
        "sections": (F.size("expected_sections") >= 1) & F.forall("expected_sections", lambda s: s.isin(REQUIRED)),
        "keywords": (F.size(words) >= 2) & (F.size(F.array_distinct(words)) == F.size(words)) & F.forall(words, lambda w: F.length(w) >= 2), "top_k": F.col("top_k").between(1, 20),
    }
    return cases.select("case_id", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])).alias("violations"))


def validate_set(cases: DataFrame, least: int = 50, most: int = 100) -> DataFrame:
    """(rule, subject) of broken set rules: number of cases, repeated ids, sections that a ticker lacks."""
    count = cases.agg(F.count("*").alias("n")).where(~F.col("n").between(least, most)).select(F.lit("count").alias("rule"), F.col("n").cast("string").alias("subject"))
    twice = cases.groupBy("case_id").count().where("count > 1").select(F.lit("repeated id").alias("rule"), F.col("case_id").alias("subject"))
    wanted = cases.select("ticker").distinct().select("ticker", F.explode(F.array(*map(F.lit, REQUIRED))).alias("section"))
    gaps = wanted.hint("merge").join(cases.select("ticker", F.explode("expected_sections").alias("section")).hint("merge"), ["ticker", "section"], "left_anti").select(F.lit("missing section").alias("rule"), F.concat_ws("/", "ticker", "section").alias("subject"))
    return count.union(twice).union(gaps)


def distribution(cases: DataFrame) -> DataFrame:
    """(ticker, section, n): case-section pairs by ticker and by section."""
    rows = cases.select("ticker", F.explode("expected_sections").alias("section"))
    return rows.groupingSets([[F.col("ticker")], [F.col("section")]], "ticker", "section").agg(F.count("*").alias("n"))


#: Other names of the retrieval modes.
MODE_ALIASES = {"dense": "semantic", "query": "semantic", "naive": "semantic", "section-aware": "section_aware", "langchain_hybrid": "hybrid", "qdrant_hybrid": "hybrid", "hybrid_rerank": "reranked_hybrid", "dense_bm25_rerank": "reranked_hybrid"}
MODES = ["semantic", "section_aware", "hybrid", "reranked_hybrid"]


def normalize_mode(mode: Column | str) -> Column:
    """One of MODES, or null."""
    low = F.lower(stripped(mode))
    known = F.create_map(*[F.lit(x) for pair in {**MODE_ALIASES, **{m: m for m in MODES}}.items() for x in pair])
    return known[low]


def method_matrix_cases(cases: DataFrame, modes: list[str]) -> DataFrame:
    """Every case once for each mode, in one table."""
    return cases.drop("mode").withColumn("mode", F.explode(F.array(*map(F.lit, modes))))


def select_cases(cases: DataFrame, case_id: str | None = None, limit: int | None = None, order: str = "pos") -> DataFrame:
    """Cases of an id, or the first ``limit`` in an order."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    out = cases if case_id is None else cases.where(F.col("case_id") == case_id)
    return out if limit is None else out.orderBy(order).limit(limit)


HIGHER = ["precision_at_5", "recall_at_5", "mrr_at_5", "ndcg_at_5", "keyword_hit_rate", "section_recall_at_k", "section_hit_at_k", "pass_at_k"]
LOWER = ["latency_ms", "miss_rate", "first_relevant_rank_mean_among_hits"]
CONFIG = ["top_k", "retrieved_count"]
TOLERANCE = 1e-9
#: Where a uniform number of 32 bits has to be at least for 1, 2, 3, ... draws: the Poisson distribution of mean 1.
DRAWN = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(11)]


def pair_results(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(case_id, side): 'both', 'baseline' or 'candidate'."""
    b, c = baseline.select("case_id", F.lit(1).alias("b")), candidate.select("case_id", F.lit(1).alias("c"))
    side = F.when(F.col("b").isNull(), "candidate").when(F.col("c").isNull(), "baseline").otherwise("both")
    return b.join(c, "case_id", "full_outer").select("case_id", side.alias("side"))


def metric_long(results: DataFrame, keys: list[str], include_config: bool = False) -> DataFrame:
    """(keys, metric, value): numeric and boolean metrics in long form, with miss_rate and the first rank among hits."""
    out = results.withColumn("miss_rate", F.col("first_relevant_rank").isNull().cast("double")).withColumn("first_relevant_rank_mean_among_hits", F.col("first_relevant_rank").cast("double"))
    names = [c for c, t in out.dtypes if c not in keys and (t in ("boolean", "double", "float", "int", "bigint") or t.startswith("decimal")) and not c.startswith("avg_") and (include_config or c not in CONFIG)]
    wide = out.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot(keys, names, "metric", "value").where("value is not null")


def compare(long: DataFrame, baseline: str, mode: str = "mode", compat: bool = False) -> DataFrame:
    """For each other mode and metric of (mode, case_id, metric, value): means, mean and relative delta over shared cases, wins, ties, losses.

    ``latency_ms_warm`` is latency without the first pair. With ``compat`` it, and the plain first rank, count as better if higher, as other metrics do.
    """
    pairs = paired(long, baseline, mode)
    lower = LOWER if compat else [*LOWER, "latency_ms_warm", "first_relevant_rank"]
    diff = F.col("candidate") - F.col("baseline")
    better = F.when(F.col("metric").isin(lower), -diff).otherwise(diff)
    rows = pairs.withColumn("diff", diff).withColumn("better", better)
    diff, better = F.col("diff"), F.col("better")
    return rows.groupBy(mode, "metric").agg(
        F.avg("baseline").alias("baseline_mean"), F.avg("candidate").alias("candidate_mean"), F.avg(diff).alias("paired_delta"),
        F.when(F.abs(F.avg("baseline")) > TOLERANCE, F.avg(diff) / F.avg("baseline")).alias("relative_delta"),
        F.count_if(better > TOLERANCE).alias("wins"), F.count_if(F.abs(diff) <= TOLERANCE).alias("ties"), F.count_if(better < -TOLERANCE).alias("losses"), F.count("*").alias("shared_count"),
    )


def paired(long: DataFrame, baseline: str, mode: str = "mode") -> DataFrame:
    """(mode, case_id, metric, baseline, candidate), warm latency included."""
    b = long.where(F.col(mode) == baseline).select("case_id", "metric", F.col("value").alias("baseline"))
    pairs = long.where(F.col(mode) != baseline).withColumnRenamed("value", "candidate").hint("merge").join(b.hint("merge"), ["case_id", "metric"]).select(mode, "case_id", "metric", "baseline", "candidate")
    latency = pairs.where("metric = 'latency_ms'")
    first = latency.groupBy(F.col(mode).alias("__mode")).agg(F.min("case_id").alias("__first"), F.count("*").alias("__n"))  # a row a mode
    warm = latency.join(F.broadcast(first), F.col(mode) == F.col("__mode")).where("case_id <> __first or __n = 1").drop("__mode", "__first", "__n").withColumn("metric", F.lit("latency_ms_warm"))
    return pairs.unionByName(warm)


def bootstrap_ci(pairs: DataFrame, samples: int = 2000, seed: int = 13, mode: str = "mode") -> DataFrame:
    """(mode, metric, ci_low, ci_high) of the mean delta over samples with replacement.

    How often a sample draws a case is Poisson with mean 1, by md5 of seed, sample and case, the same for all modes and metrics. A case is one row with the
    deltas of every mode and metric, so a draw is made once; a batch of cases adds to all samples by one product of matrices, draws by deltas, and a task sends
    its sums alone. A sample that draws nothing is left out.
    """
    delta = F.col("candidate") - F.col("baseline")
    if samples <= 0:
        return pairs.groupBy(mode, "metric").agg(F.avg(delta).alias("ci_low"), F.avg(delta).alias("ci_high"))
    columns = [tuple(r) for r in pairs.select(mode, "metric").distinct().collect()]  # modes and metrics are a fixed few
    if not columns:
        return pairs.select(mode, "metric", delta.alias("ci_low"), delta.alias("ci_high"))
    at = [F.col(mode).eqNullSafe(m) & F.col("metric").eqNullSafe(x) & delta.isNotNull() for m, x in columns]
    sums = F.array(*[F.sum(F.when(own, delta).otherwise(0.0)) for own in at]).cast("array<double>")
    counts = F.array(*[F.count_if(own) for own in at]).cast("array<double>")
    cases = pairs.groupBy("case_id").agg(sums.alias("sums"), counts.alias("counts")).select(F.coalesce(F.col("case_id").cast("string"), F.lit("")).alias("case_id"), "sums", "counts")
    blocks, width = [f"{seed}:{k}:".encode() for k in range((samples + 3) // 4)], len(columns)
    least = np.array(DRAWN, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((samples, width)), np.zeros((samples, width))
        for batch in batches:
            own, many = (batch.column(i).flatten().to_numpy().reshape(-1, width) for i in (1, 2))
            for a in range(0, batch.num_rows, 256):
                ids = [x.encode() for x in batch.column(0)[a : a + 256].to_pylist()]
                raw = b"".join(hashlib.md5(b + x).digest() for x in ids for b in blocks)
                u = np.frombuffer(raw, ">u4").reshape(len(ids), -1)[:, :samples]  # four draws of 32 bits a digest
                times = np.searchsorted(least, u, "right").astype(np.float64).T
                total += times @ own[a : a + 256]
                n += times @ many[a : a + 256]
        b, k = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(total[b, k]), pa.array(n[b, k])], names=["k", "b", "s", "n"])

    means = cases.mapInArrow(run, "k long, b long, s double, n double").groupBy("k", "b").agg(F.round(F.sum("s") / F.sum("n"), 9).alias("mean"))
    ordered = means.groupBy("k").agg(F.sort_array(F.collect_list("mean")).alias("m"))  # as many as there are samples
    end = lambda q: F.element_at("m", (q * (F.size("m") - 1)).cast("int") + 1)
    kinds = dict(pairs.dtypes)
    named = pairs.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(columns)], f"k long, `{mode}` {kinds[mode]}, metric {kinds['metric']}")
    return ordered.join(F.broadcast(named), "k").select(mode, "metric", end(0.025).alias("ci_low"), end(0.975).alias("ci_high"))


def contract_violations(results: DataFrame, mode: str, method: str) -> DataFrame:
    """Rows (case_id, mode, methods) of another mode than expected, or whose methods, from the row and its packets, lack the expected one."""
    methods = F.array_distinct(F.filter(F.flatten(F.array(F.array("method"), "packet_methods")), lambda x: x.isNotNull()))
    rows = results.select("case_id", "mode", methods.alias("methods"))
    return rows.where((F.col("mode") != mode) | ~F.array_contains("methods", method))


def judge_summary(scores: DataFrame) -> DataFrame:
    """(judge_metric, mean, n, errors): null scores don't count."""
    return scores.groupBy(F.concat_ws(".", "judge", "metric").alias("judge_metric")).agg(F.avg("score").alias("mean"), F.count("score").alias("n"), F.count("error").alias("errors"))


def judge_pass(score: Column | str, threshold: float = 0.70) -> Column:
    return (F.col(score) if isinstance(score, str) else score) >= threshold


def truncate_contexts(contexts: Column | str, most: int = 2500) -> Column:
    """Contexts that aren't blank, each cut to ``most`` characters; no cut for 0 and less."""
    kept = F.filter(contexts, lambda x: stripped(x) != "")
    return kept if most <= 0 else F.transform(kept, lambda x: F.substring(x, 1, most))


def score_samples(samples: DataFrame, metrics: list[str], make: Callable[[], Callable[[str, dict], float]] | None = None) -> DataFrame:
    """(case_id, metric, score, error): a user's judge, made once a task, called with a metric and a sample; a failure is an error row. Without one, the answer's words found in its contexts."""
    from proofsieve.functions.text import content_tokens

    rows = samples.withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    if make is None:
        words, there = F.array_distinct(content_tokens("actual_output")), F.flatten(F.transform("retrieval_context", content_tokens))
        return rows.select("case_id", "metric", F.when(F.size(words) > 0, F.size(F.array_intersect(words, there)) / F.size(words)).otherwise(0.0).alias("score"), F.lit(None).cast("string").alias("error"))

    def model() -> Callable[[list], list]:
        judge = make()
        return lambda batch: [float(judge(sample["metric"], sample)) for sample in batch]

    asked = rows.select("case_id", "metric", F.struct(*rows.columns).alias("sample"))
    return predict(asked, model, ["sample"], "score", "double").select("case_id", "metric", "score", "error")
