"""Small cases with known results."""

import html
import html.entities
import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from proofsieve.functions import text as T
from proofsieve.operators import evaluate as X
from proofsieve.operators import evidence as E
from proofsieve.operators import grounding as G
from proofsieve.operators import index as I
from proofsieve.operators import runlog as R
from proofsieve.operators import search as S
from proofsieve.operators import sentiment as N
from proofsieve.sources import filings as A
from proofsieve.streaming import streams as Z


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(column.alias("x")).first().x


def verdict(spark, memo, *sources):
    memos = spark.createDataFrame([(1, memo)], "memo_id int, text string")
    evidence = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(sources)], "memo_id int, index int, text string")
    return G.memo_verdict(memos, evidence).first(), G.assess_claims(memos, evidence).orderBy("pos").collect()


def test_grounded_memo_passes(spark):
    v, claims = verdict(spark, "Apple reported revenue of $394 billion [1]. Supply chain concentration in China remains a risk [2].", "Apple net sales: revenue of $394 billion was reported.", "Risks include supply chain concentration in China.")
    assert (v.passed, v.total, v.coverage, v.grounded_rate) == (True, 2, 1.0, 1.0) and all(c.supported for c in claims)


def test_uncited_unaligned_and_wrong_numbers(spark):
    v, claims = verdict(spark, "Apple revenue grew strongly in services. Gross margin was 44% [1].", "Gross margin was 44% in fiscal 2024.")
    assert not v.passed and v.coverage == 0.5 and [c.missing_citation for c in claims] == [True, False]
    v, claims = verdict(spark, "Apple faces major supply chain risk in China [1].", "new products and services revenue")
    assert v.grounded_rate == 0.0 and "align" in claims[0].reason
    v, claims = verdict(spark, "Apple reported revenue of $500 billion [1].", "Apple reported revenue of $394 billion.")
    assert not claims[0].supported and "numbers" in claims[0].reason
    v, _ = verdict(spark, "Apple reported revenue of $394 billion [1] [99].", "Apple reported revenue of $394 billion.")
    assert not v.passed and v.orphans == [99]
    v, claims = verdict(spark, "", "x")
    assert (v.total, v.passed, claims) == (0, False, [])


def test_sections(spark):
    for name, key in (("Item 1A. Risk Factors", "risk_factors"), ("Management’s Discussion and Analysis", "md&a"), ("MD&A", "md&a"), ("item 7a", "market_risk"), ("Item 10", None), ("Legal", None)):
        assert one(spark, T.canonical_section_key("c0"), name) == key, name
    assert one(spark, T.section_slug("c0"), " Notes & More ") == "notes_more"
    assert one(spark, T.html_to_text("c0"), "<p>A&amp;B&nbsp; <b>c</b></p>\n") == "A&B c"
    assert one(spark, T.sentences("c0"), "One. Two!\nThree") == ["One.", "Two!", "Three"]
    assert one(spark, T.numbers("c0"), "up 1,200 to $3.5 or 44%") == ["1200", "$3.5", "44%"]


def test_point_id_is_uuid5(spark):
    for text in ("D1", "ä b", ""):
        assert one(spark, T.point_id("c0"), text) == str(uuid.uuid5(uuid.NAMESPACE_URL, text))
    known = str(uuid.uuid4())
    assert one(spark, T.point_id("c0"), known.upper()) == known


def test_intent(spark):
    q = spark.createDataFrame([("a", "What supply chain risks does the company face?"), ("b", "hello"), ("c", "How do foreign exchange rates & R&D affect revenue growth?")], "query_id string, text string")
    got = {r.query_id: r for r in S.section_intent(q).collect()}
    assert got["a"].target_sections[0] == "risk_factors" and got["b"].target_sections == [] and got["b"].confidence == 0.0
    assert "r&d" in got["c"].matched_terms and set(got["c"].target_sections) == {"market_risk", "md&a", "business"}


def chunks(spark):
    rows = [("business-1", "Apple sells phones and services.", "AAPL", "10-K", "business", "Business", "2024-01-01", [1.0, 0.1]), ("risk-1", "Supply chain supplier risks in the region.", "AAPL", "10-K", "risk_factors", "Risk Factors", "2024-01-01", [0.6, 0.8])]
    return spark.createDataFrame(rows, "chunk_id string, text string, ticker string, filing_type string, section_key string, section_name string, filing_date string, embedding array<float>")


def question(spark, text):
    return spark.createDataFrame([("q", text, "aapl", None, None, None, None, [1.0, 0.0])], "query_id string, text string, ticker string, filing_type string, section_key string, section_name string, filing_date string, embedding array<float>")


def test_searches_lift_the_risk_section(spark):
    c, q = chunks(spark), question(spark, "supply chain supplier risks")
    assert [r.chunk_id for r in S.dense_topk(q, c).orderBy("rank").collect()] == ["business-1", "risk-1"]
    assert S.section_aware_search(q, c).orderBy("rank").first().chunk_id == "risk-1"
    assert S.hybrid_search(q, c).orderBy("rank").first().chunk_id == "risk-1"
    score = lambda: lambda pairs: [10.0 if "upply chain" in t else 1.0 for _, t in pairs]
    best = S.reranked_search(q, c, make=score).orderBy("rank").first()
    assert (best.chunk_id, best.dense_rank, best.reranker_score) == ("risk-1", 2, 10.0)
    assert S.reranked_search(q, c, fail_open=True).orderBy("rank").first().chunk_id == "business-1"
    with pytest.raises(ValueError):
        S.rrf_fuse((S.dense_topk(q, c), 0.0))


def test_metrics(spark):
    cases = spark.createDataFrame([("c", ["Risk Factors"], ["supply"])], "case_id string, expected_sections array<string>, expected_keywords array<string>")
    packets = spark.createDataFrame([("c", 1, "Business", "phones"), ("c", 2, "Risk Factors", "supply chain")], "case_id string, rank int, section_name string, text string")
    m = X.case_metrics(cases, packets).first()
    assert (m.precision_at_5, m.recall_at_5, m.mrr_at_5, round(m.ndcg_at_5, 4), m.first_relevant_rank, m.passed) == (0.2, 1.0, 0.5, 0.6309, 2, True)
    none = X.case_metrics(cases, packets.limit(0)).first()
    assert (none.passed, none.retrieved_count, none.mrr_at_5) == (False, 0, 0.0)


def test_comparison(spark):
    rows = spark.createDataFrame([("a", "shared", 1), ("a", "only_a", 1), ("b", "shared", None), ("b", "only_b", 2)], "mode string, case_id string, first_relevant_rank int")
    long = X.metric_long(rows, ["mode", "case_id"])
    got = {r.metric: r for r in X.compare(long, "a").collect()}
    assert (got["miss_rate"].paired_delta, got["miss_rate"].losses, got["miss_rate"].shared_count) == (1.0, 1, 1) and got["miss_rate"].relative_delta is None
    ci = {r.metric: r for r in X.bootstrap_ci(X.paired(long, "a"), 50).collect()}
    assert (ci["miss_rate"].ci_low, ci["miss_rate"].ci_high) == (1.0, 1.0)


def test_packets_and_registry(spark):
    articles = spark.createDataFrame([("r", 0, "T", " ", "u", None, "s"), ("r", 1, "News", "up", "u", "2024-01-01", "s")], "run_id string, pos int, title string, snippet string, url string, published_date string, source string")
    rows = [("r", k, "Business", "10-K", "" if k == 1 else f"text {k}", None, None, f"c{k}") for k in range(7)]
    c = spark.createDataFrame(rows, "run_id string, pos int, section string, filing_type string, text string, source_url string, filing_date string, chunk_id string")
    got = E.citation_registry(articles, c).orderBy("index").collect()
    assert [(r["index"], r.source_type, r.chunk_id) for r in got] == [(1, "news", None), (2, "sec_filing", "c0"), (3, "sec_filing", "c2"), (4, "sec_filing", "c3"), (5, "sec_filing", "c4")]


def test_chunks_cover_the_text(spark):
    text = ". ".join(f"Sentence number {k} of the filing" for k in range(200)) + "."
    df = spark.createDataFrame([("d", text)], "document_id string, content string")
    fixed = [r.chunk_text for r in I.chunk_fixed(df).orderBy("chunk_index").collect()]
    assert all(len(c) <= 1000 for c in fixed) and fixed[0] == text[:1000].strip() and fixed[-1].endswith(text[-100:])
    packed = [r.chunk_text for r in I.chunk_packed(df).orderBy("chunk_index").collect()]
    assert " ".join(packed) == text and all(len(c) <= 1000 for c in packed)
    pieces = [r.chunk_text for r in I.chunk_recursive(df).orderBy("chunk_index").collect()]
    assert all(len(c) <= 1000 for c in pieces) and all(f"number {k} of" in " ".join(pieces) for k in range(200))
    assert I.recursive_pieces("x" * 2500, 1000, 200)[0] == "x" * 1000


def test_ingest_and_embeddings(spark):
    known = spark.createDataFrame([("1", "A", "old")], "chunk_id string, ticker string, text string")
    batch = spark.createDataFrame([("1", "A", "new"), ("2", "B", "x")], "chunk_id string, ticker string, text string")
    rows = lambda df: sorted(tuple(r) for r in df.select("chunk_id", "ticker", "text").collect())
    assert rows(I.ingest(known, batch)) == [("1", "A", "old"), ("2", "B", "x")]
    assert rows(I.ingest(known, batch, replace=True)) == [("1", "A", "new"), ("2", "B", "x")]
    vectors = [r.embedding for r in I.embed_hashed(spark.createDataFrame([("risk risk growth",), ("",)], "text string"), dim=8).collect()]
    assert sum(x * x for x in vectors[0]) == pytest.approx(1.0, rel=1e-5) and vectors[1] == []

    def failing():
        def model(texts):
            if "x" in texts:
                raise RuntimeError("out of memory")
            return [[1.0] for _ in texts]

        return model

    got = I.embed_with(batch.coalesce(1), failing, batch_size=1).orderBy("chunk_id").collect()
    assert got[0].embedding == [1.0] and got[1].embedding is None and "memory" in got[1].error


def test_sources(spark, tmp_path):
    (tmp_path / "cases.json").write_text('[{"id": "a_1", "ticker": "a", "query": "why?", "mode": "Query", "filing_type": ""}]')
    case = A.load_retrieval_cases(spark, str(tmp_path / "cases.json")).first()
    assert (case.ticker, case.top_k, case.filing_type, case.expected_sections, case.mode) == ("A", 5, None, [], "query")
    (tmp_path / "results.json").write_text('{"results": [{"case_id": "x"}, {"case_id": " "}]}')
    assert A.load_result_payload(spark, str(tmp_path / "results.json")).count() == 1
    (tmp_path / "twice.json").write_text('{"results": [{"case_id": "x"}, {"case_id": "x"}]}')
    with pytest.raises(ValueError):
        A.load_result_payload(spark, str(tmp_path / "twice.json"))
    (tmp_path / "none.json").write_text('{"summary": 1}')
    with pytest.raises(ValueError):
        A.load_result_payload(spark, str(tmp_path / "none.json"))


def test_sentiment(spark):
    df = spark.createDataFrame([("record profit growth",), ("weak loss",), ("",)], "text string")
    assert [r.label for r in N.classify(df).collect()] == ["positive", "negative", "neutral"]
    model = lambda: lambda texts: [{"positive": 0.2, "negative": 0.7, "neutral": 0.1} for _ in texts]
    assert {(r.label, r.confidence) for r in N.classify(df, make=model).collect()} == {("negative", 0.7)}


def test_judges_fail_by_row(spark):
    samples = spark.createDataFrame([("a", "profit grew", ["profit grew in 2024"]), ("b", "x", [])], "case_id string, actual_output string, retrieval_context array<string>")
    assert {r.case_id: r.score for r in X.score_samples(samples, ["f"]).collect()} == {"a": 1.0, "b": 0.0}

    def make():
        def judge(metric, row):
            if row["case_id"] == "b":
                raise RuntimeError("no")
            return 0.9

        return judge

    got = {r.case_id: (r.score, r.error) for r in X.score_samples(samples, ["f"], make).collect()}
    assert got == {"a": (0.9, None), "b": (None, "no")}


def test_run_log(spark):
    rows = [("j", 1, "pending", 1, None), ("j", 2, "completed", 2, "e"), ("k", 3, "failed", 1, "e")]
    events = spark.createDataFrame([(j, e, s, datetime(2024, 1, t), x) for j, e, s, t, x in rows], "job_id string, event_id int, status string, ts timestamp, error string")
    got = {r.job_id: (r.status, r.error) for r in R.latest_run_state(events).collect()}
    assert got == {"j": ("completed", None), "k": ("failed", "e")}
    h = R.latency_histogram(spark.createDataFrame([("e", 0.05), ("e", 0.3), ("e", 0.4), ("e", 500.0)], "ep string, v double"), "ep", "v")
    assert R.histogram_quantile(h, "ep", 0.5).first().value == pytest.approx(0.3) and R.histogram_quantile(h, "ep", 0.99).first().value == 120.0


def test_run_state_stream_ignores_older_transitions_and_times_out(spark, tmp_path):
    schema = "job_id bigint, status string, ts timestamp, event_id bigint"
    source, out = tmp_path / "in", []

    def put(k, *rows):
        spark.createDataFrame([(j, s, datetime(2024, 1, day, h), e) for j, s, day, h, e in rows], schema).coalesce(1).write.parquet(str(source / f"b{k}"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source / "*"))
        Z.run_to_end(Z.run_states(stream, stale_after_s=3600), "update", str(tmp_path / "cp"), lambda df, k: out.extend(sorted(map(tuple, df.select("job_id", "status").collect()))))

    put(0, (1, "running", 1, 5, 2), (1, "pending", 1, 4, 1), (2, "completed", 1, 5, 3))
    run()
    assert out == [(1, "running"), (2, "completed")]
    put(1, (1, "pending", 1, 3, 9), (3, "running", 5, 1, 10))
    run()
    put(2, (3, "completed", 6, 1, 11))
    run()
    assert (1, "stale") in out and (2, "stale") not in out and (1, "pending") not in out and (3, "completed") in out


def test_write_and_upsert_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, ticker string, text string")
    I.write_index(rows(("1", "A", "a"), ("2", "B", "b")), path)
    I.write_index(rows(("3", "A", "c")), path)
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == ["2", "3"]
    assert I.delete_ticker(spark.read.parquet(path), " a").count() == 1
    assert I.drop_index(spark.read.parquet(path)).count() == 0
    twice = I.upsert(rows(("1", "A", "a")).withColumn("version", F.lit(0)), rows(("1", "A", "x"), ("1", "A", "y"), ("2", "A", " ")).withColumn("version", F.when(F.col("text") == "y", 2).otherwise(1)))
    assert [(r.chunk_id, r.text) for r in twice.collect()] == [("1", "y")]


def test_character_references_are_those_of_the_standard_library(spark):
    rng = random.Random(0)
    keys = list(html.entities.html5)
    rows = ["a &amp;lt; b", "&#8217;&#160;x &#x41; &#0; &#55296; &#99999999999; &#128; &#150 &#129; &#1; &#xFFFF; &#x1F600;", "&notit; &ampx &copy2024 &unknown; && & &;", "&#; &#x; &amp", "none", None, ""]
    rows += ["".join(rng.choice([f"&{rng.choice(keys)}", f"&{rng.choice(keys)} ", f"&#{rng.randrange(1, 1200000)};", f"&#x{rng.randrange(1, 70000):x};", " t ", "&"]) for _ in range(12)) for _ in range(150)]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, x string").select("i", T.unescaped("x").alias("y")).collect()
    assert [r.y for r in sorted(got)] == [None if x is None else html.unescape(x) for x in rows]
    page = spark.createDataFrame([("<p>A&nbsp;&#8217;s</p>\n <b>B &amp;amp; C</b>",)], "x string").select(T.html_to_text("x")).first()[0]
    assert page == "A ’s B &amp; C"


def test_ingest_starts_again_where_it_ended(spark, tmp_path):
    schema = "ticker string, filing_type string, filing_date string, raw_name string, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
    put([("A", "10-K", "d1", "Business", "one two"), ("B", "10-K", "d2", "Business", "three")])
    run = lambda: Z.ingest_stream(Z.stream_of(spark, f"{tmp_path}/in"), f"{tmp_path}/index", f"{tmp_path}/checkpoint")
    rows = lambda: sorted((r.document_id[0], r.text) for r in Z.index_of(spark, f"{tmp_path}/index").collect())
    run()
    first = rows()
    run()  # nothing new
    assert rows() == first == [("A", "one two"), ("B", "three")]
    put([("A", "10-K", "d1", "Business", "one two four")])
    run()
    assert rows() == [("A", "one two four"), ("B", "three")]
