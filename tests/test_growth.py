"""Work that grows with the input and no faster: plans and results of steps that once grew with the square of a group or went over a text again and again."""

import random
from datetime import datetime, timedelta


from proofsieve.functions import text as T
from proofsieve.operators import index as I
from proofsieve.operators import runlog as R
from proofsieve.operators import sentiment as N
from proofsieve.operators import stored as K


def test_trailing_count_goes_through_a_window_once(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), None if i % 50 == 0 else start + timedelta(seconds=rng.randrange(0, 400, 10))) for i in range(600)]
    events = spark.createDataFrame(rows, "i long, kind string, ts timestamp")
    out = R.trailing_count(events, "kind", 60)
    assert out.columns == ["i", "kind", "ts", "n"] and {r.i: (r.kind, r.ts) for r in out.collect()} == {i: (k, t) for i, k, t in rows}
    want = {i: sum(k == kind and ((t is None) if ts is None else t is not None and ts - timedelta(seconds=60) <= t <= ts) for _, k, t in rows) for i, kind, ts in rows}
    assert {r.i: r.n for r in out.collect()} == want
    # A frame with a moving lower end is added up anew at each row.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, -" not in plan and "unboundedpreceding" in plan
    assert R.trailing_count(events.limit(0), "kind", 60).count() == 0


def test_a_text_is_cut_into_pieces_once(spark):
    rows = spark.createDataFrame([(1, "x Item 1. Business a ITEM 1A. risk  factors b Item 7 Management c\x01 item 7a. Quantitative d Item 1 Business"), (2, "none"), (3, None)], "i int, text string")
    out = rows.select("i", T.section_pieces("text").alias("p"))
    got = {r.i: r.p and [(x.name, x.content) for x in r.p] for r in out.collect()}
    assert got[1] == [("business", "Item 1. Business a "), ("risk_factors", "ITEM 1A. risk  factors b "), ("md&a", "Item 7 Management c "), ("market_risk", "item 7a. Quantitative d "), ("business", "Item 1 Business")]
    assert not got[2] and not got[3]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1  # not again for each piece


def test_ends_of_a_text_are_stripped_as_in_sql(spark):
    texts = [" \t\r\n\fa b\n \n", "a \x85", "\xa0a\xa0", " \n", "", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.stripped("t")).collect()] == ["a b", "a \x85", "\xa0a\xa0", "", "", None]


def test_embeddings_go_over_tokens_once(spark):
    plan = I.embed_hashed(spark.createDataFrame([("a b a",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(transform" not in plan  # a vector made anew for each token


def test_learnt_sentiment_shuffles_no_token(spark):
    model = N.learn(spark.createDataFrame([("positive", "good up"), ("negative", "bad")], "label string, text string"))
    out = N.classify_learnt(spark.createDataFrame([(1, "good good bad"), (2, "up"), (2, "up")], "i int, text string"), model, "i")
    assert {r.i: r.label for r in out.collect()} == {1: "positive", 2: "positive"}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1


def test_postings_are_not_shuffled(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", "A", "a b a " + "c " * (i % 3)) for i in range(40)], "chunk_id string, ticker string, text string")
    K.write_postings(rows, str(tmp_path), buckets=2, block=8)
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    assert blocks.groupBy("ticker", "term", "slot").count().where("count > 1").count() == 0  # a term's postings in a slot are one block
    assert {(r.term, r.df, len(r.leading)) for r in K.read_terms(spark, str(tmp_path), ["ticker"]).collect()} == {("a", 40, 32), ("b", 40, 32), ("c", 26, 26)}
