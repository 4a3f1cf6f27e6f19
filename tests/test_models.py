"""Embedders, classifiers, scorers and judges of users: one surface, failures by row."""

import datetime

import numpy as np
import pytest

from proofsieve.operators import evaluate as X
from proofsieve.operators import index as I
from proofsieve.operators import models as M
from proofsieve.operators import search as S
from proofsieve.operators import sentiment as N

TEXTS = "id bigint, text string, n int, day date"


def fails_on(word, value):
    """A model that fails on any batch with ``word`` in one of its inputs."""
    def make():
        def model(batch):
            if any(word in str(x) for x in batch):
                raise RuntimeError(f"met {word}")
            return [value(x) for x in batch]

        return model

    return make


@pytest.fixture(scope="module")
def texts(spark):
    day = datetime.date(2024, 1, 2)
    return spark.createDataFrame([(1, "good", 1, day), (2, "bad apple", None, None), (3, None, 3, day), (4, "", None, day), (5, "good", 5, day), (5, "good", 5, day)], TEXTS)


def test_only_rows_that_fail_have_errors(texts):
    got = sorted(map(tuple, M.predict(texts.coalesce(1), fails_on("apple", lambda t: float(len(t or "  "))), ["text"], "v", "double", batch_size=4).select("id", "n", "v", "error").collect()), key=str)
    assert got == [(1, 1, 4.0, None), (2, None, None, "met apple"), (3, 3, 2.0, None), (4, None, 2.0, None), (5, 5, 4.0, None), (5, 5, 4.0, None)]
    empty = M.predict(texts.limit(0), fails_on("apple", len), ["text"], "v", "double")
    assert empty.count() == 0 and empty.columns == [*texts.columns, "v", "error"]
    with pytest.raises(Exception, match="met apple"):
        M.predict(texts, fails_on("apple", lambda t: 1.0), ["text"], "v", "double", strict=True).collect()
    with pytest.raises(ValueError):
        M.predict(texts.withColumnRenamed("n", "error"), fails_on("apple", len), ["text"], "v", "double")


def test_models_are_made_once_a_task_and_asked_in_batches(spark, texts):
    def make():
        made, sizes = object(), []

        def model(batch):
            sizes.append(len(batch))
            return [float(10 * len(sizes) + max(sizes)) for _ in batch]

        return model

    rows = spark.range(0, 10, 1, 1)
    got = [r.v for r in M.predict(rows, make, ["id"], "v", "double", batch_size=4).orderBy("id").collect()]
    assert got == [14.0] * 4 + [24.0] * 4 + [34.0] * 2


def test_wrong_numbers_and_types_are_failures(texts):
    short = lambda: lambda batch: [1.0]  # noqa: E731  right for one row alone
    assert [r.v for r in M.predict(texts, short, ["text"], "v", "double", batch_size=4).collect()] == [1.0] * 6
    with pytest.raises(Exception, match="values for"):
        M.predict(texts.coalesce(1), short, ["text"], "v", "double", batch_size=4, strict=True).collect()
    words = M.predict(texts, lambda: lambda batch: ["x" for _ in batch], ["text"], "v", "double").collect()
    assert all(r.v is None and r.error for r in words)


def test_embedders(texts):
    make = fails_on("apple", lambda t: np.array([len(t), 1.0]))
    got = {r.id: (r.embedding, r.error, r.day) for r in I.embed_with(texts.coalesce(1), make, batch_size=8).collect()}
    assert got[1][:2] == ([4.0, 1.0], None) and got[3][0] == [0.0, 1.0] and got[2] == (None, "met apple", None)


def test_classifiers(texts):
    make = fails_on("apple", lambda t: {"positive": 0.5, "negative": 0.5} if t else {"neutral": 1.0})
    got = {r.id: (r.label, r.confidence, r.error) for r in N.classify(texts.coalesce(1), make=make).collect()}
    assert got == {1: ("negative", 0.5, None), 2: (None, None, "met apple"), 3: ("neutral", 1.0, None), 4: ("neutral", 1.0, None), 5: ("negative", 0.5, None)}


def test_scorers(spark):
    queries = spark.createDataFrame([("q", "what apple", "T")], "query_id string, text string, ticker string")
    chunks = spark.createDataFrame([("a", "apple pie", "s"), ("b", "plum", "s")], "chunk_id string, text string, section_key string")
    rows = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, chunk_id string")
    make = fails_on("pie", lambda pair: float(len(pair[1])))
    got = {r.chunk_id: (r.reranker_score, r.error) for r in S.rerank(rows, queries, chunks, make, strict=False).collect()}
    assert got == {"a": (None, "met pie"), "b": (4.0, None)}
    with pytest.raises(Exception, match="met pie"):
        S.rerank(rows, queries, chunks, make).collect()
    whole = S.rerank(rows, queries, chunks, lambda: lambda pairs: np.array([len(q) / 10 for q, _ in pairs]))
    assert {*whole.columns} == {"query_id", "chunk_id", "reranker_score"} and {r.reranker_score for r in whole.collect()} == {1.0}


def test_judges(spark):
    samples = spark.createDataFrame([("a", "grew", ["it grew"], 1), ("b", "x", [], None)], "case_id string, actual_output string, retrieval_context array<string>, n int")

    def make():
        def judge(metric, sample):
            if metric == "g" and sample["case_id"] == "b":
                raise RuntimeError("no")
            return len(sample["retrieval_context"])

        return judge

    got = sorted(map(tuple, X.score_samples(samples, ["f", "g"], make).collect()))
    assert got == [("a", "f", 1.0, None), ("a", "g", 1.0, None), ("b", "f", 0.0, None), ("b", "g", None, "no")]
