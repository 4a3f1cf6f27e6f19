"""Candidates of the reranked mode: as many lexical hits as are asked for, whether or not they share a word with the query."""

import duckdb
from pyspark.sql import types as Y

from proofsieve.functions.text import space_tokens
from proofsieve.operators import search as S
from proofsieve.registry import ORACLE_SQL, QUERIES


def test_hits_without_a_common_word(spark):
    queries = spark.createDataFrame([("a", "T", "Cash flow"), ("b", "T", "nothing like it"), ("c", "U", "cash"), ("d", "V", "cash")], "query_id string, ticker string, text string")
    rows = [("D1", "T", "cash flow"), ("D2", "T", " \n"), ("D3", "T", "oil"), ("D4", "T", "Cash"), ("D5", "T", None), ("D6", "T", "flow"), ("D7", "T", "!"), ("D8", "U", "oil"), ("D9", None, "cash")]
    corpus = spark.createDataFrame(rows, "chunk_id string, ticker string, text string")

    def found(**how):
        hits = S.bm25_topk(queries, corpus, 4, split=space_tokens, **how).orderBy("query_id", "rank").collect()
        return {q: [(h.chunk_id, h.score > 0) for h in hits if h.query_id == q] for q in "abcd"}

    assert found() == {"a": [("D4", True), ("D6", True), ("D1", True)], "b": [], "c": [], "d": []}
    # The hits come first and once, then chunks with text of the scope by chunk_id.
    assert found(pad=True) == {"a": [("D4", True), ("D6", True), ("D1", True), ("D3", False)], "b": [(f"D{n}", False) for n in (1, 3, 4, 6)], "c": [("D8", False)], "d": []}


def test_priors_of_every_candidate(spark, tmp_path):
    # One ticker, and no word of the query in its chunks.
    docs = [(i, None if i == 39 else " " if i == 38 else f"Hedging{i} revenues", "en", "src1", 1) for i in range(40)]
    vectors = [(i, [1.0, float(i)], 0) for i in range(20)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "embeddings": spark.createDataFrame(vectors, Y.StructType([Y.StructField("vec_id", Y.LongType()), Y.StructField("embedding", Y.ArrayType(Y.FloatType())), Y.StructField("label", Y.IntegerType())])),
        "benchmark": spark.createDataFrame([(1, "what")], "item_id long, text string"),
    }
    duck = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ["query_id", "chunk_id", "section_prior", "keyword_prior"]
    got = sorted(map(tuple, QUERIES["rerank_priors"](spark, str(tmp_path)).select(columns).collect()))
    # The first 30 chunks with text by chunk_id, and the 20 with a vector.
    lexical = sorted(f"D{i}" for i in range(38))[:30]
    assert [r[1] for r in got] == sorted({*lexical, *(f"D{i}" for i in range(20))})
    assert got == sorted(duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['rerank_priors']})").fetchall())
