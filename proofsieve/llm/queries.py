"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from proofsieve.llm import bpe, divergence, ego, lexical, licenses, mixing, ngrams, rabitq, secrets, simhash, substring, toxicity, urls
from proofsieve.llm.shared import table


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.nearest(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_substring": op1_substring, "op2_bpe": op2_bpe, "op3_ego_join": op3_ego_join, "op4_toxicity": op4_toxicity, "op5_rabitq": op5_rabitq, "op6_simhash": op6_simhash, "op7_mixing": op7_mixing, "op8_licenses": op8_licenses, "op9_secrets": op9_secrets, "op10_ngrams": op10_ngrams, "op11_url_filters": op11_url_filters, "op12_divergence": op12_divergence, "op13_lexical": op13_lexical}
ORACLE_SQL: dict[str, str] = {"op8_licenses": licenses.oracle_sql(), "op11_url_filters": urls.oracle_sql(), "op12_divergence": divergence.oracle_sql(), "op13_lexical": lexical.oracle_sql()}
