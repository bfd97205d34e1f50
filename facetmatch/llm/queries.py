"""The registered queries of this subpackage: one an operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from facetmatch.llm import decontaminate, language_id, link_graph, lm_scoring, minhash, packing, pii, secrets, sharding, topk
from facetmatch.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_conversations(table(spark, sf_dir, "conversations"))


#: The seeds of op3_link_graph's query, as the tables at hand have no list of hosts.
TRUSTED = ["therhe.example.org", "therer.example.org", "tionble.example.org", "tiontion.example.net", "ththat.example.net"]
BLOCKED = ["ads-track.example.com", "adult-x.example.net", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com"]


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted, blocked = (spark.createDataFrame([(h,) for h in hosts], "host string") for hosts in (TRUSTED, BLOCKED))
    return link_graph.page_verdicts(table(spark, sf_dir, "pages"), trusted, blocked)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), topk.QUERIES)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_lm_scoring, op2_packing, op3_link_graph, op4_pii, op5_language_id, op6_decontamination, op7_sharding, op8_secret_scan, op9_top_k, op10_minhash]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op3_link_graph": link_graph.sql(TRUSTED, BLOCKED), "op7_sharding": sharding.SQL, "op9_top_k": topk.SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in sql.items() if v}
