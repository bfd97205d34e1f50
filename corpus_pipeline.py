"""The corpus pipeline: language ID, near-duplicates, benchmark passages, secrets, packing. Each stage works on what the one before it kept.

All stages but the last return the columns of docs as they are, further ones and ones whose names differ only in case included. Texts are read whole, of any length. No stage depends on the order of rows,
and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetmatch.llm import decontaminate, language_id, minhash, packing, secrets
from facetmatch.llm.common import checkpoint, table

#: run()'s rows come from a trained network and random projections, which SQL can't express.
ORACLE_SQL = None


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language: null, empty and letterless texts, noise, and texts in which no language is likely enough. Rows with a null doc_id or lang are judged like
    others, repeated rows each. Where no row has a lang, nothing is recognised and no row is kept. Equally likely languages: the first by name."""
    return language_id.accepted(docs, language_id.fit(docs))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest id. Null, empty and wordless texts are nobody's duplicate, and rows with a null doc_id are kept. Rows that repeat a
    doc_id leave one."""
    return minhash.deduplicated(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts and items hold and match nothing; an empty benchmark drops nothing. Rows with a null doc_id and repeated rows are judged each."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by [SECRET], and n_chars by the new length where it changed; every row stays, null and empty texts and null ids too."""
    return secrets.redacted(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into bins of limited tokens, segments and loss-bearing tokens: a row a piece of a document. Null and empty texts and rows with a null doc_id are left out; a document beyond a
    limit is cut into pieces; repeated rows are packed each; ties are broken by id and piece."""
    return packing.packed_documents(docs, packing.Params(max_loss=4096))


STAGES = [("language", stage_language), ("near_duplicates", stage_near_duplicates), ("decontaminate", stage_decontaminate), ("secrets", stage_secrets), ("pack", stage_pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
