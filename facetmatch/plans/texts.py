"""Queries for the scalar functions, over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmatch.functions import sql as S
from facetmatch.functions.similarity import dice, jaccard, trigrams
from facetmatch.functions.text import digits_of, fold, html_escape, match_normalize, match_normalize_long, slugify, words_of
from facetmatch.registry import query
from facetmatch.sources import testdata
from facetmatch.sources.testdata import table

T = "WITH " + testdata.SQL


@query(f"SELECT doc_id, md5({S.norm('text')}) AS norm_md5, length({S.norm('text')}) AS norm_length FROM documents")
def norm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", match_normalize_long(F.col("text")).alias("n")).select("doc_id", F.md5("n").alias("norm_md5"), F.length("n").alias("norm_length"))


@query(f"SELECT doc_id, {S.digits(S.norm('text'))} AS numbers FROM documents")
def digit_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", digits_of(match_normalize_long(F.col("text"))).alias("numbers"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slugify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", slugify(F.col("url")).alias("slug"))


@query("SELECT doc_id, md5(replace(strip_accents(lower(text)), 'ß', 'ss')) AS key_md5 FROM documents")
def search_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("key_md5"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5 FROM pages""")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html_escape(F.col("html"))).alias("escaped_md5"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS params,
  nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages""")
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr("parse_url(url, 'HOST')").alias("host"), F.coalesce(F.expr("parse_url(url, 'PATH')"), F.lit("")).alias("path"), F.expr("parse_url(url, 'QUERY')").alias("params"), F.expr("parse_url(url, 'QUERY', 'utm_source')").alias("utm_source"))


PAIRS = f", n AS (SELECT ord, {S.norm('name')} AS norm, {S.norm('recommended_name')} AS rec FROM records)"


@query(T + PAIRS + f" SELECT ord, round({S.dice('a', 'b')}, 6) AS dice FROM (SELECT ord, {S.grams(S.norm('norm'))} AS a, {S.grams(S.norm('rec'))} AS b FROM n)")
def trigram_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's name against its recommended name."""
    r = testdata.records(spark, sf_dir).select("ord", match_normalize(F.col("name")).alias("a"), match_normalize(F.col("recommended_name")).alias("b"))
    return r.select("ord", F.round(dice(trigrams(F.col("a")), trigrams(F.col("b"))), 6).alias("dice"))


@query(T + PAIRS + f" SELECT ord, round({S.jaccard(S.words('norm'), S.words('rec'))}, 6) AS jaccard FROM n")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = testdata.records(spark, sf_dir).select("ord", match_normalize(F.col("name")).alias("a"), match_normalize(F.col("recommended_name")).alias("b"))
    return r.select("ord", F.round(jaccard(words_of(F.col("a")), words_of(F.col("b"))), 6).alias("jaccard"))
