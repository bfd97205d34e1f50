"""Queries of the typeahead search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmatch.functions.text import type_normalize
from facetmatch.operators import search
from facetmatch.operators.search import Limits
from facetmatch.operators.catalog import index_rows_of
from facetmatch.plans.catalog import INDEX, TYPE
from facetmatch.plans.matches import QUERY_SQL
from facetmatch.registry import query
from facetmatch.session import checkpoint, spread
from facetmatch.sources import testdata

BASE = "WITH " + testdata.SQL + INDEX + QUERY_SQL + f""", lit AS (SELECT query_id, {TYPE('query')} AS q FROM queries),
pre AS (SELECT DISTINCT query_id, {TYPE("array_to_string(string_split(query, ' ')[1:k], ' ')")} AS q FROM (SELECT *, unnest(range(2, len(string_split(query, ' ')) + 1)) AS k FROM queries))"""


def literal(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    """Each query; typed: each of its beginnings from two words on, as they are typed. Each distinct query is worked out once, whoever asks it, spread over all tasks."""
    q, words = checkpoint(testdata.match_queries(spark, sf_dir).select("query_id", "query")), F.split("query", " ")
    begun = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(words))), lambda k: F.array_join(F.slice(words, 1, k), " "))
    texts = spread(q.select("query"), "query").distinct().select("query", F.explode(begun if typed else F.array("query")).alias("text"))
    forms = q.join(texts.select("query", type_normalize(F.col("text")).alias("q")), "query")
    return checkpoint(forms.select("query_id", "q", F.lit(0).alias("offset"), F.lit(None).cast("string").alias("label")).distinct()).where("q <> ''")


def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(index_rows_of(testdata.asset(spark, sf_dir)))


@query(BASE + " SELECT query_id, q, n, id, CASE WHEN n = q THEN 0 ELSE 1 END AS tier FROM pre JOIN idx ON starts_with(n, q)")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS3, as each query is typed word by word."""
    return search.prefix_hits(literal(spark, sf_dir, True), index_of(spark, sf_dir), Limits(prefix_scan=None)).select("query_id", "q", "n", "id", "tier")


COVER = """, t AS (SELECT DISTINCT query_id, q, unnest(string_split(q, ' ')) AS tok FROM lit), need AS (SELECT query_id, count(*) AS need FROM t GROUP BY query_id),
w AS (SELECT n, id, unnest(list_distinct(string_split(n, ' '))) AS word FROM idx),
got AS (SELECT query_id, q, n, id, count(DISTINCT tok) AS got FROM t JOIN w ON starts_with(word, tok) GROUP BY ALL),
cover AS (SELECT query_id, q, n, id FROM got JOIN need USING (query_id) WHERE got = need AND NOT starts_with(n, q))"""


@query(BASE + COVER + " SELECT query_id, n, id FROM cover")
def token_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS4, over whole queries."""
    return search.cover_hits(literal(spark, sf_dir), index_of(spark, sf_dir), Limits()).select("query_id", "n", "id")


@query(BASE + COVER + """, hits AS (SELECT query_id, n, id, CASE WHEN n = q THEN 0 ELSE 1 END AS tier FROM lit JOIN idx ON starts_with(n, q) UNION ALL SELECT query_id, n, id, 2 FROM cover),
o AS (SELECT h.query_id, h.n, h.id, h.tier, i.kind, i.shown, r.name, CASE r.confidence WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END AS c, CASE i.kind WHEN 'camera' THEN 0 ELSE 1 END AS k FROM hits h JOIN idx i ON h.n = i.n AND h.id = i.id JOIN records r ON r.id = h.id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY tier, length(n), n) AS one FROM o) WHERE one = 1)
SELECT query_id, rank, id, kind, tier, CASE WHEN lower(nullif(shown, '')) <> lower(name) THEN shown END AS matched_alias, false AS corrected
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, length(n), c, k, lower(name), id) AS INTEGER) AS rank FROM b) WHERE rank <= 10""")
def ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS10 to TS12, over the literal tiers."""
    index, meta = index_of(spark, sf_dir), testdata.records(spark, sf_dir).select("id", "name", "confidence")
    f, limits = literal(spark, sf_dir), Limits(prefix_scan=None)
    hits = search.Lookup(index, meta, limits, 10).hits(f.select(F.col("q").alias("query_id"), "q", "offset", "label").distinct())
    best = search.rank(hits, meta, 10, limits)
    return f.select("query_id", "q").join(best.withColumnRenamed("query_id", "q"), "q").select("query_id", *best.columns[1:])


@query()
def search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS1 to TS12, with rewritings and corrections."""
    q = testdata.match_queries(spark, sf_dir).select("query_id", F.col("query").alias("raw"))
    return search.search_batch(q, index_of(spark, sf_dir), testdata.records(spark, sf_dir).select("id", "name", "confidence"))
