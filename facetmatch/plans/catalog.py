"""The catalogue: entries with their aliases, the inverted index, the vocabulary, and the tables of the build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmatch.functions import sql as S
from facetmatch.operators.catalog import Catalog, build, index_rows_of, order_tier
from facetmatch.registry import query
from facetmatch.sources import testdata

CTE = "WITH " + testdata.SQL + f""",
alias_n AS (SELECT *, {S.norm('alias')} AS norm FROM aliases),
entry AS (SELECT *, {S.norm('name')} AS norm FROM records),
entries AS (SELECT *, {S.words('norm')} AS tokens FROM entry)"""


def entries_of(spark: SparkSession, sf_dir: str) -> Catalog:
    return build(testdata.asset(spark, sf_dir))


@query("WITH " + testdata.SQL + " SELECT ord, id, kind, name FROM records WHERE id IS NOT NULL AND name IS NOT NULL")
def src_records_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = testdata.records(spark, sf_dir).where("id is not null and name is not null")
    return r.where("kind = 'camera'").unionByName(r.where("kind = 'lens'")).select("ord", "id", "kind", "name")


@query(CTE + ", g AS (SELECT id, list(alias ORDER BY slot) AS names, list(via ORDER BY slot) AS via FROM alias_n GROUP BY id) SELECT r.id, coalesce(g.names, []) AS alias_names, coalesce(g.via, []) AS alias_via FROM records r LEFT JOIN g USING (id)")
def alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries_of(spark, sf_dir).entries
    return e.select("id", F.transform("aliases", lambda a: a["alias"]).alias("alias_names"), F.transform("aliases", lambda a: a["via"]).alias("alias_via"))


@query(CTE + ", s AS (SELECT norm, ord, 0 AS slot, id FROM entries UNION ALL SELECT a.norm, e.ord, a.slot + 1, e.id FROM alias_n a JOIN entries e USING (id)) SELECT norm, id FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY ord, slot) AS n FROM s) WHERE n = 1")
def by_norm_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT4: the first writer of each normal form."""
    e = entries_of(spark, sf_dir).entries
    forms = e.select("ord", "id", F.posexplode(F.concat(F.array("norm"), F.transform("aliases", lambda a: a["norm"]))).alias("slot", "norm"))
    return forms.groupBy("norm").agg(F.min_by("id", F.struct("ord", "slot")).alias("id"))


@query(CTE + f", w AS (SELECT ord, unnest(tokens) AS token FROM entries UNION SELECT e.ord, unnest({S.words('a.norm')}) FROM alias_n a JOIN entries e USING (id)) SELECT token, count(*) AS entries, min(ord) AS first_entry FROM w GROUP BY token")
def postings_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(spark, sf_dir).postings.groupBy("token").agg(F.count("*").alias("entries"), F.min("ord").alias("first_entry"))


@query(CTE + r" SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM entries) WHERE length(token) >= 3 AND NOT regexp_matches(token, '\d') GROUP BY token")
def vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(spark, sf_dir).vocab.select("token", "freq")


@query("WITH " + testdata.SQL + " SELECT a.ord, a.slot, a.alias, a.id FROM aliases a WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.id = a.id)")
def alias_orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL3."""
    a = testdata.asset(spark, sf_dir)
    return a.aliases.join(a.records.select("id"), "id", "left_anti").select("ord", "slot", "alias", "id")


# every form here is letters, digits, spaces, # and -, so that the typeahead form comes down to a few rules
TYPE = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9.]+', ' ', 'g'), '(\d)([a-z])', '\1 \2', 'g'), '([a-z])(\d)', '\1 \2', 'g'))"
INDEX = f""", forms AS (SELECT ord, -1 AS slot, kind, id, name AS form, recommended_name FROM records UNION ALL SELECT a.ord, a.slot, a.kind, a.id, a.alias, r.recommended_name FROM aliases a JOIN records r USING (id)),
keyed AS (SELECT *, {TYPE('form')} AS n FROM forms),
idx AS (SELECT n, kind, id, CASE WHEN form = recommended_name THEN '' ELSE form END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY n, id ORDER BY slot >= 0, ord, slot) AS k FROM keyed WHERE n <> '') WHERE k = 1)"""


@query("WITH " + testdata.SQL + INDEX + " SELECT n, kind, id, shown FROM idx")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_rows_of(testdata.asset(spark, sf_dir))


PROJECTED = "id, kind, name, recommended_name, left(confidence, 1) AS confidence, manufacturer, body_type, year, traits, mounts, CASE kind WHEN 'lens' THEN 'l' ELSE 'c' END AS letter, len(traits) AS n_traits"


@query("WITH " + testdata.SQL + f" SELECT {PROJECTED} FROM records")
def catalog_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL4."""
    return testdata.records(spark, sf_dir).selectExpr(*[x.strip() for x in PROJECTED.replace("len(traits)", "size(traits)").split(", ")][:3], "recommended_name", "left(confidence, 1) AS confidence", "manufacturer", "body_type", "year", "traits", "mounts", "CASE kind WHEN 'lens' THEN 'l' ELSE 'c' END AS letter", "size(traits) AS n_traits")


@query("WITH " + testdata.SQL + r" SELECT id, CASE WHEN coalesce(manufacturer, '') = '' THEN 2 WHEN confidence = 'high' THEN 0 ELSE 1 END AS tier, regexp_replace(name, '^[^A-Za-z]+', '') AS sort_name FROM records")
def catalog_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL5: what the total order goes by."""
    return testdata.records(spark, sf_dir).select("id", order_tier().alias("tier"), F.regexp_replace("name", r"^[^\p{L}]+", "").alias("sort_name"))


@query("WITH " + testdata.SQL + " SELECT manufacturer, count(*) AS records FROM records GROUP BY manufacturer")
def manufacturer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.records(spark, sf_dir).groupBy("manufacturer").agg(F.count("*").alias("records"))


TILES = {
    "makers": "count(DISTINCT manufacturer)",
    "small_high": "count(*) FILTER (WHERE body_type = 'SMALL' AND confidence = 'high')",
    "economy_late": "count(*) FILTER (WHERE body_type = 'ECONOMY' AND year > 1980)",
    "mount_china": "count(*) FILTER (WHERE lower(array_to_string(mounts, ',')) LIKE '%china%')",
    "lens_promo": "count(*) FILTER (WHERE kind = 'lens' AND body_type = 'PROMO')",
    "undated": "count(*) FILTER (WHERE year = 0)",
    "trait_small": "count(*) FILTER (WHERE list_contains(traits, 'small'))",
    "trait_red": "count(*) FILTER (WHERE list_contains(traits, 'red'))",
    "trait_ring": "count(*) FILTER (WHERE list_contains(traits, 'ring'))",
}


@query("WITH " + testdata.SQL + " SELECT " + ", ".join(f"{v} AS {k}" for k, v in TILES.items()) + " FROM records")
def curated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL7: all tiles in one pass."""
    return testdata.records(spark, sf_dir).selectExpr(*[f"{v.replace('array_to_string', 'array_join').replace('list_contains', 'array_contains')} AS {k}" for k, v in TILES.items()])


@query("WITH " + testdata.SQL + " SELECT left(id, 2) AS shard, count(*) AS records, min(name) AS first_name FROM records GROUP BY 1")
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL8."""
    return testdata.records(spark, sf_dir).groupBy(F.substring("id", 1, 2).alias("shard")).agg(F.count("*").alias("records"), F.min("name").alias("first_name"))
