"""Queries of browsing, names, hazards, the contract, related records and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmatch.functions.display import explain, hazards
from facetmatch.operators import browse, contract, names, overlay
from facetmatch.operators.browse import Filters
from facetmatch.operators.ranks import ranked
from facetmatch.registry import query
from facetmatch.sources import testdata
from facetmatch.sources.testdata import asset, records

T = "WITH " + testdata.SQL
PICKED = Filters(kind="camera", body="SMALL", traits=("red",))
SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
P = {"kind": "kind = 'camera'", "body": "kind = 'camera' AND body_type = 'SMALL'", "traits": "list_contains(traits, 'red')"}


def left(*out: str) -> str:
    return " AND ".join(f"({v})" for k, v in P.items() if k not in out)


COUNTS = f""", c AS (
SELECT 'manufacturer' AS facet, manufacturer AS value, ord * 1000 AS ord FROM records WHERE {left()} UNION ALL SELECT 'body', body_type, ord * 1000 FROM records WHERE {left('body')} AND kind = 'camera'
UNION ALL SELECT 'ltype', body_type, ord * 1000 FROM records WHERE {left()} AND kind = 'lens' UNION ALL SELECT 'mount', unnest(mounts), ord * 1000 + unnest(range(len(mounts))) FROM records WHERE {left()}),
n AS (SELECT facet, value, count(*) AS n, min(ord) AS first FROM c WHERE value <> '' GROUP BY ALL)"""


@query(T + COUNTS + " SELECT facet, value, n FROM n")
def facet_counts_disjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.facet_counts(records(spark, sf_dir), PICKED).select("facet", "value", "n")


@query(T + f", b AS (SELECT traits, list_contains(traits, 'red') AS picked FROM records WHERE {left('traits')} AND kind = 'camera'), x AS (SELECT unnest(list_distinct(traits)) AS value, picked FROM b) SELECT value, count(*) FILTER (WHERE picked) AS n FROM x GROUP BY value HAVING count(*) FILTER (WHERE picked) > 0 OR value = 'red'")
def trait_facets_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.trait_counts(records(spark, sf_dir), PICKED)


@query(T + COUNTS + " SELECT facet, value, n, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY n DESC, first) AS INTEGER) AS place FROM n) WHERE place <= 10 OR (facet = 'manufacturer' AND value = 'Brand#7')")
def facet_topk_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = browse.facet_counts(records(spark, sf_dir), PICKED)
    return browse.shortened(counts, (F.col("facet") == "manufacturer") & (F.col("value") == "Brand#7")).select("facet", "value", "n", "place")


@query(T + COUNTS + " SELECT facet, value, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY n DESC, first) AS INTEGER) AS place FROM n WHERE contains(lower(value), 'an')) WHERE place <= 50")
def facet_value_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.facet_search(browse.facet_counts(records(spark, sf_dir), PICKED), "AN").select("facet", "value", "place")


@query(T + " SELECT id, name, year FROM records WHERE kind = 'camera' ORDER BY year = 0, year, ord LIMIT 60 OFFSET 60")
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BR7, BR8: the second page by year (a page is the feature)."""
    return browse.page(records(spark, sf_dir), Filters(kind="camera"), 2, "year").select("id", "name", "year")


@query(T + " SELECT kind, id, CAST(row_number() OVER (PARTITION BY kind ORDER BY year = 0, year, ord) AS INTEGER) AS place FROM records")
def year_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("kind", F.coalesce(F.nullif("year", F.lit(0)), F.lit(99_999)).alias("y"), "ord", "id")
    return ranked(rows, ["kind", "y", "ord"], ["kind"], "place").select("kind", "id", F.col("place").cast("int").alias("place"))


@query("WITH RECURSIVE " + testdata.SQL + ", walk(id, kind, spot, hops) AS (SELECT from_id, kind, from_id, 0 FROM redirects UNION ALL SELECT w.id, w.kind, r.to_id, hops + 1 FROM walk w JOIN redirects r ON r.from_id = w.spot WHERE hops < 16) SELECT id, arg_max(spot, hops) AS resolved, CAST(max(hops) AS INTEGER) AS hops FROM walk GROUP BY id")
def redirect_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM3, with no kind: every stale id."""
    r = testdata.redirects(spark, sf_dir)
    return names.resolve(r.select(F.col("from_id").alias("id"), F.lit(None).cast("string").alias("kind")), r).select("id", "resolved", "hops")


@query(T + ", a AS (SELECT id, list(alias ORDER BY slot) AS said FROM aliases WHERE via IN ('correction', 'maker', 'market', 'name', 'superseded') GROUP BY id) SELECT r.id, name AS canonical, recommended_name AS recommended, list_concat([name], list_filter(coalesce(said, []), lambda x: x <> name)) AS spoken FROM records r LEFT JOIN a USING (id)")
def names_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = asset(spark, sf_dir)
    return names.spoken_names(a.records, a.aliases)


@query(T + " SELECT r.id, list(a.alias ORDER BY a.slot) AS others FROM records r JOIN aliases a USING (id) WHERE a.via = 'market' AND a.alias <> r.name GROUP BY r.id")
def other_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = asset(spark, sf_dir)
    named = a.aliases.where("via = 'market'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", F.col("alias").alias("name"), "market"))).alias("m"))
    return a.records.join(named, "id").select("id", F.transform(names.other_market_names(F.col("m"), F.col("name")), lambda m: m["name"]).alias("others")).where("size(others) > 0")


FILMS = "(['126', '120', '110', '620', ' APS ', '35mm', 'Disc', '127', '116', '828'])"
CELLS = "(['PX625', 'LR44', 'PX625A', 'MR-9', 'MR9', 'mercury 1.35V', 'HG', 'SR44', 'V625'])"


@query(T + f", h AS (SELECT id, lower(trim({FILMS}[p.ord % 10 + 1])) AS film, {CELLS}[p.ord % 9 + 1] AS cell FROM records p) SELECT id, film IN ('126', '110', '620', '828', '127', '116', '117', 'aps', 'disc') AS dead_film, cell IN ('PX625', 'MR9', 'mercury 1.35V', 'HG', 'V625') AS mercury FROM h")
def hazard_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HZ1 to HZ3, with film and battery dealt to records by number."""
    film, cell = (F.expr(f"element_at(array{x.replace('[', '').replace(']', '')}, cast(ord % {n} + 1 AS int))") for x, n in ((FILMS, 10), (CELLS, 9)))
    h = records(spark, sf_dir).select("id", hazards(film, F.array(cell)).alias("h"))
    has = lambda kind: F.exists("h", lambda x: x["kind"] == kind)
    return h.select("id", has("film").alias("dead_film"), has("battery").alias("mercury"))


@query(T + " SELECT id, slot, CASE via WHEN 'market' THEN 'matched “' || alias || '” — the European name' WHEN 'shorthand' THEN 'matched the shorthand “' || alias || '”' ELSE 'matched “' || alias || '”' END AS text FROM aliases JOIN records USING (id)")
def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = asset(spark, sf_dir)
    shown = F.coalesce("recommended_name", "name")
    return a.aliases.join(a.records.select("id", "name", "recommended_name"), "id").select("id", "slot", explain(shown, F.col("alias"), F.col("via"), F.col("market")).alias("text"))


BODIES, KNOWN = ("SMALL", "MEDIUM", "LARGE", "ECONOMY"), ("red", "small", "ring")


@query(T + """, live AS (SELECT DISTINCT id FROM records)
SELECT 'body_type.enum' AS code, id FROM records WHERE kind = 'camera' AND body_type NOT IN ('SMALL', 'MEDIUM', 'LARGE', 'ECONOMY')
UNION ALL SELECT 'traits.enum', id FROM records WHERE len(list_filter(traits, lambda t: t NOT IN ('red', 'small', 'ring'))) > 0
UNION ALL SELECT 'body_type.on-lens', id FROM records WHERE kind = 'lens'
UNION ALL SELECT 'mounts.on-camera', id FROM records WHERE kind = 'camera' AND len(mounts) > 0
UNION ALL SELECT 'alias.market-on-lens', id FROM aliases WHERE kind = 'lens' AND via = 'market'
UNION ALL SELECT 'alias.orphan', id FROM aliases WHERE id NOT IN (SELECT id FROM live)
UNION ALL SELECT 'redirect.dangling', from_id FROM redirects WHERE to_id NOT IN (SELECT id FROM live UNION SELECT from_id FROM redirects)""")
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = asset(spark, sf_dir)
    return contract.validate(a.records, a.aliases, a.redirects, BODIES, KNOWN)


@query(T + """, p AS (SELECT a.id, b.id AS related, row_number() OVER (PARTITION BY a.id ORDER BY b.body_type <> a.body_type, len(list_intersect(a.traits, b.traits)) DESC,
  CASE WHEN a.year = 0 THEN 0 WHEN b.year = 0 THEN 1000000 ELSE abs(b.year - a.year) END, b.ord) AS rank FROM records a JOIN records b ON a.kind = b.kind AND a.manufacturer = b.manufacturer AND a.id <> b.id)
SELECT id, CAST(rank AS INTEGER) AS rank, related FROM p WHERE rank <= 4""")
def related_same_maker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.same_maker(records(spark, sf_dir))


@query(T + """, p AS (SELECT a.id, b.id AS related, row_number() OVER (PARTITION BY a.id ORDER BY b.manufacturer <> a.manufacturer, CASE WHEN b.year = 0 THEN 1000000 WHEN a.year = 0 THEN 0 ELSE abs(b.year - a.year) END, b.ord) AS rank
  FROM records a JOIN records b ON a.kind <> b.kind AND len(list_intersect(a.mounts, b.mounts)) > 0)
SELECT id, CAST(rank AS INTEGER) AS rank, related FROM p WHERE rank <= 4""")
def mount_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.mount_matches(records(spark, sf_dir))


@query(T + " SELECT id, CASE WHEN ord % 10 = 3 THEN 'FIXED' ELSE body_type END AS body_type, CASE WHEN ord % 10 = 5 THEN NULL ELSE manufacturer END AS manufacturer, CASE WHEN ord % 10 = 3 THEN 1999 ELSE year END AS year FROM records")
def overlay_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CO1: every tenth record is set anew, another tenth has a field blanked. Records go by id here, as names collide."""
    r = records(spark, sf_dir).withColumn("name", F.col("id"))
    c = r.where("ord % 10 in (3, 5)").select("name", "kind", "ord", F.parse_json(F.when(F.col("ord") % 10 == 3, '{"body_type": "FIXED", "year": 1999}').otherwise('{"manufacturer": null}')).alias("set"))
    return overlay.apply_sets(r, c, ["body_type", "manufacturer", "year"]).select("id", "body_type", "manufacturer", "year")


@query(T + ", m AS (SELECT ord, id, lead(id) OVER (ORDER BY ord) AS nxt FROM records), g AS (SELECT id, nxt FROM m WHERE ord % 50 = 1 AND nxt IS NOT NULL) SELECT r.id, coalesce(nullif(r.year, 0), (SELECT max(nullif(x.year, 0)) FROM g JOIN records x ON x.id = g.id WHERE g.nxt = r.id), 0) AS year FROM records r WHERE r.id NOT IN (SELECT id FROM g)")
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CO3: every fiftieth record is merged into the next, which takes its year where it has none."""
    r = records(spark, sf_dir).withColumn("year", F.nullif("year", F.lit(0)))
    placed = ranked(r.select(F.lit(0).alias("all"), "ord", "id", "kind"), ["all", "ord"], ["all"], "place")
    nxt = placed.where("ord % 50 = 1").join(placed.select((F.col("place") - 1).alias("place"), F.col("id").alias("to_id")), "place").select("ord", "id", "kind", "to_id")
    survivors, _, _ = overlay.merge(r, nxt.select(F.col("id").alias("from_id"), "kind", "to_id", "ord"), ["year"])
    return survivors.select("id", F.coalesce("year", F.lit(0)).alias("year"))
