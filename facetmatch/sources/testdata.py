"""A catalogue made of the star-schema tables, in Spark and in SQL alike: parts are records, their neighbours redirects, events the stream of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "substr(sha1(concat('part:', cast({} AS string))), 1, 16)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Asset:
    records: DataFrame
    aliases: DataFrame
    redirects: DataFrame


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, kind, name, recommended_name, confidence, manufacturer, body_type, year, traits, mounts."""
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_partkey", "l_suppkey").distinct()
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    mounts = first.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("l_partkey").agg(F.array_sort(F.collect_set("n_name")).alias("mounts"))
    part = table(spark, sf_dir, "part").where("p_size % 10 <> 0")
    made = part.selectExpr(
        "p_partkey AS ord", f"{KEY.format('p_partkey')} AS id", "CASE WHEN p_partkey % 4 = 0 THEN 'lens' ELSE 'camera' END AS kind",
        "concat_ws(' ', p_brand, p_name, p_type, cast(p_size AS string)) AS name", "concat_ws(' ', p_brand, p_name) AS recommended_name",
        "CASE WHEN p_retailprice < 933 THEN 'low' WHEN p_retailprice < 967 THEN 'medium' ELSE 'high' END AS confidence",
        "p_brand AS manufacturer", "p_type AS body_type", "CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1950 + p_size END AS year", "array_sort(array_distinct(split(p_name, ' '))) AS traits",
    )
    return made.join(mounts, made["ord"] == mounts["l_partkey"], "left").select(*made.columns, F.coalesce("mounts", F.array().cast("array<string>")).alias("mounts"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, slot, alias, kind, id, via, market. Those of parts that are redirects have no record: orphans."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS ord", f"{KEY.format('p_partkey')} AS id", "CASE WHEN p_partkey % 4 = 0 THEN 'lens' ELSE 'camera' END AS kind", "concat_ws(' ', p_brand, p_name, p_type, cast(p_size AS string)) AS name", "p_brand")
    forms = F.expr("""array(
        named_struct('slot', 0, 'alias', substr(name, length(p_brand) + 2), 'via', 'shorthand', 'market', cast(null AS string)),
        named_struct('slot', 1, 'alias', replace(name, ' ', '-'), 'via', 'punctuation', 'market', cast(null AS string)),
        named_struct('slot', 2, 'alias', replace(name, 'large', 'grand'), 'via', 'market', 'market', 'eu'))""")
    return part.select("*", F.explode(forms).alias("f")).select("ord", "f.slot", "f.alias", "kind", "id", "f.via", "f.market", "name").where("alias <> name").drop("name")


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size % 10 = 0 AND p_partkey > 0").selectExpr("p_partkey AS ord", f"{KEY.format('p_partkey')} AS from_id", "CASE WHEN p_partkey % 4 = 0 THEN 'lens' ELSE 'camera' END AS kind", f"{KEY.format('p_partkey - 1')} AS to_id")


def asset(spark: SparkSession, sf_dir: str) -> Asset:
    return Asset(records(spark, sf_dir), aliases(spark, sf_dir), redirects(spark, sf_dir))


def match_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, kind: for each user of events a part's name, the third word dropped, or two letters of the second swapped for odd users."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat_ws(' ', p_brand, p_name, p_type, cast(p_size AS string)) AS name")
    joined = users.withColumn("p_partkey", F.col("user_id") * 13 % F.lit(max(1, part.count()))).join(part, "p_partkey")
    return joined.selectExpr(
        "user_id AS query_id",
        "CASE WHEN user_id % 2 = 0 THEN array_join(concat(slice(split(name, ' '), 1, 2), slice(split(name, ' '), 4, 99)), ' ') ELSE regexp_replace(name, '^(\\\\S+ .)(.)(.)', '$1$3$2') END AS query",
        "CASE WHEN p_partkey % 4 = 0 THEN 'lens' ELSE 'camera' END AS kind",
    )


#: The same as common table expressions for DuckDB.
SQL = """
part_x AS (SELECT *, substr(sha1('part:' || p_partkey), 1, 16) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'lens' ELSE 'camera' END AS kind, p_brand || ' ' || p_name || ' ' || p_type || ' ' || p_size AS name FROM part),
mount_x AS (SELECT l_partkey, list_sort(list(DISTINCT n_name)) AS mounts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_linenumber = 1 GROUP BY 1),
records AS (SELECT p_partkey AS ord, id, kind, name, p_brand || ' ' || p_name AS recommended_name, CASE WHEN p_retailprice < 933 THEN 'low' WHEN p_retailprice < 967 THEN 'medium' ELSE 'high' END AS confidence,
  p_brand AS manufacturer, p_type AS body_type, CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1950 + p_size END AS year, list_sort(list_distinct(string_split(p_name, ' '))) AS traits, coalesce(mounts, []) AS mounts
  FROM part_x LEFT JOIN mount_x ON p_partkey = l_partkey WHERE p_size % 10 <> 0),
alias_x AS (SELECT p_partkey AS ord, 0 AS slot, substr(name, length(p_brand) + 2) AS alias, kind, id, 'shorthand' AS via, NULL AS market, name FROM part_x
  UNION ALL SELECT p_partkey, 1, replace(name, ' ', '-'), kind, id, 'punctuation', NULL, name FROM part_x
  UNION ALL SELECT p_partkey, 2, replace(name, 'large', 'grand'), kind, id, 'market', 'eu', name FROM part_x),
aliases AS (SELECT ord, slot, alias, kind, id, via, market FROM alias_x WHERE alias <> name),
redirects AS (SELECT p_partkey AS ord, id AS from_id, kind, substr(sha1('part:' || (p_partkey - 1)), 1, 16) AS to_id FROM part_x WHERE p_size % 10 = 0 AND p_partkey > 0)"""
