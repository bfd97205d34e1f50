"""Names of records and redirects between them (NM1 to NM3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmatch.session import checkpoint

SPOKEN = ("name", "market", "superseded", "correction", "maker")
HOPS = 16


def spoken_names(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """NM1: id, canonical, recommended, spoken (the name, then what a person might say). aliases: id, slot, alias, via."""
    said = aliases.where(F.col("via").isin(*SPOKEN)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "alias"))).alias("a"))
    others = F.coalesce(F.transform("a", lambda x: x["alias"]), F.array().cast("array<string>"))
    return records.join(said, "id", "left").select("id", F.col("name").alias("canonical"), F.coalesce("recommended_name", "name").alias("recommended"), F.array_distinct(F.concat(F.array("name"), others)).alias("spoken"))


def market_order(market_names):
    """NM1: the primary ones first, else as they are."""
    first = F.filter(market_names, lambda m: F.coalesce(m["primary"], F.lit(False)))
    return F.concat(first, F.filter(market_names, lambda m: ~F.coalesce(m["primary"], F.lit(False))))


def other_market_names(market_names, name):
    """NM2."""
    return F.filter(market_names, lambda m: m["name"] != name)


def resolve(ids: DataFrame, redirects: DataFrame, hops: int = HOPS) -> DataFrame:
    """NM3. ids: id, kind (null: a camera's edge, else a lens'). Adds resolved and hops. redirects: from_id, kind, to_id, ord; of several edges the last counts.

    Only ids that still move are joined again, and rounds end when none does; a chain that comes back to an id stops before it."""
    edges = redirects.groupBy("from_id", "kind").agg(F.max_by("to_id", "ord").alias("to_id"))
    edges = checkpoint(edges.withColumn("any", F.lit(False)).union(edges.groupBy("from_id").agg(F.min_by("to_id", "kind").alias("to_id")).select("from_id", F.lit("").alias("kind"), "to_id", F.lit(True))).select("from_id", "kind", "to_id"))
    start = ids.select("id", "kind").distinct()
    moving = start.select("id", "kind", F.col("id").alias("at"), F.array("id").alias("seen"))
    done = None
    for _ in range(hops):
        step = checkpoint(moving.join(edges.withColumnRenamed("kind", "k"), (F.col("at") == F.col("from_id")) & (F.coalesce("kind", F.lit("")) == F.col("k")), "left"))
        goes = F.col("to_id").isNotNull() & ~F.array_contains("seen", F.coalesce("to_id", F.lit("")))
        still = step.where(~goes).select("id", "kind", F.col("at").alias("resolved"), (F.size("seen") - 1).alias("hops"))
        done = still if done is None else done.union(still)
        moving = step.where(goes).select("id", "kind", F.col("to_id").alias("at"), F.array_append("seen", F.col("to_id")).alias("seen"))
        if moving.isEmpty():
            return done
    return done.union(moving.select("id", "kind", F.col("at").alias("resolved"), (F.size("seen") - 1).alias("hops")))
