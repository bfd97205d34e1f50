"""The catalogue (CAT1 to CAT6) and the tables of its build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmatch.functions.similarity import trigrams
from facetmatch.functions.text import digits_of, let, match_normalize, type_normalize, words_of
from facetmatch.session import checkpoint, spread
from facetmatch.sources.testdata import Asset


@dataclass(frozen=True)
class Catalog:
    entries: DataFrame
    postings: DataFrame
    vocab: DataFrame


def build(asset: Asset) -> Catalog:
    """CAT1 to CAT6. entries: ord, id, kind, title, norm, tokens, grams, digits, aliases (of alias, norm, grams, via, market)."""
    rows = spread(asset.records.where("id is not null and name is not null"), "id")
    raw = spread(asset.aliases.where("id is not null and alias is not null"), "id")
    grouped = raw.groupBy(F.col("id").alias("alias_of")).agg(F.array_sort(F.collect_list(F.struct("slot", "alias", "via", "market"))).alias("raw"))
    form = lambda x: let(match_normalize(x["alias"]), lambda n: F.struct(x["slot"].alias("slot"), x["alias"].alias("alias"), n.alias("norm"), trigrams(n).alias("grams"), x["via"].alias("via"), x["market"].alias("market")))
    joined = rows.join(grouped, F.col("id") == F.col("alias_of"), "left").withColumn("norm", match_normalize(F.col("name"))).withColumn("a", F.transform("raw", form))
    none = F.array().cast("array<struct<slot:int,alias:string,norm:string,grams:array<string>,via:string,market:string>>")
    entries = joined.select(
        "ord", "id", "kind", F.col("name").alias("title"), "norm", words_of(F.col("norm")).alias("tokens"), trigrams(F.col("norm")).alias("grams"), digits_of(F.col("norm")).alias("digits"),
        F.coalesce(F.filter("a", lambda x: x["alias"] != F.col("name")), none).alias("aliases"),
    )
    return Catalog(entries, postings(entries), vocabulary(entries))


def postings(entries: DataFrame) -> DataFrame:
    """CAT5: token, ord, kind, size of the norm."""
    every = F.array_distinct(F.concat(F.col("tokens"), F.flatten(F.transform("aliases", lambda a: words_of(a["norm"])))))
    return entries.select("ord", "kind", F.length("norm").alias("size"), F.explode(every).alias("token"))


def vocabulary(entries: DataFrame) -> DataFrame:
    """CAT6: token, freq, first (where it is first seen, as a tie-break)."""
    seen = entries.select("ord", F.posexplode("tokens").alias("pos", "token")).where("length(token) >= 3 and not token rlike '[0-9]'")
    return seen.groupBy("token").agg(F.count("*").alias("freq"), F.min(F.struct("ord", "pos")).alias("first"))


def stored(catalog: Catalog) -> Catalog:
    """The catalogue, worked out once; at scale, write entries as Parquet and read them instead."""
    entries = checkpoint(catalog.entries)
    return Catalog(entries, checkpoint(postings(entries)), checkpoint(vocabulary(entries)))


def index_rows_of(asset: Asset) -> DataFrame:
    """PL2: n, kind, id, shown: record names, then aliases; the first of each (n, id); shown is empty if equal to the recommended name.

    Names are hashed over all tasks, however few files they come from, and each distinct one is worked out once."""
    named = asset.records.select("ord", F.lit(-1).alias("slot"), "kind", "id", F.col("name").alias("form"), "recommended_name")
    spoken = asset.aliases.join(asset.records.select("id", "recommended_name"), "id").select("ord", "slot", "kind", "id", F.col("alias").alias("form"), "recommended_name")
    every = spread(named.union(spoken), "form")
    # exploded, so that the filter isn't pushed below and the form worked out twice
    normal = every.select("form").distinct().withColumn("n", F.explode(F.filter(F.array(type_normalize(F.col("form"))), lambda n: n != "")))
    rows = every.join(normal, "form")
    first = rows.groupBy("n", "id").agg(F.min_by(F.struct("kind", "form", "recommended_name"), F.struct(F.col("slot") >= 0, "ord", "slot")).alias("r"))
    return first.select("n", "r.kind", "id", F.when(F.col("r.form") == F.col("r.recommended_name"), "").otherwise(F.col("r.form")).alias("shown"))


def order_tier() -> Column:
    return F.when(F.coalesce("manufacturer", F.lit("")) == "", 2).when(F.col("confidence") == "high", 0).otherwise(1)


def ordered(records: DataFrame) -> DataFrame:
    """PL5: a distributed sort with locale-aware comparison."""
    return records.orderBy(order_tier(), F.collate(F.regexp_replace("name", r"^[^\p{L}]+", ""), "UNICODE"), F.collate("name", "UNICODE"), "id")
