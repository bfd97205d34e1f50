"""Corrections laid over records (CO1 to CO3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetmatch.operators.names import resolve


def apply_sets(records: DataFrame, corrections: DataFrame, fields: list[str]) -> DataFrame:
    """CO1. corrections: name, kind, set (variant), ord. Fields named in set are replaced; an explicit null blanks one; of several directives for a record the last counts, field by field. Rows that merge are passed over."""
    rows = corrections.where("merge_into is null") if "merge_into" in corrections.columns else corrections
    wanted = rows.where("set is not null").select("name", "kind", "ord", F.col("set").cast("map<string,variant>").alias("m"))
    last = wanted.select("name", "kind", "ord", F.explode("m").alias("field", "value")).groupBy("name", "kind", "field").agg(F.max_by(F.struct(F.col("value").cast("string").alias("v")), "ord").alias("x"))
    folded = last.groupBy("name", "kind").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("x.v")))).alias("patch"))
    joined = records.join(folded, ["name", "kind"], "left")
    patched = lambda f: F.when(F.map_contains_key("patch", F.lit(f)), F.try_element_at("patch", F.lit(f)).cast(records.schema[f].dataType)).otherwise(F.col(f)).alias(f)
    return joined.select(*[patched(c) if c in fields else F.col(c) for c in records.columns])


def added_aliases(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """CO2: alias, kind, id, via=correction."""
    rows = corrections.select("name", "kind", F.explode("aliases").alias("alias"))
    return rows.join(records.select("name", "kind", "id"), ["name", "kind"]).select("alias", "kind", "id", F.lit("correction").alias("via"), F.lit(None).cast("string").alias("market")).distinct()


def merge(records: DataFrame, merges: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CO3. merges: from_id, kind, to_id, ord. The surviving records, each with facts that it lacks taken from those merged into it (in order of ord); the redirects, resolved; and the directives dropped, for a missing target or a cycle."""
    live = records.select("id").distinct()
    merges = merges.join(live.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    aimed = merges.join(live.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    lost = merges.join(live.select(F.col("id").alias("to_id")), "to_id", "left_anti").select("from_id", "to_id", F.lit("missing target").alias("reason"))
    ends = resolve(aimed.select(F.col("from_id").alias("id"), "kind"), aimed).select(F.col("id").alias("from_id"), "kind", "resolved")
    # a chain that ends at an id which is itself merged away has run in a circle
    circular = ends.join(aimed.select(F.col("from_id").alias("resolved")).distinct(), "resolved", "left_semi")
    lost = lost.union(circular.select("from_id", F.col("resolved").alias("to_id"), F.lit("cycle").alias("reason")))
    good = ends.join(circular.select("from_id", "kind"), ["from_id", "kind"], "left_anti")
    ordered = good.join(aimed.select("from_id", "kind", "ord"), ["from_id", "kind"]).select(F.col("from_id").alias("id"), "resolved", F.col("ord").cast("long").alias("_ord")).union(records.join(good.select(F.col("from_id").alias("id")), "id", "left_anti").select("id", F.col("id").alias("resolved"), F.lit(-1).cast("long")))
    members = ordered.join(records, "id")
    lead = W.partitionBy("resolved").orderBy("_ord", "id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = members.select(F.col("id"), F.col("resolved"), *[F.first(F.col(f), ignorenulls=True).over(lead).alias(f) for f in fields])
    survivors = records.join(filled.where("id = resolved").select("id", *[F.col(f).alias(f"_{f}") for f in fields]), "id").select(*[F.col(f"_{c}").alias(c) if c in fields else F.col(c) for c in records.columns])
    return survivors, good.select("from_id", "kind", F.col("resolved").alias("to_id")), lost
