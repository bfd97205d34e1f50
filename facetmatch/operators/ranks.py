"""Ranks over whole tables by distributed sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetmatch.session import checkpoint


def ranked(df: DataFrame, order: list[str], strata: list[str], name: str) -> DataFrame:
    """df with the rank (from 1) of each row within its stratum, in the given order, as a distributed sort. strata must lead the order."""
    lines = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    lines = checkpoint(lines.select("*", F.monotonically_increasing_id().alias("_m")))
    split = lines.select("*", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    per = split.groupBy(*strata, "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = W.partitionBy(*strata).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], F.col("_p").alias("_q"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*strata)).alias(f"{name}_of"))
    on = (F.col("_p") == F.col("_q"))
    for i, c in enumerate(strata):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    return split.join(per, on).select(*df.columns, (F.col("_i") - F.col("_first") + F.col("_before") + 1).alias(name), f"{name}_of")
