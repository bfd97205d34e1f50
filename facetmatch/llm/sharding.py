"""Proportional stratified interleaving: every shard holds each source in the proportion of the whole.

Rows of a source are ranked in the order of md5(seed:doc_id), a seeded shuffle; a row's fraction is (rank - 1/2) / rows of its source. Rows sorted
by fraction (then source, md5, id) interleave the sources evenly, and equal cuts of that order are the shards. Ranks are taken from
range-partitioned, sorted rows, by adding up the counts of the partitions before; so neither a hot source nor the whole table has to be
sorted in one task, and only ids, sources and hashes are shuffled.

Defined results: a null source is a stratum of its own; rows with a null id take part, ordered first. Rows that repeat an id, or an id and a source, each get a place
(which of them gets which is immaterial). With fewer rows than shards some shards are empty. Empty tables give no rows. Texts aren't read; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmatch.llm.common import pick
from facetmatch.operators.ranks import ranked


@dataclass(frozen=True)
class Params:
    shards: int = 64
    seed: int = 17


def interleaved(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """A row a row of docs: doc_id, source, fraction, position (from 0), shard."""
    rows = pick(docs, "doc_id", "source").withColumn("h", F.md5(F.concat_ws(":", F.lit(str(p.seed)), F.col("doc_id").cast("string"))))
    # _t parts rows that are alike in all else, such as those with null ids, so that a task needn't sort them all
    by_source = ranked(rows.withColumn("_t", F.monotonically_increasing_id()), ["source", "h", "doc_id", "_t"], ["source"], "r")
    placed = by_source.select("doc_id", "source", "h", ((F.col("r") - 0.5) / F.col("r_of")).alias("fraction"), F.lit(0).alias("all"))
    whole = ranked(placed, ["all", "fraction", "source", "h", "doc_id"], ["all"], "position")
    at = F.col("position") - 1
    return whole.select("doc_id", "source", F.round("fraction", 9).alias("fraction"), at.alias("position"), F.floor(at * p.shards / F.col("position_of")).cast("int").alias("shard"))


SQL = """
WITH r AS (SELECT doc_id, source, md5({seed} || ':' || doc_id) AS h FROM documents),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY f, source, h, doc_id) - 1 AS position, count(*) OVER () AS n FROM f)
SELECT doc_id, source, round(f, 9) AS fraction, position, CAST(floor(position * {shards} / n) AS INTEGER) AS shard FROM o
""".format(seed=Params().seed, shards=Params().shards)
