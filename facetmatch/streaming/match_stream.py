"""Streams (an extension: the queries arrive as files, the catalogue stands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetmatch.operators.catalog import Catalog
from facetmatch.operators.matching import Policy, match_batch


def match_stream(queries: DataFrame, catalog: Catalog, out: str, checkpoint: str, policy: Policy = Policy()) -> StreamingQuery:
    """Each micro-batch of queries is matched and written under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        match_batch(batch, catalog, policy).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(spark: SparkSession, path: str) -> DataFrame:
    """Counts by event type in windows of an hour, late rows of up to ten minutes admitted."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
