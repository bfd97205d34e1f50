"""JSONL sources and the build's sinks (SRC1 to SRC8, SNK1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKET_NAME = "struct<name:string,market:string,primary:boolean>"
VARIANT = "struct<name:string,tell:string,premium:boolean>"
FIXED = "struct<name:string,focal_length:string,focal_min_mm:double,focal_max_mm:double,max_aperture:string,min_aperture:string,lens_type:string,filter_size:string>"
DATA = (
    "struct<name:string,manufacturer:string,country:string,manual_url:string,year_introduced:int,year_discontinued:int,"
    f"variants:array<{VARIANT}>,market_names:array<{MARKET_NAME}>,body_type:string,traits:array<string>,camera_type:string,folding:int,mount:string,medium:string,format:string,"
    f"frame_size:string,sensor_format:string,sensor_size:string,sensor_tech:string,sensor_resolution_mp:double,lens_mount:string,fixed_lens:{FIXED},mounts:array<string>,shutter_type:string,"
    "shutter_speeds:string,meter_type:string,metered:int,batteries:array<string>,focal_length:string,focal_min_mm:double,focal_max_mm:double,lens_type:string,max_aperture:string,min_aperture:string,"
    "filter_size:string,elements_groups:string,min_focus:string,also_takes:array<struct<format:string,frame_size:string,via:string>>,exposure_modes:array<string>,iso_manual_range:string,dx_coding:string,dx_range:string>"
)
RECORD = f"id string, name string, recommended_name string, confidence string, data {DATA}, variants array<{VARIANT}>"
#: {0}: the prefix that the release gives its own fields.
ALIAS = "alias string, {0}_kind string, {0}_id string, via string, market string"
REDIRECT = "from_id string, from_name string, {0}_kind string, to_id string, to_name string"


def parse_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC1: blank and malformed lines are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC2: a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def records_from_jsonl(spark: SparkSession, cameras: str, lenses: str) -> DataFrame:
    """CAT1, SRC3: cameras, then lenses, with their kind; rows without id or name dropped; ord keeps the files' order."""
    tag = lambda path, kind, at: parse_jsonl(spark, path, RECORD).where("id is not null and name is not null").select(F.lit(kind).alias("kind"), "*", (F.lit(at << 60) + F.monotonically_increasing_id()).alias("ord"))
    return tag(cameras, "camera", 0).unionByName(tag(lenses, "lens", 1))


def aliases_from_jsonl(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    rows = parse_jsonl(spark, path, ALIAS.format(prefix)).where(f"alias is not null and {prefix}_id is not null")
    return rows.select("alias", F.col(f"{prefix}_kind").alias("kind"), F.col(f"{prefix}_id").alias("id"), "via", "market", F.monotonically_increasing_id().alias("slot"))


def redirects_from_jsonl(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    rows = parse_jsonl(spark, path, REDIRECT.format(prefix)).where("from_id is not null and to_id is not null")
    return rows.select(F.monotonically_increasing_id().alias("ord"), "from_id", F.col(f"{prefix}_kind").alias("kind"), "to_id")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: the set of a directive stays a variant, so that null and absent differ."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("v"), F.monotonically_increasing_id().alias("ord")).where("v is not null")
    get = lambda p, t: F.try_variant_get("v", p, t)
    return rows.select(get("$.name", "string").alias("name"), get("$.kind", "string").alias("kind"), get("$.set", "variant").alias("set"), get("$.aliases", "array<string>").alias("aliases"), get("$.note", "string").alias("note"), get("$.merge_into", "string").alias("merge_into"), "ord")


def engine_inputs(entries: DataFrame, catalog: DataFrame, confidences: DataFrame | None = None) -> DataFrame:
    """SRC4: id, name, confidence: the override's, else the row's, else medium."""
    rows = catalog.select("id", "name", F.col("confidence").alias("own"))
    if confidences is not None:
        rows = rows.join(confidences.select("id", F.col("confidence").alias("over")), "id", "left")
    else:
        rows = rows.withColumn("over", F.lit(None).cast("string"))
    return entries.select("id").distinct().join(rows, "id", "left").select("id", "name", F.coalesce("over", "own", F.lit("medium")).alias("confidence"))


def decoded_catalog(rows: DataFrame) -> DataFrame:
    """SRC6: letters to words, missing traits to none."""
    word = F.when(F.col("confidence") == "h", "high").when(F.col("confidence") == "l", "low").otherwise("medium")
    return rows.withColumn("confidence", word).withColumn("traits", F.coalesce("traits", F.array().cast("array<string>")))


def latest_by_id(records: DataFrame) -> DataFrame:
    """PL1: a repeated id keeps the last record, at the first one's place."""
    last = records.groupBy("id").agg(F.max_by(F.struct(*records.columns), "ord").alias("r"), F.min("ord").alias("at"))
    return last.select(*[F.col("at").alias("ord") if c == "ord" else F.col(f"r.{c}").alias(c) for c in records.columns])


def write_outputs(records: DataFrame, index: DataFrame, catalog: DataFrame, facets: DataFrame, out: str) -> None:
    """SNK1: the index sorted by its key (so that readers prune row groups), the catalogue, facets, and records in shards by the beginning of the id."""
    index.sortWithinPartitions("n").write.mode("overwrite").parquet(f"{out}/index")
    catalog.write.mode("overwrite").parquet(f"{out}/catalog")
    facets.coalesce(1).write.mode("overwrite").json(f"{out}/facets")
    records.withColumn("shard", F.substring("id", 1, 2)).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{out}/records")


def load_record(spark: SparkSession, out: str, rec_id: str) -> DataFrame:
    """SRC5: reads only the shard of the id; no row if it isn't there."""
    return spark.read.parquet(f"{out}/records").where((F.col("shard") == rec_id[:2]) & (F.col("id") == rec_id)).drop("shard")
