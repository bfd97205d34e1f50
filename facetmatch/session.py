"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="checkpoint-")
    return _own[sc.applicationId]


_own: dict[str, str] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df hashed by keys over spark.sql.shuffle.partitions, which isn't coalesced: for little data that much is worked out of. Later groupings, joins and windows by keys need no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def apart(df: DataFrame) -> DataFrame:
    """df as a step that isn't compiled into one with the next. A compiled join hands on nothing until it is through with a row and all that it meets: exploded in the same step, all of that would be held in memory at once."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
