"""Where stores of one session may lie: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset and the master is local a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name not used before, in the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so it is worked out once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder: for rows that are read more than once."""
    place = new_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
