"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset.

    Our own is in the warehouse, which is shared; in local mode, where there is one machine, it is a temporary one.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        local = spark.sparkContext.master.startswith("local")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="echoloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/echoloom-shared")
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/echoloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes the frame as Parquet in the shared folder and reads it back; returns it and its path."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
